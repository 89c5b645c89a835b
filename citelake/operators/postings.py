"""The sparse leg by an inverted index with upper bounds.

Chunks lie in blocks by their weight, heavy ones first, and for each token a block has one row: its chunks, their weights, and the largest and smallest of these. A question's bound for a block is
what its best chunk could reach at most. The blocks of the highest bounds are scored first; what a question's last place then asks for rules out all blocks whose bound is below it. The result is that
of `retrieve.sparse_topk`, for weights of any sign. As heavy chunks are together, the bounds of most blocks are small.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import fresh, written
from .retrieve import FILTERS, SPARSE_LIMIT, allowed, best, top

#: Chunks of a block at most, about; by default it is the root of their number. Folders of the index, which are what a search may leave unread.
BLOCK_ROWS, ZONES = 2048, 256
#: Questions that meet a block in one task, about.
QUESTIONS = 1024
#: Of a bound, for sums in another order.
MARGIN = 1e-6


@dataclasses.dataclass
class Index:
    """Written tables: entries (zone, block, tok, ids, n), heads (block, ids and a list for each filter), bounds (tok, block, most, least, entries) and sizes (block, zone, rows)."""

    entries: DataFrame
    heads: DataFrame
    bounds: DataFrame
    sizes: DataFrame


def weights(terms: DataFrame, key: str) -> DataFrame:
    """Repeated tokens of a row add up; null tokens and weights count for nothing."""
    return terms.filter("tok is not null and n is not null").groupBy(key, "tok").agg(F.sum(F.col("n").cast("double")).alias("n"))


def build(terms: DataFrame, filters: DataFrame | None = None, block_rows: int | None = None) -> Index:
    """Index of `terms` (chunk_id, tok, n). filters (chunk_id and any of FILTERS): what questions may ask of a chunk; chunks that it lacks are left out."""
    spark = terms.sparkSession
    t = written(weights(terms, "chunk_id"), "postings-terms")
    heavy = t.groupBy("chunk_id").agg(F.sum(F.abs("n")).alias("weight"))
    names = [c for c in FILTERS if filters is not None and c in filters.columns]
    if filters is not None:
        heavy = heavy.join(filters.select("chunk_id", *names), "chunk_id")
    heavy = written(heavy, "postings-rows")
    n = heavy.count()
    blocks = max(1, -(-n // max(1, block_rows or min(round(n**0.5), BLOCK_ROWS))))
    rows = written(heavy.repartitionByRange(blocks, F.desc("weight"), "chunk_id").withColumn("block", F.spark_partition_id()), "postings-blocks")

    zone = F.floor(F.col("block") * min(blocks, ZONES) / blocks).cast("int").alias("zone")
    entry = F.array_sort(F.collect_list(F.struct("chunk_id", "n")))
    lists = t.join(rows.select("chunk_id", "block"), "chunk_id").groupBy("block", "tok").agg(entry.alias("e"))
    lists = lists.select(zone, "block", "tok", F.col("e.chunk_id").alias("ids"), F.col("e.n").alias("n"))
    path = fresh(spark, "postings")
    lists.repartition("zone").sortWithinPartitions("zone", "block", "tok").write.partitionBy("zone").parquet(path)
    entries = spark.read.schema("block int, tok string, ids array<long>, n array<double>, zone int").parquet(path)
    bounds = entries.select("tok", "block", F.array_max("n").alias("most"), F.array_min("n").alias("least"), F.size("ids").cast("long").alias("entries"))
    head = F.array_sort(F.collect_list(F.struct("chunk_id", *names)))
    heads = rows.groupBy("block").agg(head.alias("e")).select("block", F.col("e.chunk_id").alias("ids"), *(F.col(f"e.{c}").alias(c) for c in names))
    sizes = rows.groupBy("block").agg(F.count("*").alias("rows")).select("block", zone, "rows")
    return Index(entries, written(heads, "postings-heads"), written(bounds, "postings-bounds"), written(sizes, "postings-sizes"))


def scored(asked: DataFrame, pairs: DataFrame, index: Index, names: list[str], limit: int) -> DataFrame:
    """(qid, chunk_id, product): each question's best of each of its blocks. asked: qid, tok, n and filters; pairs: qid, block. A block meets its questions in as many tasks as they need."""
    crowds = written(pairs.groupBy("block").agg(F.ceil(F.count("*") / QUESTIONS).cast("int").alias("parts")).join(index.sizes.select("block", "zone"), "block"), "postings-crowds")
    zones = [x["zone"] for x in crowds.select("zone").distinct().collect()]  # ZONES at most
    part = F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int").alias("part")
    left = asked.join(pairs, "qid").join(crowds, "block").select("block", part, "qid", "tok", "n", *names)
    lists = index.entries.filter(F.col("zone").isin(zones)).join(asked.select("tok").distinct(), "tok", "left_semi").select("block", "tok", "ids", "n")
    both = lists.unionByName(index.heads.select("block", "ids", *names), allowMissingColumns=True).join(crowds, "block")
    right = both.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "tok", "ids", "n", *names)

    def meet(mine: pa.Table, there: pa.Table) -> pa.Table:
        none = pa.table({"qid": pa.array([], pa.int64()), "chunk_id": pa.array([], pa.int64()), "product": pa.array([], pa.float64())})
        if not mine.num_rows or not there.num_rows:
            return none
        toks, ids, n = there.column("tok").to_pylist(), there.column("ids").combine_chunks(), there.column("n").combine_chunks()
        head = toks.index(None)
        chunk = ids[head].values.to_numpy()
        has = {c: there.column(c)[head].values for c in names}
        qids, first, who = np.unique(mine.column("qid").to_numpy(), return_index=True, return_inverse=True)
        wanted = {c: np.array(mine.column(c).to_pylist(), object)[first] for c in names}
        own: dict[str, list[int]] = {}
        for k, tok in enumerate(mine.column("tok").to_pylist()):
            own.setdefault(tok, []).append(k)
        weight, s, shared = mine.column("n").to_numpy(), np.zeros((len(qids), len(chunk))), False
        for k, tok in enumerate(toks):
            if tok is not None and (asks := own.get(tok)):
                at = np.searchsorted(chunk, ids[k].values.to_numpy())
                s[np.ix_(who[asks], at)] += np.outer(weight[asks], n[k].values.to_numpy())
                shared = True
        if not shared:
            return none
        s[s == 0] = -np.inf
        i, j = best(allowed(s, wanted, pa.record_batch(has)) if names else s, chunk, limit)
        return pa.table({"qid": pa.array(qids[i], pa.int64()), "chunk_id": pa.array(chunk[j], pa.int64()), "product": pa.array(s[i, j])})

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, "qid long, chunk_id long, product double")


def searched(question_terms: DataFrame, index: Index, limit: int, questions: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits of all scored blocks, bounds of all blocks with a token in common, pairs of question and block that were scored)."""
    asked, names = weights(question_terms, "qid"), []
    if questions is not None:
        names = [c for c in FILTERS if c in questions.columns and c in index.heads.columns]
        asked = asked.join(questions.select("qid", *names), "qid")
    asked = written(asked, "postings-asked")
    most = F.greatest(F.col("n") * F.col("most"), F.col("n") * F.col("least"), F.lit(0.0))
    bounds = asked.join(index.bounds, "tok").groupBy("qid", "block").agg(F.sum(most).alias("bound"), F.sum("entries").alias("entries"))
    w = Window.partitionBy("qid").orderBy(F.desc("bound"), "block")
    before = F.coalesce(F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = written(bounds.join(index.sizes, "block").withColumn("first", before < 2 * limit), "postings-pairs")
    one = written(scored(asked, bounds.filter("first").select("qid", "block"), index, names, limit), "postings-first")
    last = top(one, "qid", "product", "chunk_id", limit).groupBy("qid").agg(F.count("*").alias("hits"), F.min("product").alias("last")).filter(F.col("hits") == limit)
    need = F.coalesce(F.col("last") - MARGIN * (1 + F.abs("last")), F.lit(float("-inf")))
    rest = written(bounds.filter("not first").join(last, "qid", "left").filter(F.col("bound") >= need).select("qid", "block"), "postings-rest")
    two = scored(asked, rest, index, names, limit)
    return one.unionByName(two), bounds, bounds.filter("first").select("qid", "block").unionByName(rest)


def search(question_terms: DataFrame, index: Index, limit: int = SPARSE_LIMIT, questions: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, product, rk): the rows of `retrieve.sparse_topk` for `question_terms` (qid, tok, n). questions (qid and filters): only these ask, and filters come before the limit; limit <= 0: no rows."""
    if limit <= 0:
        return top(question_terms.sparkSession.createDataFrame([], "qid long, chunk_id long, product double"), "qid", "product", "chunk_id", 0)
    return top(searched(question_terms, index, limit, questions)[0], "qid", "product", "chunk_id", limit)


def read(question_terms: DataFrame, index: Index, limit: int = SPARSE_LIMIT, questions: DataFrame | None = None) -> DataFrame:
    """One row: pairs of question and block with a token in common (blocks), those that were scored, and the like for entries of the index; limit is at least 1."""
    _, bounds, pairs = searched(question_terms, index, limit, questions)
    return bounds.join(pairs.withColumn("hit", F.lit(True)), ["qid", "block"], "left").agg(
        F.count("*").alias("blocks"), F.count("hit").alias("blocks_scored"), F.sum("entries").alias("entries"), F.sum(F.when(F.col("hit"), F.col("entries"))).alias("entries_scored")
    )

"""Similarity join of word-shingle sets by T-occurrence search.

Sets of similarity p share at least T = p * |r| shingles of each of them, r. Inverted lists hold the sets of each shingle, and a query finds
the sets that occur in T of its shingles' lists: DivideSkip merges the short lists in a heap and probes the few long ones, which
boilerplate makes, only for sets that the short ones leave possible.

Over a corpus the lists are dealt out. In one order of all shingles a set's first |r| - T + 1 shingles are its prefix,
and similar sets share a shingle of their prefixes. The order is that of hashes, with shingles last that very many prefixes would hold; it decides
only how long lists get, not what is found. Sets that share a prefix shingle and are of like size meet in a task, at first with their prefixes only: two sets are
dropped where their prefixes leave no room for the overlap that they need. Groups of sets that are left meet again, whole, in a task that builds the inverted lists of all
their shingles and searches them. First each set meets the first set of each of its lists, which joins copies
at a cost of one search each; then lists that still hold several components are searched as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, text_key
from .components import components
from .inverted import HOT, TOKENS, WEIGHT, Dealt, live_rows, open_rows, prefix, prefix_size, spare_size, star_rows, without_hot
from .minhash import shingles


def similar_sets(docs: DataFrame, k: int = 5, percent: int = 80, weight: int = WEIGHT, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs` (doc_id, text); key_ tells rows of one id apart.

    Links: 100 * |intersection| >= percent * |union| on the sets of k-word shingles. Null or empty texts and texts of white space have
    the empty set and no links. component_id: the smallest id reachable by links; a row without an id counts as larger than all, and its
    component_id is null only if no row reachable has an id. Rows with equal sets are linked, those of one id too. Texts of any length are whole sets.
    Other columns are ignored. An empty table gives no rows.
    """
    spark, stages = docs.sparkSession, Stages(docs.sparkSession, "overlap-join")
    texts = docs.select("doc_id", text_key(F.col("text")).alias("key_"), "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x, k) for x in batch.column("text").to_pylist()]
            ids = pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary())
            begins = [prefix(x, percent, spare=spare_size(len(x), percent)) for x in sets]
            tokens, spare = (pa.array(x, pa.list_(pa.int64())) for x in ([b[: prefix_size(len(x), percent)] for b, x in zip(begins, sets, strict=True)], [b[prefix_size(len(x), percent) :] for b, x in zip(begins, sets, strict=True)]))
            yield pa.record_batch([batch.column("doc_id"), batch.column("key_"), ids, pa.array(map(len, sets), pa.int64()), tokens, spare], ["doc_id", "key_", "set", "n_shingles", "tokens", "spare"])

    rows = stages.put(texts.mapInArrow(sign, "doc_id long, key_ long, set binary, n_shingles long, tokens array<long>, spare array<long>"))
    # One row for each distinct set, however many documents have it.
    named = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key_")
    sets = rows.filter("n_shingles > 0").groupBy("set").agg(F.min(named).alias("first"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"), F.first("spare").alias("spare"))
    sets = stages.put(sets.withColumn("sid", F.monotonically_increasing_id()))
    signed, rows = rows, stages.put(rows.drop("tokens", "spare"))
    stages.drop(signed)
    stages.free()
    first = sets.select("sid", "n", F.col("first.doc_id").alias("id_"), F.col("first.key_").alias("k_"))
    # Only rows that are equal in id and text make a set's text come more than once.
    has_copies = not rows.groupBy("doc_id", "key_").count().filter("count > 1").isEmpty()

    def text_of(sids: DataFrame) -> DataFrame:
        some = first.join(sids, "sid", "left_semi")
        found = texts.join(some, (F.col("key_") == F.col("k_")) & F.col("doc_id").eqNullSafe(F.col("id_"))).select("sid", "n", "text")
        return found.dropDuplicates(["sid"]) if has_copies else found

    def again(sids: DataFrame, places: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast(places)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [prefix(shingles(t, k), percent, shared.value) for t in batch.column("text").to_pylist()]
                yield pa.record_batch([batch.column("sid"), batch.column("n"), pa.array(found, pa.list_(pa.int64()))], ["sid", "n", "tokens"])

        return text_of(sids).mapInArrow(run, TOKENS)

    tokens = without_hot(sets, again, percent, stages, hot)
    if tokens is not sets:
        whole, sets = sets, stages.put(sets.drop("tokens", "spare"))
        stages.drop(whole)
        first = sets.select("sid", "n", F.col("first.doc_id").alias("id_"), F.col("first.key_").alias("k_"))
    live = live_rows(tokens, percent, stages)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("sid"), pa.array([shingles(t, k).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], ["sid", "hashes"])

    dealt = Dealt(tokens, lambda some: text_of(some).select("sid", "text").mapInArrow(hashed, "sid long, hashes binary"), stages, percent, weight)
    fits = lambda a, b: F.least(a, b) * 100 >= percent * F.greatest(a, b)
    stars = stages.put(live.filter((F.col("sid") != F.col("c.sid")) & fits(F.col("n"), F.col("c.n"))).select(F.col("c.sid").alias("c"), F.col("c.n").alias("cn"), "sid", "n").distinct())
    each = weight * 100 // (100 - percent)
    linked = dealt.links(star_rows(stars, stages, each))
    stages.drop(stars)
    labels = components(linked, stages)
    more = dealt.links(open_rows(live, labels, each, stages))
    labels = components(linked.unionByName(more), stages)

    per_set = stages.put(sets.select("set", "sid", F.col("first.doc_id").alias("low")).join(labels.select(F.col("node").alias("sid"), "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid")))
    # Written: joins of tables have a plain shuffle on both sides, and Spark can split a hot component's rows.
    ids = stages.put(per_set.groupBy("label").agg(F.min("low").alias("component_id")))
    named_sets = per_set.join(ids, "label").select("set", "component_id")
    stages.drop(live)
    out = rows.join(named_sets, "set", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "key_")


def op11_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85).drop("key_")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
c(root, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.root, e.b FROM c JOIN e ON e.a = c.node),
m AS (SELECT root AS doc_id, min(node) AS component_id FROM c GROUP BY root)
SELECT m.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""

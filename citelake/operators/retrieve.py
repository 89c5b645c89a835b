"""Batched hybrid retrieval: dense and sparse legs, weighted fusion, folding into parents, restoring context."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.text import IDENTIFIER, family
from ..sources.shared import written

DENSE_LIMIT, SPARSE_LIMIT, PARENTS = 20, 40, 5
FILTERS = ("country", "doc_type", "publisher")
#: Questions that are scored against a batch of rows at once, and that are broadcast at most; rows of either side of a task of the grid, about.
QUESTION_BLOCK, GRID_ROWS = 4096, 16_384
#: Products of weights and scores (questions x rows) that are held at once.
PRODUCTS, CELLS = 1 << 19, 1 << 20
#: Rows that are scored against a block at once, at most.
BATCH = 1024
#: Hits of a batch that leaves a task.
SENT = 1 << 16


def checked_filter(values: dict[str, str | None]) -> Column:
    """All non-null filters hold. A value that is not an identifier is an error."""
    import re

    out = F.lit(True)
    for name, value in values.items():
        if name not in FILTERS:
            raise ValueError(f"unknown filter {name}")
        if value is not None:
            if not re.fullmatch(IDENTIFIER[2:-2], value):
                raise ValueError(f"bad value for {name}: {value!r}")
            out = out & (F.col(name) == value)
    return out


def eligible(question: str = "q", row: str = "v", names: tuple[str, ...] = FILTERS) -> Column:
    """For joins: each filter of the question is null or the row's value."""
    out = F.lit(True)
    for n in names:
        out = out & (F.col(f"{question}.{n}").isNull() | (F.col(f"{question}.{n}") == F.col(f"{row}.{n}")))
    return out


def top(df: DataFrame, key: str, score: str, tie: str, limit: int) -> DataFrame:
    """The `limit` best rows of each key; scores equal to 9 digits are ordered by `tie`. Adds rk from 1. limit <= 0: no rows."""
    w = Window.partitionBy(key).orderBy(F.round(score, 9).desc(), tie)
    return df.withColumn("rk", F.row_number().over(w).cast("long")).filter(F.col("rk") <= max(0, limit))


def best(s: np.ndarray, chunk: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(question, column) of the `limit` best finite scores of each row; scores equal to 9 digits are ordered by chunk id. Rows are not sorted in full."""
    r = np.round(s, 9)
    if limit < r.shape[1]:
        r[r < np.partition(r, r.shape[1] - limit, axis=1)[:, r.shape[1] - limit, None]] = -np.inf
    i, j = np.nonzero(np.isfinite(r))
    o = np.lexsort((chunk[j], -r[i, j], i))
    i, j = i[o], j[o]
    rank = np.arange(len(i)) - np.searchsorted(i, i)  # of ties at the limit the smallest ids
    return i[rank < limit], j[rank < limit]


def kept(i: np.ndarray, chunk: np.ndarray, s: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `limit` best hits of each question among hits of several batches."""
    o = np.lexsort((chunk, -np.round(s, 9), i))
    i, chunk, s = i[o], chunk[o], s[o]
    first = np.arange(len(i)) - np.searchsorted(i, i) < limit
    return i[first], chunk[first], s[first]


def allowed(s: np.ndarray, wanted: dict[str, np.ndarray], batch: pa.RecordBatch) -> np.ndarray:
    """Scores (questions x rows) with -inf where a filter of the question, if it is set, is not the row's value."""
    for c, w in wanted.items():
        have = np.array(batch.column(c).to_pylist(), object)
        s[(w != None)[:, None] & (w[:, None] != have[None])] = -np.inf  # noqa: E711
    return s


class Block:
    """Questions of one block (qid, filters and what `score` reads), scored against batches of rows."""

    def __init__(self, asked: pa.Table, score: Callable, names: list[str]):
        self.ids, self.scores = asked.column("qid").to_numpy(), score(asked)
        self.wanted = {c: np.array(asked.column(c).to_pylist(), object) for c in names}

    def best(self, batches: Iterable[pa.RecordBatch], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(qid, chunk id, score) of each question's best rows of all batches. What is below a question's last place so far is dropped at once, so about as many hits are held as leave."""
        floor, size = np.full(len(self.ids), -np.inf), len(self.ids)
        hits = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        step, more = max(1, min(BATCH, CELLS // max(1, size))), 0
        for batch in (whole.slice(start, step) for whole in batches for start in range(0, whole.num_rows, step)):
            s = allowed(self.scores(batch), self.wanted, batch)
            s[np.round(s, 9) < floor[:, None]] = -np.inf
            chunk = batch.column("chunk_id").to_numpy(zero_copy_only=False)
            i, j = np.nonzero(np.isfinite(s))
            if len(i) > size * limit:
                i, j = best(s, chunk, limit)
            hits.append((i, chunk[j], s[i, j]))
            more += len(i)
            if more >= size * limit:
                hits, more = [kept(*(np.concatenate(x) for x in zip(*hits, strict=True)), limit)], 0
                last = np.cumsum(np.bincount(hits[0][0], minlength=size))
                full = np.diff(last, prepend=0) == limit
                floor[full] = np.round(hits[0][2][last[full] - 1], 9)
        i, chunk, s = kept(*(np.concatenate(x) for x in zip(*hits, strict=True)), limit)
        return self.ids[i], chunk, s


def asked_in_blocks(questions: DataFrame, rows: DataFrame, score: Callable, limit: int, value: str) -> DataFrame:
    """(qid, chunk_id, value, rk): the best rows for each question; ids are unique on both sides.

    `score` gives, for an Arrow table of questions, what scores an Arrow batch of `rows`: a matrix with a row for each question, -inf where a row is no hit. Filters that both have are applied before the limit.
    Up to QUESTION_BLOCK questions are broadcast and the rows stay where they are; more meet the rows in a grid. Only each question's best leave a task either way.
    """
    names = [n for n in FILTERS if n in questions.columns and n in rows.columns]
    schema = f"qid long, chunk_id long, {value} double"
    few = questions.limit(QUESTION_BLOCK + 1 if limit > 0 else 0).toArrow()  # bounded: tells whether a broadcast is
    if not few.num_rows:
        return top(rows.sparkSession.createDataFrame([], schema), "qid", value, "chunk_id", limit)
    if few.num_rows > QUESTION_BLOCK:
        return top(grid(questions, rows, score, limit, names, schema), "qid", value, "chunk_id", limit)
    shared = rows.sparkSession.sparkContext.broadcast(Block(few, score, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, chunk, s = shared.value.best(batches, limit)
        for start in range(0, len(qid), SENT):
            part = slice(start, start + SENT)
            yield pa.record_batch([pa.array(qid[part], pa.int64()), pa.array(chunk[part], pa.int64()), pa.array(s[part])], ["qid", "chunk_id", value])

    return top(rows.mapInArrow(run, schema), "qid", value, "chunk_id", limit)


def grid(questions: DataFrame, rows: DataFrame, score: Callable, limit: int, names: list[str], schema: str) -> DataFrame:
    """Each block of questions meets each part of the rows in one task, and each question's best rows of the part leave it.

    Blocks and parts hold about GRID_ROWS rows, so a task is bounded and both sides are copied alike often: rows once for each block, questions once for each part. Nothing passes through the driver.
    """
    asked = written(questions, "questions")
    blocks, parts = max(1, -(-asked.count() // GRID_ROWS)), max(1, -(-rows.count() // GRID_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("*", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block_"), every(parts).alias("part_"))
    right = rows.select("*", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("part_"), every(blocks).alias("block_"))
    value = schema.split()[-2]

    def meet(mine: pa.Table, there: pa.Table) -> pa.Table:
        ids, chunks, scores = [], [], []
        for start in range(0, mine.num_rows if there.num_rows else 0, QUESTION_BLOCK):
            qid, chunk, s = Block(mine.slice(start, QUESTION_BLOCK).combine_chunks(), score, names).best(there.to_batches(), limit)
            ids.append(qid), chunks.append(chunk), scores.append(s)
        whole = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        return pa.table({"qid": whole(ids, pa.int64()), "chunk_id": whole(chunks, pa.int64()), value: whole(scores, pa.float64())})

    return left.groupBy("block_", "part_").cogroup(right.groupBy("block_", "part_")).applyInArrow(meet, schema)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def flat(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()


def matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    """Unit vectors, one a row, of a column of n lists of like length."""
    return unit(flat(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1))


class Cosines:
    """Of a block of questions with every vector of a batch."""

    def __init__(self, asked: pa.Table):
        self.q = matrix(asked.column("dense"), asked.num_rows)

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        return self.q @ matrix(batch.column("dense"), batch.num_rows).T


class Products:
    """Of a block of questions with the terms of every chunk of a batch; -inf without a token in common. The postings of the questions' tokens are added up, PRODUCTS of them at a time."""

    def __init__(self, asked: pa.Table):
        lists = asked.column("tok").combine_chunks()
        self.size, self.vocabulary = asked.num_rows, pc.unique(lists.flatten())
        code = pc.index_in(lists.flatten(), self.vocabulary).to_numpy()
        o = np.argsort(code, kind="stable")
        self.who = pc.list_parent_indices(lists).to_numpy()[o].astype(np.int64)
        self.weight = flat(asked.column("n")).to_numpy()[o].astype(np.float64)
        self.first = np.searchsorted(code[o], np.arange(len(self.vocabulary) + 1))

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        lists, rows = batch.column("tok"), batch.num_rows
        code = pc.index_in(lists.flatten(), self.vocabulary).fill_null(-1).to_numpy()
        hit = code >= 0
        code, row, n = code[hit], pc.list_parent_indices(lists).to_numpy()[hit].astype(np.int64), flat(batch.column("n")).to_numpy()[hit]
        counts = self.first[code + 1] - self.first[code]
        upto, out = np.cumsum(counts), np.zeros(self.size * rows)
        cuts = np.append(np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, PRODUCTS)), len(upto))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            c = counts[a:b]
            at = np.repeat(self.first[code[a:b]] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            out += np.bincount(self.who[at] * rows + np.repeat(row[a:b], c), weights=self.weight[at] * np.repeat(n[a:b], c), minlength=len(out))
        out[out == 0] = -np.inf
        return out.reshape(self.size, rows)


def dense_topk(questions: DataFrame, vectors: DataFrame, limit: int = DENSE_LIMIT) -> DataFrame:
    """(qid, chunk_id, cosine, rk): for each question (qid, dense and any of country, doc_type, publisher) the nearest vectors that its filters allow.

    Exact: a batch of vectors is scored by one matrix product. Vectors of length 0 have cosine 0; null vectors are no hits, and questions without one have none.
    """
    names = [n for n in FILTERS if n in questions.columns and n in vectors.columns]
    return asked_in_blocks(questions.filter("dense is not null").select("qid", "dense", *names), vectors.filter("dense is not null").select("chunk_id", "dense", *names), Cosines, limit, "cosine")


def sparse_topk(question_terms: DataFrame, terms: DataFrame, limit: int = SPARSE_LIMIT, questions: DataFrame | None = None, filters: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, product, rk): inner products of (qid, tok, n) with (chunk_id, tok, n), for rows with a token in common.

    Terms are gathered by chunk, at most a row's own tokens; a chunk's tokens then add up the postings of a block of questions, so no pair of a token's chunks and questions is ever a row. A null token or weight counts for nothing.
    questions (qid and filters) and filters (chunk_id and the columns that they name) restrict what each question may find.
    """
    question_terms, terms = question_terms.filter("tok is not null and n is not null"), terms.filter("tok is not null and n is not null")
    q = question_terms.groupBy("qid").agg(F.collect_list("tok").alias("tok"), F.collect_list("n").alias("n"))
    rows = terms.groupBy("chunk_id").agg(F.collect_list("tok").alias("tok"), F.collect_list("n").alias("n"))
    if questions is not None and filters is not None:
        q, rows = q.join(questions.select("qid", *(n for n in FILTERS if n in questions.columns)), "qid"), rows.join(filters, "chunk_id")
    return asked_in_blocks(q, rows, Products, limit, "product")


def fuse(dense: DataFrame, sparse: DataFrame, dense_weight: float = scores.DENSE_WEIGHT, sparse_weight: float = scores.SPARSE_WEIGHT) -> DataFrame:
    """(qid, chunk_id, cosine, product, score): the union of both legs, summed; a missing leg adds 0."""
    nothing = F.lit(None).cast("double")
    both = dense.select("qid", "chunk_id", "cosine", nothing.alias("product")).unionByName(sparse.select("qid", "chunk_id", nothing.alias("cosine"), "product"))
    both = both.groupBy("qid", "chunk_id").agg(F.max("cosine").alias("cosine"), F.max("product").alias("product"))
    return both.withColumn("score", scores.fused(F.col("cosine"), F.col("product"), dense_weight, sparse_weight))


def fold_by_parent(hits: DataFrame) -> DataFrame:
    """(qid, parent_id, doc_id, score, children): the best child's score; all children, best first, ties by id. hits: qid, chunk_id, parent_id, doc_id, score."""
    child = F.struct((-F.round("score", 9)).alias("o"), "chunk_id", "score")
    folded = hits.groupBy("qid", "parent_id").agg(F.min_by("doc_id", "chunk_id").alias("doc_id"), F.max("score").alias("score"), F.array_sort(F.collect_list(child)).alias("c"))
    return folded.select("qid", "parent_id", "doc_id", "score", F.transform("c", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["score"].alias("score"))).alias("children"))


def top_parents(hits: DataFrame, limit: int = PARENTS) -> DataFrame:
    """The best parents of each question after folding."""
    return top(fold_by_parent(hits), "qid", "score", "parent_id", limit)


def hybrid(questions: DataFrame, question_terms: DataFrame, vectors: DataFrame, terms: DataFrame) -> DataFrame:
    """Fused hits of both legs with their parents: filters come before each leg's limit."""
    names = [n for n in FILTERS if n in questions.columns]
    allowed = vectors.select("chunk_id", *names)
    sparse = sparse_topk(question_terms, terms, SPARSE_LIMIT, questions, allowed)
    return fuse(dense_topk(questions, vectors), sparse).join(vectors.select("chunk_id", "parent_id", "doc_id"), "chunk_id")


def best_score(questions: DataFrame, dense: DataFrame) -> DataFrame:
    """(qid, dense_top_score): null for a question without an eligible vector. This score, not the fused one, feeds the gate."""
    return questions.select("qid").join(dense.groupBy("qid").agg(F.max("cosine").alias("dense_top_score")), "qid", "left")


def gate(score: Column, threshold: float | None) -> Column:
    """Whether a question may be answered: never without a score. No threshold is an error."""
    if threshold is None:
        raise ValueError("no threshold is set")
    return F.when(score.isNull(), False).otherwise(score >= threshold)


def load_context(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits (qid, rk, parent_id, doc_id, score, children) with text and token_count of the parent, the document's columns and matched_children (chunk_id, score, text, start, end), by rank. A question has a parent once.

    Texts are joined to the few hits only. What the index names and the tables lack is an error when the row is computed, never a row with a gap: a lost parent, child or document.
    A hit's parent and children meet their texts in one shuffle, and rows are gathered by rank where they are sorted: a text is moved twice, however many hits there are.
    Chunks of a document travel side by side, so that a shuffle's compression finds the children in their parent.
    """
    def found(key: str | Column, value: str, there: Column, kept: Column) -> Column:
        return F.when(there, kept).otherwise(F.raise_error(F.concat(F.lit("no "), F.lit(key) if isinstance(key, str) else key, F.lit(" "), F.col(value).cast("string"), F.lit(": the index was cut short"))))

    d, at = documents.withColumnRenamed("doc_id", "d_"), ["qid", "rk", "parent_id"]
    own, more = [n for n in hits.columns if n not in (*at, "children")], [n for n in documents.columns if n != "doc_id"]
    h = hits.join(d, F.col("doc_id") == F.col("d_"), "left").withColumn("doc_id", found("doc_id", "doc_id", F.col("d_").isNotNull(), F.col("doc_id")))
    score = hits.schema["children"].dataType.elementType["score"].dataType
    first = F.array(F.struct(F.col("parent_id").alias("chunk_id"), F.lit(None).cast(score).alias("score")))
    children = F.transform("children", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["score"].alias("score")))
    named = h.select(*at, F.struct(*own, *more).alias("h_"), F.posexplode(F.concat(first, F.coalesce(children, F.array()))).alias("o_", "n_"))
    parent = F.col("o_") == 0
    named = named.select(*at, F.when(parent, F.col("h_")).alias("h_"), "o_", "n_.chunk_id", "n_.score")
    c = chunks.select("chunk_id", F.struct("text", "token_count", "start", "end").alias("t_"))
    meet = named.unionByName(c, allowMissingColumns=True).withColumn("f_", family(F.col("chunk_id"))).repartition("f_")  # a join would move them by chunk_id
    texts = meet.withColumn("t_", F.first("t_").over(Window.partitionBy("f_", "chunk_id").orderBy(F.col("o_").isNotNull()))).filter("o_ is not null").drop("f_")
    texts = texts.withColumn("t_", found(F.when(parent, "parent_id").otherwise("chunk_id"), "chunk_id", F.col("t_").isNotNull() & F.col("chunk_id").isNotNull(), F.col("t_")))
    one = F.struct("o_", F.struct("chunk_id", "score", "t_.text", "t_.start", "t_.end").alias("m"))
    out = texts.sortWithinPartitions(*at, "o_").repartitionByRange("qid", "rk").groupBy(*at).agg(F.first("h_", True).alias("h_"), F.first(F.when(parent, F.struct("t_.text", "t_.token_count")), True).alias("p_"), F.array_sort(F.collect_list(F.when(~parent, one))).alias("k_"))
    matched = F.when(F.size("k_") > 0, F.transform("k_", lambda x: x["m"])).alias("matched_children")
    return out.select("qid", "parent_id", *("rk" if n == "rk" else f"h_.{n}" for n in hits.columns if n in ("rk", *own)), "p_.text", "p_.token_count", matched, *(f"h_.{n}" for n in more)).orderBy("qid", "rk")


def missing_references(hits: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Hits whose chunk does not exist: an error of the index, never a dropped row."""
    return hits.join(chunks.select(key), key, "left_anti")

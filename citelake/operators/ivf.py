"""The approximate dense leg: an inverted file of vectors.

Centroids are fitted on a bounded sample; every vector goes to the list of its nearest centroid. A question meets the lists of its nearest centroids, whose vectors
are scored exactly. Questions and lists meet by a shuffle on the list, in parts of bounded size, so neither passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .retrieve import DENSE_LIMIT, FILTERS, allowed, best, matrix, top, unit

#: Vectors that centroids are fitted on at most, centroids at most, and vectors of a list that one task scores, about.
SAMPLE, LISTS, PART_ROWS = 65_536, 4096, 50_000
#: Questions that meet a part of a list in one task, about.
QUESTIONS = 2048


def fit(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """Unit centroids (rows) of `vectors` (chunk_id, dense): spherical k-means on the `sample` vectors of least hash, by default about the root of the number of vectors, LISTS at most. Null vectors don't count; no vectors: none."""
    known = vectors.filter("dense is not null").select("chunk_id", "dense")
    n = known.count()
    rows = known.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).collect()  # bounded by `sample`
    if not rows:
        return np.zeros((0, 0))
    x = unit(np.array([r["dense"] for r in rows], np.float64))
    k = min(lists or max(1, round(n**0.5)), LISTS, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        full = np.bincount(near, minlength=k) > 0
        c = np.where(full[:, None], unit(total), c)
    return c


def nearest(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """`rows` with list: a row for each of the `probes` nearest centroids."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)  # LISTS at most
    names, probes = rows.columns, min(probes, len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = matrix(batch.column("dense"), batch.num_rows) @ shared.value.T
            found = np.argpartition(-s, probes - 1, axis=1)[:, :probes] if probes else np.zeros((batch.num_rows, 0), int)
            take = pa.array(np.repeat(np.arange(batch.num_rows), probes))
            yield pa.record_batch([*(c.take(take) for c in batch.columns), pa.array(found.ravel().astype(np.int64))], [*names, "list"])

    return rows.filter("dense is not null").mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "list long"]))


def index(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Every vector of `vectors` (chunk_id, dense and filters) with its list and the part of it, a written table. Null vectors are left out."""
    names = [c for c in ("chunk_id", "dense", *FILTERS) if c in vectors.columns]
    rows = written(nearest(vectors.select(names), centroids, 1), "ivf")
    parts = rows.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    return written(rows.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts"))), "ivf")


def search(questions: DataFrame, indexed: DataFrame, centroids: np.ndarray, probes: int, limit: int = DENSE_LIMIT) -> DataFrame:
    """(qid, chunk_id, cosine, rk): the best vectors for each of `questions` (qid, dense and filters) in its `probes` nearest lists, by exact cosines; filters come before the limit.

    A question and a list meet in as many tasks as the list has parts. Questions without a vector have no hits.
    """
    names = [n for n in FILTERS if n in questions.columns and n in indexed.columns]
    parts = indexed.select("list", "part").distinct()
    asked = nearest(questions.select("qid", "dense", *names), centroids, probes).join(parts, "list")

    def score(mine: pa.Table, there: pa.Table) -> pa.Table:
        if not mine.num_rows or not there.num_rows:
            i = j = np.zeros(0, int)
            s, ids, chunk = np.zeros((1, 1)), np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            s = matrix(mine.column("dense"), mine.num_rows) @ matrix(there.column("dense"), there.num_rows).T
            s = allowed(s, {c: np.array(mine.column(c).to_pylist(), object) for c in names}, there)
            ids, chunk = mine.column("qid").to_numpy(), there.column("chunk_id").to_numpy()
            i, j = best(s, chunk, limit)
        return pa.table({"qid": pa.array(ids[i], pa.int64()), "chunk_id": pa.array(chunk[j], pa.int64()), "cosine": pa.array(s[i, j], pa.float64())})

    # Many questions of one list are cut too, so that a task's matrix is bounded.
    asked = written(asked, "ivf-asked")
    crowds = written(asked.groupBy("list", "part").agg(F.ceil(F.count("*") / QUESTIONS).cast("int").alias("blocks")), "ivf-crowds")
    blocks = asked.join(crowds, ["list", "part"]).withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int"))
    there = indexed.join(crowds.select("list", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")), ["list", "part"])
    got = blocks.groupBy("list", "part", "block").cogroup(there.groupBy("list", "part", "block")).applyInArrow(score, "qid long, chunk_id long, cosine double")
    return top(got, "qid", "cosine", "chunk_id", limit)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """One row: wanted, hits and recall of `found` against `exact` (qid, chunk_id)."""
    both = exact.select("qid", "chunk_id").join(found.select("qid", "chunk_id").withColumn("hit", F.lit(1)), ["qid", "chunk_id"], "left")
    return both.agg(F.count("*").alias("wanted"), F.count("hit").alias("hits")).withColumn("recall", F.col("hits") / F.col("wanted"))

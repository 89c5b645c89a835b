"""The inverted file of vectors against the exact leg."""

import numpy as np
from pyspark.sql import functions as F

from citelake.operators import ivf, retrieve


def clustered(spark, n=3000, dim=16):
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, dim))
    x = centres[r.integers(0, 40, n)] + 0.25 * r.normal(size=(n, dim))
    rows = [(i, x[i].tolist() if i % 97 else None, "DE" if i % 3 else "FR") for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, dense array<float>, country string")


def test_recall_of_few_lists(spark):
    v = clustered(spark)
    q = v.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("qid"), "dense", F.when(F.col("chunk_id") % 100 == 0, F.lit("FR")).alias("country"))
    c = ivf.fit(v, lists=50, sample=1000)
    index = ivf.index(v, c)
    assert index.count() == v.filter("dense is not null").count()
    exact = retrieve.dense_topk(q.filter("dense is not null"), v)
    found = ivf.search(q, index, c, 6)
    assert ivf.recall(exact, found).first()["recall"] >= 0.9
    where = found.join(v.select("chunk_id", F.col("country").alias("c")), "chunk_id").join(q.select("qid", "country"), "qid")
    assert where.filter("country <> c").isEmpty()  # filters come before the limit
    every = ivf.search(q, index, c, 50)
    assert sorted((x.qid, x.rk, x.chunk_id) for x in every.collect()) == sorted((x.qid, x.rk, x.chunk_id) for x in exact.collect())


def test_blocks_and_parts_change_nothing(spark, monkeypatch):
    v = clustered(spark, 400)
    q = v.filter("chunk_id % 4 = 0").select(F.col("chunk_id").alias("qid"), "dense")
    c = ivf.fit(v, lists=4)
    whole = sorted(map(tuple, ivf.search(q, ivf.index(v, c), c, 2).select("qid", "chunk_id", "rk").collect()))
    monkeypatch.setattr(ivf, "PART_ROWS", 30)
    monkeypatch.setattr(ivf, "QUESTIONS", 7)
    assert sorted(map(tuple, ivf.search(q, ivf.index(v, c), c, 2).select("qid", "chunk_id", "rk").collect())) == whole


def test_empty_tables(spark):
    v = clustered(spark, 30).limit(0)
    c = ivf.fit(v)
    assert ivf.search(v.select(F.col("chunk_id").alias("qid"), "dense"), ivf.index(v, c), c, 3).count() == 0

"""The two legs over blocks of questions: broadcast, grid and plain NumPy agree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelake.operators import postings, retrieve


@pytest.fixture(scope="module")
def collection(spark):
    """chunks with vectors, filters and terms; some without a vector, some equal, some without terms."""
    r = np.random.default_rng(8)
    n, dim = 400, 6
    x = np.round(r.normal(size=(n, dim)), 1)
    x[50:60] = x[40:50]  # ties
    x[7] = 0
    rows = [(i, x[i].tolist() if i % 41 else None, "DE" if i % 3 else None if i % 2 else "FR") for i in range(n)]
    words = [[(i, f"w{int(t)}", int(c)) for t, c in zip(np.unique(r.zipf(1.5, 12) % 60), r.integers(1, 9, 12), strict=False)] for i in range(n) if i % 29]
    v = spark.createDataFrame(rows, "chunk_id long, dense array<float>, country string").cache()
    t = spark.createDataFrame([*(w for ws in words for w in ws), (3, None, 5), (4, "w1x", None)], "chunk_id long, tok string, n long").cache()
    q = v.filter("chunk_id % 5 = 0").select(F.col("chunk_id").alias("qid"), "dense", F.when(F.col("chunk_id") % 10 == 0, F.lit("DE")).alias("country"))
    return q, v, t.join(q.select(F.col("qid").alias("chunk_id")), "chunk_id").withColumnRenamed("chunk_id", "qid"), t


def hits(df, value):
    return sorted((x.qid, x.rk, x.chunk_id, round(x[value], 6)) for x in df.collect())


def ranked(scores, limit):
    """(qid, rk, chunk_id, score) of {qid: [(score, chunk_id)]}."""
    return sorted((q, k + 1, c, round(s, 6)) for q, found in scores.items() for k, (s, c) in enumerate(sorted(found, key=lambda x: (-round(x[0], 9), x[1]))[:limit]))


def brute_dense(q, v, limit):
    out = {}
    for a in q.collect():
        for b in v.collect():
            if a.dense is not None and b.dense is not None and a.country in (None, b.country):
                x, y = np.array(a.dense, np.float64), np.array(b.dense, np.float64)
                out.setdefault(a.qid, []).append((float(x @ y / max(np.linalg.norm(x) * np.linalg.norm(y), 1e-300)), b.chunk_id))
    return ranked(out, limit)


def brute_sparse(asked, terms, q, v, limit):
    of, country, out = {}, {x.chunk_id: x.country for x in v.collect()}, {}
    for x in terms.collect():
        if x.tok is not None and x.n is not None:
            of.setdefault(x.chunk_id, {})[x.tok] = x.n
    mine = {}
    for x in asked.collect():
        if x.tok is not None and x.n is not None:
            mine.setdefault(x.qid, {})[x.tok] = x.n
    for a in q.collect():
        for c, own in of.items():
            common = mine.get(a.qid, {}).keys() & own.keys()
            if common and a.country in (None, country[c]):
                out.setdefault(a.qid, []).append((float(sum(mine[a.qid][t] * own[t] for t in common)), c))
    return ranked(out, limit)


@pytest.mark.parametrize("block, cells", [(4096, 16_384), (16, 50), (7, 1000), (79, 7)])
def test_blocks_and_grids_give_the_rows_of_brute_force(spark, monkeypatch, collection, block, cells):
    q, v, asked, t = collection
    monkeypatch.setattr(retrieve, "QUESTION_BLOCK", block)
    monkeypatch.setattr(retrieve, "GRID_ROWS", cells)
    monkeypatch.setattr(retrieve, "BATCH", 64)
    monkeypatch.setattr(retrieve, "PRODUCTS", 100)
    assert hits(retrieve.dense_topk(q, v, 9), "cosine") == brute_dense(q, v, 9)
    assert hits(retrieve.sparse_topk(asked, t, 9, q, v.select("chunk_id", "country")), "product") == brute_sparse(asked, t, q, v, 9)


def test_only_the_best_of_all_batches_leave_a_task(spark, monkeypatch, collection):
    q, v, asked, t = collection
    want = brute_dense(q, v, 3), brute_sparse(asked, t, q, v, 3)
    monkeypatch.setattr(retrieve, "BATCH", 16)
    monkeypatch.setattr(retrieve, "CELLS", 1000)
    one = v.coalesce(1)
    assert (hits(retrieve.dense_topk(q, one, 3), "cosine"), hits(retrieve.sparse_topk(asked, t, 3, q, one.select("chunk_id", "country")), "product")) == want
    monkeypatch.setattr(retrieve, "top", lambda df, *_: df)
    assert retrieve.dense_topk(q, one, 3).count() == len(want[0])


def test_only_chunks_with_a_vector_become_terms(spark, tmp_path):
    from citelake.plans import retrieval

    spark.createDataFrame([(i, f"a b{i} A") for i in range(0, 400, 50)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, [1.0, float(i)], 1) for i in (0, 50, 100, 7)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    _, asked, _, terms = retrieval.inputs(spark, str(tmp_path))
    assert sorted(map(tuple, terms.collect())) == [(0, "a", 2), (0, "b", 1), (50, "a", 2), (50, "b", 1), (100, "a", 2), (100, "b", 1)]
    assert sorted(map(tuple, asked.collect())) == [(0, "a", 2), (0, "b", 1), (100, "a", 2), (100, "b", 1)]


def test_the_grid_of_nothing(spark, monkeypatch, collection):
    q, v, asked, t = collection
    monkeypatch.setattr(retrieve, "QUESTION_BLOCK", 5)
    assert retrieve.dense_topk(q, v.limit(0)).count() == 0 and retrieve.sparse_topk(asked, t.limit(0)).count() == 0
    assert retrieve.sparse_topk(asked.limit(0), t).count() == 0


@pytest.mark.parametrize("rows, questions", [(None, 1024), (10, 5), (1, 1024), (1000, 3)])
def test_the_inverted_index_gives_the_rows_of_brute_force(spark, monkeypatch, collection, rows, questions):
    q, v, asked, t = collection
    monkeypatch.setattr(postings, "QUESTIONS", questions)
    monkeypatch.setattr(postings, "ZONES", 4)
    index = postings.build(t, v.select("chunk_id", "country"), rows)
    assert hits(postings.search(asked, index, 9, q), "product") == brute_sparse(asked, t, q, v, 9)
    nothing = q.withColumn("country", F.lit(None).cast("string"))
    assert hits(postings.search(asked, index, 3), "product") == brute_sparse(asked, t, nothing, v, 3)


def test_weights_of_any_sign_and_repeated_tokens(spark):
    r = np.random.default_rng(2)
    terms = spark.createDataFrame([(int(c), f"w{int(w)}", float(x)) for c, w, x in zip(r.integers(0, 200, 1500), r.integers(0, 40, 1500), r.normal(size=1500), strict=True)], "chunk_id long, tok string, n double").cache()
    whole = postings.weights(terms, "chunk_id")
    asked = whole.filter("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "qid")
    v = whole.select("chunk_id", F.lit("DE").alias("country")).distinct()
    q = asked.select("qid", F.lit(None).cast("string").alias("country")).distinct()
    assert hits(postings.search(asked, postings.build(terms, block_rows=8), 5), "product") == brute_sparse(asked, whole, q, v, 5)


def test_bounds_leave_blocks_unread(spark):
    rows = [(i, f"w{k}", 100 if i < 30 else 1) for i in range(600) for k in range(i % 4, 12, 3)]
    t = spark.createDataFrame(rows, "chunk_id long, tok string, n long")
    got = postings.read(t.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "qid"), postings.build(t, block_rows=20), 5).first()
    assert got.blocks_scored < got.blocks / 4 and got.entries_scored < got.entries / 4


def test_an_index_of_nothing(spark, collection):
    q, v, asked, t = collection
    assert postings.search(asked, postings.build(t.limit(0))).count() == 0
    index = postings.build(t)
    assert postings.search(asked.limit(0), index).count() == postings.search(asked, index, 0).count() == 0

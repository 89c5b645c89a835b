"""Retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import duck, table, view
from ..functions import scores
from ..operators import calibrate, ivf, postings
from ..operators import retrieve as R

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """questions, their terms, vectors, terms of the chunks that have a vector: whole texts meet the ids, before they become terms."""
    vectors, documents = view(spark, sf_dir, "chunk_vectors"), table(spark, sf_dir, "documents")
    questions = vectors.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("qid"), "dense")
    terms = lambda ids: view(spark, sf_dir, "terms", documents=documents.join(ids.toDF("doc_id"), "doc_id", "left_semi"))
    return questions, terms(questions.select("qid")).withColumnRenamed("chunk_id", "qid"), vectors, terms(vectors.select("chunk_id"))


def legs(spark, sf_dir):
    q, asked, v, t = inputs(spark, sf_dir)
    return R.dense_topk(q, v), R.sparse_topk(asked, t)


def fused(spark, sf_dir, *weights):
    v = view(spark, sf_dir, "chunk_vectors")
    return R.fuse(*legs(spark, sf_dir), *weights).join(v.select("chunk_id", "parent_id", "doc_id"), "chunk_id")


def r6(c: str, name: str | None = None):
    return F.round(c, 6).alias(name or c)


DENSE = """, q AS (SELECT chunk_id AS qid, dense FROM chunk_vectors WHERE chunk_id % 100 = 0),
d AS MATERIALIZED (SELECT qid, c.chunk_id, list_cosine_similarity(CAST(q.dense AS DOUBLE[]), CAST(c.dense AS DOUBLE[])) AS cosine FROM q, chunk_vectors c),
dk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cosine, 9) DESC, chunk_id) AS rk FROM d) WHERE rk <= 20)"""
SPARSE = """, s AS MATERIALIZED (SELECT a.chunk_id AS qid, b.chunk_id, CAST(sum(a.n * b.n) AS DOUBLE) AS product FROM terms a JOIN terms b ON a.tok = b.tok
    WHERE a.chunk_id % 100 = 0 AND a.chunk_id IN (SELECT chunk_id FROM chunk_vectors) AND b.chunk_id IN (SELECT chunk_id FROM chunk_vectors) GROUP BY 1, 2),
sk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(product, 9) DESC, chunk_id) AS rk FROM s) WHERE rk <= 40)"""


def fusion(wd: float = 0.7, ws: float = 0.3, name: str = "f") -> str:
    return f""", {name} AS MATERIALIZED (SELECT x.*, v.parent_id, v.doc_id FROM (SELECT coalesce(dk.qid, sk.qid) AS qid, coalesce(dk.chunk_id, sk.chunk_id) AS chunk_id,
    coalesce((1 + cosine) / 2 * {wd}, 0.0) + coalesce((0.5 + atan(product) / pi()) * {ws}, 0.0) AS score
    FROM dk FULL JOIN sk ON dk.qid = sk.qid AND dk.chunk_id = sk.chunk_id) x JOIN chunk_vectors v ON v.chunk_id = x.chunk_id)"""


FOLD = """, p AS (SELECT qid, parent_id, min(doc_id) AS doc_id, max(score) AS score, count(*) AS n_children FROM f GROUP BY 1, 2),
pk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, parent_id) AS rk FROM p)"""
V, VT = ["chunk_vectors"], ["chunk_vectors", "terms"]
ALL = DENSE + SPARSE + fusion() + FOLD


@query(duck(VT, ALL + " SELECT qid, rk, parent_id, doc_id, round(score, 6) AS score, n_children FROM pk WHERE rk <= 5"))
def hybrid_top_parents(spark, sf_dir):
    p = R.top_parents(R.hybrid(*inputs(spark, sf_dir)))
    return p.select("qid", "rk", "parent_id", "doc_id", r6("score"), F.size("children").cast("long").alias("n_children"))


@query(duck(V, DENSE + " SELECT qid, chunk_id, rk, round(cosine, 6) AS cosine FROM dk"))
def dense_topk(spark, sf_dir):
    q, _, v, _ = inputs(spark, sf_dir)
    return R.dense_topk(q, v).select("qid", "chunk_id", "rk", r6("cosine"))


@query(duck(VT, SPARSE + " SELECT qid, chunk_id, rk, product FROM sk"))
def sparse_topk(spark, sf_dir):
    return legs(spark, sf_dir)[1].select("qid", "chunk_id", "rk", "product")


@query(
    duck(
        V,
        """, q AS (SELECT chunk_id AS qid, dense, country, CASE WHEN chunk_id % 200 = 0 THEN doc_type END AS doc_type FROM chunk_vectors WHERE chunk_id % 100 = 0),
d AS MATERIALIZED (SELECT qid, c.chunk_id, list_cosine_similarity(CAST(q.dense AS DOUBLE[]), CAST(c.dense AS DOUBLE[])) AS cosine FROM q JOIN chunk_vectors c ON q.country = c.country AND (q.doc_type IS NULL OR q.doc_type = c.doc_type))
SELECT qid, chunk_id, rk, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cosine, 9) DESC, chunk_id) AS rk FROM d) WHERE rk <= 20""",
    )
)
def dense_topk_filtered(spark, sf_dir):
    v = view(spark, sf_dir, "chunk_vectors")
    q = v.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("qid"), "dense", "country", F.when(F.col("chunk_id") % 200 == 0, F.col("doc_type")).alias("doc_type"))
    return R.dense_topk(q, v).select("qid", "chunk_id", "rk", r6("cosine"))


@query(duck(VT, DENSE + SPARSE + fusion() + " SELECT qid, chunk_id, round(score, 6) AS score FROM f"))
def fused_scores(spark, sf_dir):
    return fused(spark, sf_dir).select("qid", "chunk_id", r6("score"))


@query(duck(VT, ALL + " SELECT qid, parent_id, doc_id, round(score, 6) AS score, n_children FROM p"))
def fold_by_parent(spark, sf_dir):
    return R.fold_by_parent(fused(spark, sf_dir)).select("qid", "parent_id", "doc_id", r6("score"), F.size("children").cast("long").alias("n_children"))


@query(duck(VT, DENSE + SPARSE + fusion() + " SELECT qid, parent_id, row_number() OVER (PARTITION BY qid, parent_id ORDER BY round(score, 9) DESC, chunk_id) AS place, chunk_id, round(score, 6) AS score FROM f"))
def fold_children_exploded(spark, sf_dir):
    c = R.fold_by_parent(fused(spark, sf_dir)).select("qid", "parent_id", F.posexplode("children").alias("place", "c"))
    return c.select("qid", "parent_id", (F.col("place") + 1).cast("long").alias("place"), "c.chunk_id", r6("c.score", "score"))


@query(duck(VT, DENSE + SPARSE + " SELECT q.qid, (SELECT round(max(cosine), 6) FROM d WHERE d.qid = q.qid) AS dense_top_score, (SELECT max(product) FROM s WHERE s.qid = q.qid) AS sparse_top_score FROM q"))
def top_scores_per_question(spark, sf_dir):
    q, asked, v, t = inputs(spark, sf_dir)
    dense, sparse = legs(spark, sf_dir)
    return R.best_score(q, dense).join(sparse.groupBy("qid").agg(F.max("product").alias("sparse_top_score")), "qid", "left").select("qid", r6("dense_top_score"), "sparse_top_score")


@query(duck([*VT, "cases"], DENSE + " SELECT c.qid, c.expected_behavior, round(m.top, 6) AS score FROM cases c LEFT JOIN (SELECT qid, max(cosine) AS top FROM dk GROUP BY 1) m ON m.qid = c.qid"))
def case_scores(spark, sf_dir):
    q, _, v, _ = inputs(spark, sf_dir)
    cases = view(spark, sf_dir, "cases")
    return calibrate.scored(cases, R.best_score(q, R.dense_topk(q, v))).select("qid", "expected_behavior", r6("score"))


@query(duck(VT, DENSE + SPARSE + fusion() + fusion(0.5, 0.5, "g") + " SELECT f.qid, f.chunk_id, round(f.score, 6) AS score_73, round(g.score, 6) AS score_55, round(f.score - g.score, 6) AS difference FROM f JOIN g ON f.qid = g.qid AND f.chunk_id = g.chunk_id"))
def weight_sensitivity(spark, sf_dir):
    both = fused(spark, sf_dir).withColumn("b", scores.fused(F.col("cosine"), F.col("product"), 0.5, 0.5))
    return both.select("qid", "chunk_id", r6("score", "score_73"), r6("b", "score_55"), F.round(F.col("score") - F.col("b"), 6).alias("difference"))


@query(duck(["cases"], " SELECT qid, coalesce(score >= 0.5, false) AS answered FROM cases"))
def gate_outcomes(spark, sf_dir):
    return view(spark, sf_dir, "cases").select("qid", R.gate(F.col("score"), 0.5).alias("answered"))


#: Share of the lists that a question probes. The embeddings table has hardly any clusters, so it is large; where vectors lie in clusters a few lists are enough (tests).
PROBES = 0.75


def inverted_file(spark, sf_dir, share):
    """Hits of the inverted file for a share of its lists, and those of the exact leg."""
    questions, _, vectors, _ = inputs(spark, sf_dir)
    names = ["country", "doc_type", "publisher"]
    centroids = ivf.fit(vectors)
    return questions, vectors, ivf.search(questions, ivf.index(vectors.select("chunk_id", "dense", *names), centroids), centroids, max(1, round(share * len(centroids))))


@query(duck(["chunk_vectors"], DENSE + " SELECT qid, chunk_id, round(cosine, 6) AS cosine, rk FROM dk"))
def ivf_all_lists(spark, sf_dir):
    """Where every list is probed, the inverted file is exact."""
    return inverted_file(spark, sf_dir, 1.0)[2].select("qid", "chunk_id", r6("cosine"), "rk")


@query()
def ivf_recall(spark, sf_dir):
    """Recall at 20 of the inverted file against the exact leg."""
    questions, vectors, found = inverted_file(spark, sf_dir, PROBES)
    return ivf.recall(R.dense_topk(questions, vectors), found)


def postings_of(spark, sf_dir):
    """Questions, their terms, and the index of all chunks with a vector."""
    questions, asked, vectors, terms = inputs(spark, sf_dir)
    return questions, asked, vectors, postings.build(terms, vectors.select("chunk_id", "country", "doc_type", "publisher"))


@query(duck(VT, SPARSE + " SELECT qid, chunk_id, rk, product FROM sk"))
def postings_topk(spark, sf_dir):
    """The sparse leg by the inverted index."""
    questions, asked, _, index = postings_of(spark, sf_dir)
    return postings.search(asked, index, questions=questions.select("qid")).select("qid", "chunk_id", "rk", "product")


@query(
    duck(
        VT,
        """, q AS (SELECT chunk_id AS qid, country, CASE WHEN chunk_id % 200 = 0 THEN doc_type END AS doc_type FROM chunk_vectors WHERE chunk_id % 100 = 0),
s AS MATERIALIZED (SELECT q.qid, b.chunk_id, CAST(sum(a.n * b.n) AS DOUBLE) AS product FROM q JOIN terms a ON a.chunk_id = q.qid JOIN terms b ON a.tok = b.tok JOIN chunk_vectors c ON c.chunk_id = b.chunk_id
    WHERE q.country = c.country AND (q.doc_type IS NULL OR q.doc_type = c.doc_type) GROUP BY 1, 2)
SELECT qid, chunk_id, rk, product FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(product, 9) DESC, chunk_id) AS rk FROM s) WHERE rk <= 40""",
    )
)
def postings_topk_filtered(spark, sf_dir):
    """The same with filters, which come before the limit."""
    _, asked, vectors, index = postings_of(spark, sf_dir)
    questions = vectors.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("qid"), "country", F.when(F.col("chunk_id") % 200 == 0, F.col("doc_type")).alias("doc_type"))
    return postings.search(asked, index, questions=questions).select("qid", "chunk_id", "rk", "product")


@query()
def postings_read(spark, sf_dir):
    """What the bounds leave to score."""
    questions, asked, _, index = postings_of(spark, sf_dir)
    return postings.read(asked, index, questions=questions.select("qid"))

"""Near duplicates by circulant MinHash.

Coordinate k of a signature is the least pi(sigma(x) + k) over the shingles x of a document: one permutation sigma gives each shingle
its place, a second one, pi, is shifted circularly by one place more for each coordinate. Coordinates are banded; sets that share a band
are compared exactly, on their full sets.

Comparisons: every set with the smallest set of each of its bands (a star), then components of the confirmed links, then, in bands
that still hold several components, all pairs of sets from different components, in blocks of bounded size. So a band with any number
of copies costs one comparison a member, while no link between components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, text_key
from .components import components

#: 32 bands of 4 rows: sets of similarity 0.8 share none with probability (1 - 0.8^4)^32 = 5e-8.
BANDS, ROWS = 32, 4
#: Members of a band that one task compares with one another.
BLOCK = 500
STEP = 4096


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; the whole sequence if there are fewer words; empty without words.

    Words are runs of anything but ASCII white space, A-Z in lower case.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    if len(w) < k:
        k = len(w)
    with np.errstate(over="ignore"):
        out = np.full(len(w) - k + 1, 0x9E3779B97F4A7C15 + k, np.uint64)
        for j in range(k):
            out = mix64(out * np.uint64(0x9FB21C651E98DF25) + h[j : len(w) - k + 1 + j])
    return np.unique(out)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(hashes: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """n coordinates (uint32) of a non-empty set."""
    places = (mix64(hashes) >> np.uint64(32)).astype(np.uint32)  # sigma
    shifts = np.arange(n, dtype=np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(places), STEP):
        x = places[i : i + STEP, None] + shifts  # circular: modulo 2^32
        x ^= x >> np.uint32(16)  # pi, a bijection of 32 bits
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(out, x.min(axis=0), out=out)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for c in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
            h = mix64(h * np.uint64(0x9FB21C651E98DF25) + c)
    return h.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Sets:
    """Sets of the texts seen last."""

    def __init__(self, k: int):
        self.k, self.kept = k, {}

    def __call__(self, key: bytes, text: str) -> np.ndarray:
        if (x := self.kept.get(key)) is None:
            if len(self.kept) >= 64:
                self.kept.clear()
            x = self.kept[key] = shingles(text, self.k)
        return x


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs` (doc_id, text); key_ tells rows of one id apart.

    Links: 100 * |intersection| >= percent * |union| on the sets of k-word shingles. Null or empty texts and texts of white space have
    the empty set and no links. component_id: the smallest id reachable; a row without an id counts as larger than all, and its component_id
    is null only if no row reachable has an id. Rows with equal id and text are linked and, if they have the smallest id, all kept.
    Other columns are ignored. An empty table gives no rows.
    """
    spark, stages = docs.sparkSession, Stages(docs.sparkSession, "minhash")
    texts = docs.select("doc_id", text_key(F.col("text")).alias("key_"), "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x, k) for x in batch.column("text").to_pylist()]
            ids = pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary())
            sigs = pa.array([bands(signature(x)) if len(x) else None for x in sets], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("key_"), ids, pa.array(map(len, sets), pa.int64()), sigs], ["doc_id", "key_", "set", "n_shingles", "bands"])

    rows = stages.put(texts.mapInArrow(sign, "doc_id long, key_ long, set binary, n_shingles long, bands array<long>"))
    stages.free()
    # One row for each distinct set, however many documents have it.
    named = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key_")
    sets = stages.put(rows.filter("n_shingles > 0").groupBy("set").agg(F.min(named).alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    member = sets.select("set", "n", F.explode("bands").alias("band"))
    stars = member.groupBy("band").agg(F.min(F.struct("set", "n")).alias("c"), F.count("*").alias("m")).filter("m > 1")
    fits = lambda a, b: F.least(a, b) * 100 >= percent * F.greatest(a, b)
    multi = stages.put(member.join(stars.select("band", "c"), "band"))
    stages.free()
    pairs = stages.put(multi.filter((F.col("set") != F.col("c.set")) & fits(F.col("n"), F.col("c.n"))).select(F.col("set").alias("a"), F.col("c.set").alias("b")).distinct())

    # Texts of the sets that any band joins with another.
    needed = multi.select("set").distinct().join(sets.select("set", "first"), "set").select("set", F.col("first.doc_id").alias("id_"), F.col("first.key_").alias("k_"))
    full = texts.join(needed, (F.col("key_") == F.col("k_")) & F.col("doc_id").eqNullSafe(F.col("id_"))).select("set", "text")
    full = stages.put(full.dropDuplicates(["set"]))
    stages.free()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = Sets(k)
        for batch in batches:
            a, ta, b, tb = (batch.column(c).to_pylist() for c in ("a", "ta", "b", "tb"))
            good = pa.array([similar(get(p, s), get(q, t), percent) for p, s, q, t in zip(a, ta, b, tb, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    linked = stages.put(
        pairs.join(full.select(F.col("set").alias("a"), F.col("text").alias("ta")), "a").join(full.select(F.col("set").alias("b"), F.col("text").alias("tb")), "b").mapInArrow(confirm, "a binary, b binary")
    )
    stages.free()
    labels = components(linked, stages)

    # Bands that still hold several components; bands with the same members count once.
    now = multi.select("band", "set", "n").join(labels.select(F.col("node").alias("set"), "label"), "set", "left").withColumn("label", F.coalesce("label", "set"))

    open_ = now.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"), F.sum(F.xxhash64("set").cast("decimal(38,0)")).alias("h")).filter("lo <> hi")
    open_ = open_.groupBy("m", "h").agg(F.min("band").alias("band")).withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    left = stages.put(now.join(open_.select("band", "blocks"), "band"))
    own = left.withColumn("i", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    # Each block meets each block of its band, itself included, in one task.
    met = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("band", "set", "label", "i", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"))
    met = met.join(full, "set")

    def across(table: pa.Table) -> pa.Table:
        x = table.column("x")[0].as_py()
        y = table.column("y")[0].as_py()
        label, part = table.column("label").to_pylist(), np.array(table.column("i").to_pylist())
        got = [shingles(t, k) for t in table.column("text").to_pylist()]
        size = np.array([len(s) for s in got])
        flat, who = np.concatenate(got), np.repeat(np.arange(len(got)), size)
        _, at, often = np.unique(flat, return_inverse=True, return_counts=True)
        shared = often[at] > 1  # what only one set holds is in no intersection
        at, who = np.unique(at[shared], return_inverse=True)[1], who[shared]
        n = len(got)
        both = np.zeros((n, n), np.float32)
        width = 8192
        for s in range(0, at.max() + 1 if len(at) else 0, width):
            m = np.zeros((n, width), np.float32)
            take = (at >= s) & (at < s + width)
            m[who[take], at[take] - s] = 1
            both += m @ m.T
        both = both.astype(np.int64)
        good = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        _, lab = np.unique([bytes(v).hex() for v in label], return_inverse=True)
        good &= (lab[:, None] < lab[None, :]) & ((part[:, None] != part[None, :]) | (x == y))
        p, q = np.nonzero(good)
        # One link for each two components is enough.
        pick = np.unique(lab[p].astype(np.int64) * n + lab[q], return_index=True)[1]
        return pa.table({"a": pa.array([label[i] for i in p[pick]], pa.binary()), "b": pa.array([label[i] for i in q[pick]], pa.binary())})

    more = met.groupBy("band", "x", "y").applyInArrow(across, "a binary, b binary").distinct()
    labels = components(linked.unionByName(stages.put(more)), stages)
    per_set = stages.put(sets.select("set", F.col("first.doc_id").alias("low")).join(labels.select(F.col("node").alias("set"), "label"), "set", "left").withColumn("label", F.coalesce("label", "set")))
    # Written: joins of tables have a plain shuffle on both sides, and Spark can split a hot component's rows.
    ids = stages.put(per_set.groupBy("label").agg(F.min("low").alias("component_id")))
    named_sets = per_set.join(ids, "label").select("set", "component_id")
    out = rows.drop("bands").join(named_sets, "set", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "key_")


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4).drop("key_")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
c(root, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.root, e.b FROM c JOIN e ON e.a = c.node),
m AS (SELECT root AS doc_id, min(node) AS component_id FROM c GROUP BY root)
SELECT m.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""

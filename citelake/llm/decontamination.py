"""Benchmark decontamination by SimHash windows, in DataFrame functions only.

A document's windows have the size in words of a benchmark item; a document with fewer words than the item has one window, its whole text. Windows and items have 64-bit SimHash fingerprints of their weighted five-word shingles
(weight: occurrences). A multi-index over RADIUS + 1 blocks of bits finds the pairs: within the radius at least one block is equal, so windows and items
of one size are joined on (block, its bits), which misses no pair within RADIUS. What is left is verified by weighted Jaccard similarity on the shingles.

Which windows are fingerprinted: of an item with m shingles and a window with v, c in common, the similarity is c / (m + v - c), so a similar window has at least
percent (m + v) / (100 + percent) places whose shingle is one of the item's. Every window with so many places for any item is fingerprinted, wherever in the text
and in whatever order its parts stand; no other window can be similar. Texts with no shingle of any item have no windows. Shared shingles are joined by hash: the benchmark side is
broadcast if Spark's own size check allows it, else both are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, ascii_lower, run_hashes, text_key, words

SHINGLE = 5
#: 64-bit fingerprints at similarity 0.8 differ in about 10 bits, of items of five shingles in 12; in more than 24 with a probability of 5e-5 there, and less for longer items.
RADIUS = 24


def short_hashes(w: Column, size: int) -> Column:
    """Hashes of the runs of `size` words, in order; none if there are fewer."""
    n = F.size(w)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.slice(w, i, size)))).otherwise(F.array().cast("array<long>"))


def with_shingles(d: DataFrame) -> DataFrame:
    """Adds shingles to rows with an array of words w: hashes of the five-word shingles, in order; of the whole sequence if it is shorter; none if it is empty."""
    d = run_hashes(d.withColumn("hash_", F.transform("w", lambda x: F.xxhash64(x))), "hash_", "runs_", SHINGLE)
    n = F.size("w")
    return d.withColumn("shingles", F.when((n > 0) & (n < SHINGLE), F.array(F.xxhash64("w"))).otherwise(F.col("runs_"))).drop("hash_", "runs_")


def fingerprint(h: Column) -> Column:
    """SimHash: bit b is set if more shingles have it than not; equal shares leave it unset."""
    one = F.lit(1).cast("long")
    with_bit = lambda b: F.size(F.filter(h, lambda x: F.call_function("shiftright", x, b).bitwiseAND(one) == one))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: F.when(2 * with_bit(b) > F.size(h), a.bitwiseOR(F.call_function("shiftleft", one, b))).otherwise(a))


def bit_blocks(x: Column, radius: int = RADIUS) -> list[Column]:
    """radius + 1 blocks of a fingerprint, each of 2 or 3 bits for 64 bits and radius 24."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [F.shiftrightunsigned(x, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")) for a, b in zip(edges, edges[1:], strict=False)]


def counted(h: Column) -> Column:
    """Sorted hashes with their number of occurrence: equal multisets become equal sets, and set sizes weigh by occurrences."""
    s = F.sort_array(h)
    return F.transform(s, lambda x, i: F.struct(x.alias("h"), (i - F.array_position(s, x) + 1).cast("int").alias("k")))


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, item_id, start, similarity, distance: the best window of each document for each `benchmark` (item_id, text) item that it holds; key_ tells rows of one id apart.

    Words are between ASCII white space, A-Z in lower case; items with fewer than five words are one shingle and match such a run of words.
    A match has a weighted Jaccard similarity of `percent` or more. Of equal windows the first is given. Null or empty texts and items match nothing. Equal items
    match each; repeated rows give one. A document shorter than the item is compared as a whole, with start 0. Other columns are ignored.
    """
    stages = Stages(docs.sparkSession, "decontamination")
    items = with_shingles(benchmark.select("item_id", words(ascii_lower(F.col("text"))).alias("w")).filter(F.size("w") > 0))
    items = stages.put(items.select("item_id", F.size("w").alias("n"), F.col("shingles").alias("item")).withColumn("print", fingerprint(F.col("item"))))
    short = sorted(x["n"] for x in items.filter(F.col("n") < SHINGLE).select("n").distinct().collect())  # at most 4 values
    seeds = items.select("item_id", "n", F.size("item").alias("m"), F.explode(F.array_distinct("item")).alias("h"))
    d = with_shingles(docs.select("doc_id", text_key(F.col("text")).alias("key_"), words(ascii_lower(F.col("text"))).alias("w")).filter(F.size("w") > 0))
    hashes = [F.struct(F.lit(SHINGLE).alias("size"), F.col("shingles").alias("h"))]
    hashes += [F.struct(F.lit(k).alias("size"), short_hashes(F.col("w"), k).alias("h")) for k in short]
    at = d.select("doc_id", "key_", F.size("w").alias("words"), F.explode(F.array(*hashes)).alias("x")) if short else d.select("doc_id", "key_", F.size("w").alias("words"), hashes[0].alias("x"))
    at = at.select("doc_id", "key_", "words", F.col("x.size").alias("size"), F.posexplode("x.h").alias("p", "h"))
    hits = at.join(seeds, "h").filter(F.col("size") == F.least(F.col("n"), F.lit(SHINGLE)))
    # Places of each item's shingles in order; a window holds `need` of them if it begins no later than the first of so many in a row and ends no sooner than the last.
    begins = hits.groupBy("doc_id", "key_", "item_id", "n", "size", "m", "words").agg(F.sort_array(F.collect_set("p")).alias("at"))  # at most one for each word of the text
    inside = F.least(F.col("n"), F.col("words")) - F.col("size") + 1  # shingles of a window
    begins = begins.withColumn("need", F.greatest(F.ceil(percent * (F.col("m") + inside) / (100 + percent)), F.lit(1)).cast("int")).filter(F.size("at") >= F.col("need"))
    last = F.greatest(F.col("words") - F.col("n"), F.lit(0))  # a text shorter than the item begins at 0 only
    runs = F.transform(F.slice("at", F.lit(1), F.size("at") - F.col("need") + 1), lambda x, i: F.struct(F.greatest(F.get("at", i + F.col("need") - 1) - inside + 1, F.lit(0)).alias("a"), F.least(x, last).alias("b")))
    starts = F.array_distinct(F.flatten(F.transform(F.filter(runs, lambda x: x["a"] <= x["b"]), lambda x: F.sequence(x["a"], x["b"]))))
    places = begins.select("doc_id", "key_", "n", F.explode(starts).alias("start")).distinct()
    places = stages.put(places.groupBy("doc_id", "key_").agg(F.collect_list(F.struct("n", "start")).alias("places")))
    stages.free()

    # Texts are read again for the documents with windows only.
    left = docs.select(F.col("doc_id").alias("id_"), text_key(F.col("text")).alias("k_"), "text").dropDuplicates(["id_", "k_"])
    texts = left.join(places, F.col("id_").eqNullSafe(F.col("doc_id")) & (F.col("k_") == F.col("key_"))).select("doc_id", "key_", "places", words(ascii_lower(F.col("text"))).alias("w"))
    place = lambda p: F.struct(
        p["n"].alias("n"), p["start"].alias("start"),
        F.when(p["n"] >= SHINGLE, F.slice("shingles", p["start"] + 1, F.greatest(F.least(p["n"], F.size("w")) - SHINGLE + 1, F.lit(1)))).otherwise(F.array(F.xxhash64(F.slice("w", p["start"] + 1, p["n"])))).alias("window"),
    )
    windows = with_shingles(texts).select("doc_id", "key_", F.explode(F.transform("places", place)).alias("x")).select("doc_id", "key_", "x.n", "x.start", "x.window")
    # Written, or the plan would compute the fingerprint anew wherever it is named.
    windows = stages.put(windows.withColumn("window_print", fingerprint(F.col("window"))))
    stages.free()

    blocks = lambda c: F.posexplode(F.array(*bit_blocks(F.col(c)))).alias("block", "bits")
    index = items.select("item_id", "n", "print", blocks("print"))
    pairs = windows.select("doc_id", "key_", "n", "start", "window_print", blocks("window_print")).join(index, ["n", "block", "bits"])
    pairs = pairs.withColumn("differ", F.col("print").bitwiseXOR(F.col("window_print"))).withColumn("distance", F.bit_count("differ")).filter(F.col("distance") <= RADIUS)
    # A pair counts at the first of its equal blocks.
    pairs = pairs.filter(F.array_position(F.array(*bit_blocks(F.col("differ"))), F.lit(0).cast("long")) == F.col("block") + 1).select(F.col("doc_id").alias("id_"), F.col("key_").alias("k_"), F.col("n").alias("n_"), F.col("start").alias("s_"), "item_id", "distance")
    own = windows.join(pairs, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("key_") == F.col("k_")) & (F.col("n") == F.col("n_")) & (F.col("start") == F.col("s_"))).select("doc_id", "key_", "start", "window", "item_id", "distance").join(items.select("item_id", "item"), "item_id")
    own = own.withColumn("common", F.size(F.array_intersect(counted(F.col("item")), counted(F.col("window"))))).withColumn("all", F.size("item") + F.size("window") - F.col("common"))
    own = own.filter(100 * F.col("common") >= percent * F.col("all"))
    best = own.groupBy("doc_id", "key_", "item_id").agg(F.max(F.struct((F.col("common") / F.col("all")).alias("similarity"), (-F.col("start")).alias("s"), "distance")).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.s")).cast("long").alias("start"), F.col("m.similarity").alias("similarity"), F.col("m.distance").cast("long").alias("distance"), "key_")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("key_")

"""Shards by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups of equal texts are the items. A group goes to the shard where the dot product of its (bytes, tokens, rows)
with the shard's residual capacity is highest. Heavy items are few by their definition and are placed first, on the
driver; the rest are dealt by digest into blocks of bounded size, and each block packs its items into its share of
every shard's residual capacity, largest first, so blocks are independent and their errors stay as small as their last items. As the law is on
bytes, each block then exchanges items of as many rows between its fullest and its emptiest shard, which leaves rows as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages, blocks_for, words

#: An item is heavy from this part of a shard's fair share in any measure, so there are at most 3 * 64 heavy items a shard.
HEAVY = 1 / 64
#: A group over this part of a shard's fair share is split.
SPLIT = 1 / 2
#: Weights of bytes, tokens and rows in the dot product: the law is on bytes.
WEIGHTS = np.array([4.0, 1.0, 1.0])
#: Exchanges in a block for each shard, at most, and the spread of bytes, in parts of a shard, at which they end.
EXCHANGES, TOLERANCE = 8, 1e-3
#: Items that one task packs.
BLOCK_ITEMS = 20_000
MEASURES = ["b", "t", "r"]


def place(items: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Shard of each item, by the highest dot product with the residual capacity; both in parts of the total.

    items: n x 3, placed from the largest share in any measure to the smallest, ties in the given order; capacity: shards x 3.
    """
    left, out = capacity.astype(float).copy(), np.zeros(len(items), np.int32)
    pull = items * WEIGHTS
    for i in np.argsort(-items.max(axis=1), kind="stable") if len(items) else ():
        k = int(np.argmax(left @ pull[i]))
        out[i] = k
        left[k] -= items[i]
    return even(items, left, out)


def even(items: np.ndarray, left: np.ndarray, out: np.ndarray) -> np.ndarray:
    """`out` after exchanges of two items with equal rows between the shards with the least and the most bytes left, while that evens bytes; left: what `out` leaves."""
    members = [np.nonzero(out == k)[0] for k in range(len(left))]
    for _ in range(EXCHANGES * len(left)):
        full, empty = int(left[:, 0].argmin()), int(left[:, 0].argmax())
        gap = left[empty] - left[full]
        a, b = members[full], members[empty]
        if gap[0] <= TOLERANCE / len(left) or not len(a) or not len(b):
            break
        more = items[a][:, None] - items[b][None]
        fits = (more[..., 2] == 0) & (more[..., 0] > 0) & (more[..., 0] < gap[0])
        if not fits.any():
            break
        # The best exchange halves the gap in bytes; of like ones the one that does most for tokens.
        i, j = np.unravel_index(np.argmin(np.where(fits, WEIGHTS[0] * np.abs(more[..., 0] - gap[0] / 2) + WEIGHTS[1] * np.abs(more[..., 1] - gap[1] / 2), np.inf)), fits.shape)
        left[full] += more[i, j]
        left[empty] -= more[i, j]
        out[a[i]], out[b[j]] = empty, full
        members[full], members[empty] = np.append(np.delete(a, i), b[j]), np.append(np.delete(b, j), a[i])
    return out


def shard(docs: DataFrame, shards: int = 40, slot_parts: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of `docs` (doc_id, text).

    Law `bytes`: sizes near equal. Rows of a group stay together, but a group over half a shard's fair share of bytes, tokens
    or rows is split by a hash of the ids into pieces of about that size or less. Null text: no bytes, and a group with the empty text. Rows with
    the same id and text cannot be told apart and stay together. Slots run from 0 in each shard without gaps. Empty table: no rows.
    """
    spark, stages = docs.sparkSession, Stages(docs.sparkSession, "sharding")
    text = F.coalesce("text", F.lit(""))
    rows = stages.put(docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("group"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.size(words(text)).cast("long").alias("tokens")))
    groups = rows.groupBy("group").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r"))
    total = groups.agg(*(F.sum(c).alias(c) for c in MEASURES), F.count("*").alias("n")).first()
    totals = [max(1, total[c] or 0) for c in MEASURES]
    share = F.greatest(*(F.col(c) / (n / shards) for c, n in zip(MEASURES, totals, strict=True)))
    # Bounded: the shares of all groups sum to at most 3 * shards, and each of these has more than SPLIT.
    large = groups.withColumn("parts", F.ceil(share / SPLIT)).filter((share > SPLIT) & (F.col("r") > 1)).select("group", "parts")
    pieces = rows.join(F.broadcast(large), "group", "left").withColumn("piece", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts"))).cast("int")).drop("parts")
    items = stages.put(pieces.groupBy("group", "piece").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")))

    big = [(bytes(x["group"]), x["piece"], *(x[c] for c in MEASURES)) for x in items.filter(share > HEAVY).orderBy("group", "piece").collect()]
    vectors = np.array([x[2:] for x in big], float).reshape(-1, 3) / totals
    at = place(vectors, np.full((shards, 3), 1 / shards))
    left = np.full((shards, 3), 1 / shards)
    np.subtract.at(left, at, vectors)
    rest = np.maximum(1 - vectors.sum(axis=0), 1e-12)
    n_blocks = blocks_for(total["n"], BLOCK_ITEMS)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("group", "ascending"), ("piece", "ascending")])
        v = np.column_stack([table.column(c).to_numpy() for c in MEASURES]) / np.array(totals, float)
        turn = table.column("block")[0].as_py() % shards  # blocks differ in which shard wins ties
        own = np.roll(left * (v.sum(axis=0) / rest), -turn, axis=0)
        return pa.table({"group": table.column("group"), "piece": table.column("piece"), "shard": pa.array((place(v, own) + turn) % shards, pa.int32())})

    light = items.filter(~(share > HEAVY)).withColumn("block", F.pmod(F.xxhash64("group"), F.lit(n_blocks))).groupBy("block").applyInArrow(pack, "group binary, piece int, shard int")
    placed = [(bytearray(g), p, int(k)) for (g, p, *_), k in zip(big, at, strict=True)]
    hot = F.broadcast(spark.createDataFrame(placed, "group binary, piece int, shard int"))
    known = pieces.join(hot, ["group", "piece"], "left")
    done = known.filter(F.col("shard").isNotNull()).unionByName(known.filter(F.col("shard").isNull()).drop("shard").join(stages.put(light), ["group", "piece"]))

    # Slots: rows are numbered within parts of a shard, after the counts of the parts before.
    parts = slot_parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    done = stages.put(done.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "group"), F.lit(parts)).cast("int").alias("part")))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = done.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    slots = done.withColumn("row", F.row_number().over(within)).join(starts, ["shard", "part"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("row") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Conflict-constrained best-fit packing of documents into fixed token budgets.

Open bins are kept in the order of their residual. For a document the search begins at the smallest residual that holds it, its successor
in that order, and goes on to the next larger one until the bin's source and duplicate-cluster bitmaps share no bit with the
document's: the tightest compatible bin. Without one a new bin is opened. Documents are dealt by a hash of their row numbers into blocks of bounded size, each packed by one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Stages, ascii_lower, blocks_for, text_key, words

CAPACITY = 2048
#: Documents of one block.
BLOCK_DOCS = 8192


class Bins:
    """Open bins of one block. Bits are given to sources and clusters as they come, so equal bits mean equal values."""

    def __init__(self, capacity: int):
        self.capacity, self.order, self.opened = capacity, [], 0
        self.bits: dict[str, dict[object, int]] = {"source": {}, "cluster": {}}
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def bit(self, kind: str, value: object) -> int:
        """0, no conflict, for null."""
        return 0 if value is None else 1 << self.bits[kind].setdefault(value, len(self.bits[kind]))

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset of the document in it)."""
        i = bisect_left(self.order, (size, -1))
        while i < len(self.order):
            left, k = self.order[i]
            if not (self.sources[k] & source or self.clusters[k] & cluster):
                del self.order[i]
                break
            i += 1
        else:
            left, k = self.capacity, self.opened
            self.opened += 1
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[k] |= source
        self.clusters[k] |= cluster
        if left > size:
            insort(self.order, (left - size, k))
        return k, self.capacity - left


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of the rows of `docs` (doc_id, text, source): doc_id, piece, n_tokens, start, bin, offset.

    Tokens are words between ASCII white space; start is the piece's first one in its document. A bin holds at most `capacity` tokens, no two
    documents of one source and no two of one duplicate cluster (equal but for case and white space); null sources do not conflict. A
    document over the capacity is cut into full pieces, which fill bins of their own, and a rest. Documents without tokens have
    one piece of 0 tokens. Larger pieces go first, ties by id. Repeated rows are packed each; row numbers, not contents, deal out blocks, so they spread. Bins are numbered within
    blocks: bin is `block-number`. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "source", text_key(F.col("text")).alias("key_"), F.size(words(F.col("text"))).cast("long").alias("n"), F.xxhash64(F.trim(F.regexp_replace(ascii_lower(F.coalesce("text", F.lit(""))), SPACE, " "))).alias("cluster"), F.monotonically_increasing_id().alias("row_"))
    rows = Stages(docs.sparkSession, "packing").put(rows)
    blocks = blocks_for(rows.count(), BLOCK_DOCS)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row_"), F.lit(blocks)))

    def fill(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        items, out = [], []
        names = ("doc_id", "key_", "source", "n", "cluster")
        bins = Bins(capacity)
        for doc, key, source, n, cluster in zip(*(table.column(c).to_pylist() for c in names), strict=True):
            full = max(0, -(-n // capacity) - 1) if n > capacity else 0
            for p in range(full):
                out.append((doc, p, capacity, p * capacity, f"{block}-{bins.opened}", 0))
                bins.opened += 1
                bins.sources.append(-1)
                bins.clusters.append(-1)
            items.append((-(n - full * capacity), doc is None, doc or 0, key, full, source, cluster))
        items.sort(key=lambda x: x[:5])
        for size, none, doc, _, p, source, cluster in items:
            k, at = bins.put(-size, bins.bit("source", source), bins.bit("cluster", cluster))
            out.append((None if none else doc, p, -size, p * capacity, f"{block}-{k}", at))
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "piece", "n_tokens", "start", "bin", "offset"])

    return rows.groupBy("block").applyInArrow(fill, "doc_id long, piece int, n_tokens long, start long, bin string, offset long")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Quality of parsed documents: ratios over blocks and the gate on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import GARBAGE

# Fixed value: block types whose short texts count as fragments.
BODY = ("paragraph", "list_item", "table")


@dataclass(frozen=True)
class Thresholds:
    """Bounds of the gate; each comparison is strict."""

    min_chars: int = 200
    max_garbage: float = 0.01
    max_fragments: float = 0.20
    max_duplicates: float = 0.25
    fragment_length: int = 10


def assess(blocks: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """One row for each doc_id of `blocks` (doc_id, type, text): counts, ratios and the list of every failed bound.

    total_chars is the length of the texts joined by newlines. Every copy of a repeated text counts as a duplicate. No body block: no fragments; no characters: all garbage.
    """
    b = blocks.withColumn("copies", F.count("*").over(Window.partitionBy("doc_id", "text")))
    body = F.col("type").isin(*BODY)
    m = b.groupBy("doc_id").agg(
        (F.sum(F.length("text")) + F.count("*") - 1).cast("long").alias("total_chars"),
        F.count("*").alias("blocks"),
        F.count_if(F.col("type") == "heading").alias("headings"),
        F.sum(F.regexp_count("text", F.lit(GARBAGE))).cast("long").alias("garbage"),
        F.coalesce(F.count_if(body & (F.length("text") < limits.fragment_length)) / F.nullif(F.count_if(body), F.lit(0)), F.lit(0.0)).alias("fragment_ratio"),
        (F.count_if(F.col("copies") > 1) / F.count("*")).alias("duplicate_ratio"),
    )
    m = m.withColumn("garbage_ratio", F.coalesce(F.col("garbage") / F.nullif("total_chars", F.lit(0)), F.lit(1.0))).drop("garbage")
    failed = [("chars", F.col("total_chars") < limits.min_chars), ("garbage", F.col("garbage_ratio") > limits.max_garbage), ("fragments", F.col("fragment_ratio") > limits.max_fragments), ("duplicates", F.col("duplicate_ratio") > limits.max_duplicates)]
    m = m.withColumn("failures", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in failed))))
    return m.withColumn("passed", F.size("failures") == 0)

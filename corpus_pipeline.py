"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.llm import decontamination, minhash, packing, quality_rules, suffix_dedup
from citelake.llm.common import Stages, text_key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id; of rows equal in id and text, one."""
    kept = minhash.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("id_"), F.col("key_").alias("k_")).distinct()
    rows = docs.withColumn("key_", text_key(F.col("text"))).dropDuplicates(["doc_id", "key_"])
    return rows.join(kept, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("key_") == F.col("k_")), "left_semi").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of passages of 200 bytes or more are cut out where they are not the first; documents with nothing left go."""
    cut = suffix_dedup.dedup(docs).filter(F.col("n_removed") > 0).select(F.col("doc_id").alias("id_"), F.col("key_").alias("k_"), "kept_text").distinct()
    rows = docs.withColumn("key_", text_key(F.col("text"))).join(cut, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("key_") == F.col("k_")), "left")
    text = F.when(F.col("id_").isNull() & F.col("k_").isNull(), F.col("text")).otherwise(F.col("kept_text"))
    changed = F.col("k_").isNotNull()
    out = rows.filter(~changed | (F.trim("kept_text") != "")).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontamination.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("id_"), F.col("key_").alias("k_")).distinct()
    rows = docs.withColumn("key_", text_key(F.col("text")))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("key_") == F.col("k_")), "left_anti").select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of 2,048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", best_fit_packing),
]
#: Suffix order, components and packing are not expressible; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stages.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

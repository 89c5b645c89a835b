"""Import decisions: what an incoming document is to the registry, and what becomes of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fields whose change alone makes an update, and fields a document needs before it is indexed, in order.
COMPARED = ("title", "source_url", "publisher", "country", "doc_type", "effective_date", "platform")
REQUIRED = ("source_url", "publisher", "country", "doc_type")


def decide(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """`incoming` with action, matched_id and previous_id.

    Same content hash: REINDEX unless indexed, UPDATE_META if a compared field that both have differs (null-safe), else SKIP. No such hash: SUPERSEDE_AND_NEW
    if an indexed document has the URL, else NEW. Of several matches the smallest id counts. A null URL matches nothing.
    """
    fields = [c for c in COMPARED if c in incoming.columns and c in registry.columns]
    by_hash = registry.groupBy("content_hash").agg(F.min_by(F.struct(F.col("doc_id").alias("matched_id"), "status", *fields), "doc_id").alias("m"))
    by_url = registry.filter("status = 'indexed' and source_url is not null").groupBy("source_url").agg(F.min("doc_id").alias("url_id"))
    out = incoming.join(by_hash, "content_hash", "left").join(by_url, "source_url", "left")
    changed = F.lit(False)
    for c in fields:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"m.{c}"))
    hit = F.col("m").isNotNull()
    action = F.when(hit & (F.col("m.status") != "indexed"), "REINDEX").when(hit & changed, "UPDATE_META").when(hit, "SKIP").when(F.col("url_id").isNotNull(), "SUPERSEDE_AND_NEW").otherwise("NEW")
    return out.select(*incoming.columns, action.alias("action"), F.col("m.matched_id").alias("matched_id"), F.when(~hit, F.col("url_id")).alias("previous_id"))


def in_batch(incoming: DataFrame, order: str = "line_number") -> DataFrame:
    """Adds hash_rank and last_of_url: within a batch only the first row of a hash is new, and only the last row of a URL stays active."""
    h = Window.partitionBy("content_hash").orderBy(order)
    u = Window.partitionBy("source_url").orderBy(F.col(order).desc())
    return incoming.withColumn("hash_rank", F.row_number().over(h).cast("long")).withColumn("last_of_url", F.col("source_url").isNull() | (F.row_number().over(u) == 1))


def missing_fields(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> Column:
    """Names of required columns that are null, in fixed order; a column the table lacks counts as null."""
    return F.array_compact(F.array(*((F.when(F.col(c).isNull(), F.lit(c))) if c in df.columns else F.lit(c) for c in required)))


def siblings(registry: DataFrame, kept: DataFrame) -> DataFrame:
    """Ids of other indexed documents with the URL of a kept document (doc_id, source_url): they become superseded."""
    k = kept.filter("source_url is not null").select("source_url", F.col("doc_id").alias("keep_id"))
    return registry.filter("status = 'indexed'").join(k, "source_url").filter("doc_id <> keep_id").select("doc_id").distinct()


def orphans(registry: DataFrame, known_paths: DataFrame) -> DataFrame:
    """Active documents whose file is neither found nor reported missing: a report, nothing is deleted."""
    return registry.filter("status = 'indexed'").join(known_paths.select("raw_path").distinct(), "raw_path", "left_anti")


def split_found(manifest: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their file, rows without one) by raw_path."""
    return manifest.join(files, "raw_path"), manifest.join(files, "raw_path", "left_anti")

"""Rewrites of chunk, vector and registry tables: each returns the table's new content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace(table: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """All rows of the keys in `new` are replaced by its rows."""
    return table.join(new.select(key).distinct(), key, "left_anti").select(table.columns).unionByName(new.select(table.columns))


def upsert(table: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Whole rows by primary key; an empty `new` changes nothing."""
    return replace(table, new, key)


def delete(table: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti").select(table.columns)


def sync(table: DataFrame, documents: DataFrame, columns: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    """Filter columns of a document's rows take its new values, null as ''; rows of other documents stay."""
    d = documents.select(F.col(key).alias("key_"), F.lit(True).alias("hit_"), *(F.coalesce(c, F.lit("")).alias(f"new_{c}") for c in columns))
    out = table.join(d, table[key] == d["key_"], "left")
    return out.select(*(F.when(F.col("hit_"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns))


def set_status(registry: DataFrame, new: DataFrame) -> DataFrame:
    """`new` (doc_id, status and, where they were tried, attempts): attempts stay as they are unless given."""
    n = new.select(F.col("doc_id").alias("key_"), F.col("status").alias("status_"), *([F.col("attempts").alias("attempts_")] if "attempts" in new.columns else []))
    out = registry.join(n, registry["doc_id"] == n["key_"], "left").withColumn("status", F.coalesce("status_", "status"))
    if "attempts" in new.columns and "attempts" in registry.columns:
        out = out.withColumn("attempts", F.coalesce("attempts_", "attempts"))
    return out.select(registry.columns)


def drift(have: DataFrame, want: DataFrame) -> list[tuple[str, str]]:
    """(column, missing | extra | type | comment) where two schemas differ; extra columns are only reported, never dropped."""
    a, b = dict(have.dtypes), dict(want.dtypes)
    notes = [{f.name: f.metadata.get("comment", "") for f in d.schema} for d in (have, want)]
    out = [(c, "missing") for c in b if c not in a] + [(c, "extra") for c in a if c not in b] + [(c, "type") for c in b if c in a and a[c] != b[c]]
    return out + [(c, "comment") for c in b if c in a and notes[0][c] != notes[1][c]]


def align(spark: SparkSession, tables: dict[str, str]) -> list[tuple[str, str, str]]:
    """Brings tables (name: columns as DDL, with comments) to what is declared: (table, column, added | comment | type | extra) for each difference there was.

    Columns that lack are added, with nulls in the rows that are there, and comments are changed. Another type and extra columns are only reported: rows would have to be written anew, and nothing is ever dropped.
    A second run changes nothing. Tables that don't exist are left to `create`.
    """
    done = []
    for name, ddl in tables.items():
        if not spark.catalog.tableExists(name):
            continue
        want = spark.createDataFrame([], ddl)
        fields = {f.name: f for f in want.schema}
        for column, what in drift(spark.table(name), want):
            note = fields[column].metadata.get("comment", "").replace("\\", "\\\\").replace("'", "\\'") if column in fields else ""
            if what == "missing":
                spark.sql(f"ALTER TABLE {name} ADD COLUMNS (`{column}` {fields[column].dataType.simpleString()} COMMENT '{note}')")
            elif what == "comment":
                spark.sql(f"ALTER TABLE {name} ALTER COLUMN `{column}` COMMENT '{note}'")
            done.append((name, column, "added" if what == "missing" else what))
    return done


def create(spark: SparkSession, tables: dict[str, str], form: str = "parquet") -> list[str]:
    """Create the tables (name: columns as DDL) that do not exist; the names of those that were made."""
    new = [name for name in tables if not spark.catalog.tableExists(name)]
    for name in new:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({tables[name]}) USING {form}")
    return new


def seed(have: DataFrame, rows: DataFrame, key: str = "code") -> DataFrame:
    """A dimension table's new content: rows of the seed replace those with their code, others stay."""
    return replace(have, rows, key)


#: Columns of the vector collection. Search over it is exact, so it has no index of its own.
VECTORS = "chunk_id string, doc_id string, parent_id string, chunk_index bigint, country string, doc_type string, publisher string, dense array<float>, sparse map<bigint, float>"


def create_vectors(spark: SparkSession, name: str) -> bool:
    """Create the vector collection; False if it exists."""
    return bool(create(spark, {name: VECTORS}))

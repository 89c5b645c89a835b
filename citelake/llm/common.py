"""What the training-data operators share: the shared folder, stage tables and a few native expressions."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define it: words are runs of anything else.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where that is unset and Spark runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="citelake-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Stages:
    """Stage tables of one operator call, as Parquet in the shared folder.

    A written table cuts lineage, outlives executors and, since nothing refers to the plans before it, lets Spark
    delete their shuffle files.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self) -> None:
        """Let Spark delete the shuffle files of plans that no Python name refers to any more."""
        for _ in range(2):  # Python's references end first, then the JVM's
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.3)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, df: DataFrame) -> None:
        """Delete a stage table that no later plan reads."""
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """Words of a text; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def run_hashes(d: DataFrame, h: str, out: str, size: int) -> DataFrame:
    """Adds `out`: a hash of each `size` neighbours of the array of hashes `h`, from hashes of half as many; none if there are fewer."""
    cur, have = h, 1
    while have < size:
        step = min(have, size - have)
        m = F.greatest(F.size(cur) - step, F.lit(0))
        d = d.withColumn(out, F.zip_with(F.slice(cur, 1, m), F.slice(cur, step + 1, m), lambda x, y: F.xxhash64(x, y)))
        cur, have = out, have + step
    return d.withColumn(out, F.when(F.size(h) >= size, F.col(out)).otherwise(F.array().cast("array<long>")))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def id_hash(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.length(text))


def blocks_for(total: int, each: int) -> int:
    return max(1, -(-int(total or 0) // each))

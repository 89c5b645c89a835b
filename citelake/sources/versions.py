"""Several tables that change together: versions with a staged write and one swap.

A store is a folder. Rows lie in buckets by a hash of their table's key, each bucket of a version in a folder of its own. A version is a small file with a
number, which names the folder of each bucket of each table; the highest number is the current version. A change writes the
touched buckets anew under a new name, whatever happens to it, and takes effect for all tables at once when the version's file gets its name. Readers hold on to
the version that they began with. A write that dies before leaves folders that no version names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import spread

BUCKET = "bucket_"
#: Parts of a bucket, each written by one task.
PARTS = 8


class Conflict(RuntimeError):
    """Another writer has made a version since this change was staged."""


@dataclass(frozen=True)
class Staged:
    """A change that is written and not yet seen by readers."""

    number: int
    manifest: dict


class Store:
    """Tables of one store. tables: {name: (columns as DDL, key column)}."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[str, str]], buckets: int = 64):
        self.spark, self.root, self.tables, self.buckets = spark, root.rstrip("/"), tables, buckets
        jvm = spark._jvm
        self.Path, self.files = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(self.path("").toString()), spark._jsc.hadoopConfiguration())

    def path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *filter(None, parts)]))

    def current(self) -> int:
        """The number of the current version; 0: there is none yet."""
        try:
            found = self.files.util().listStatus(self.path("versions"))
        except Exception as e:
            if "FileNotFoundException" not in str(e):
                raise
            return 0
        return max([int(f.getPath().getName()) for f in found if f.getPath().getName().isdigit()], default=0)

    def manifest(self, number: int) -> dict:
        """{"buckets": number of buckets, "tables": {name: {bucket: folder}}}."""
        if not number:
            return {"buckets": self.buckets, "tables": {name: {} for name in self.tables}}
        text = self.spark.read.text(self.path("versions", f"{number:012d}").toString(), wholetext=True).first()[0]
        return json.loads(text)

    def read(self, name: str, number: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table as it is in a version, the current one unless a number is given; of some buckets only if they are given."""
        schema, _ = self.tables[name]
        known = self.manifest(self.current() if number is None else number)["tables"].get(name, {})
        folders = [f"{self.root}/{folder}/{BUCKET}={b}" for b, folder in known.items() if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def lookup(self, name: str, keys: DataFrame, number: int | None = None) -> DataFrame:
        """Rows of the keys in `keys`; only their buckets are read."""
        key = self.tables[name][1]
        found = [r[0] for r in keys.select(self.bucket(F.col(key))).distinct().collect()]  # no more than there are buckets
        return self.read(name, number, found).join(spread(keys.select(key).distinct()), key, "left_semi")

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def merged(self, old: DataFrame, new: DataFrame | None, keys: DataFrame, columns: list[str], key: str) -> DataFrame:
        """`old` without the rows of `keys`, and `new`, each with its bucket and dealt out by it. Old rows, new rows and keys meet in one shuffle, in parts of a bucket."""
        mark = lambda d, n: d.withColumn("mark_", F.lit(n))
        rows = mark(old.select(columns), 0).unionByName(mark(keys.select(key), 2), allowMissingColumns=True)
        rows = rows.unionByName(mark(new.select(columns), 1)) if new is not None else rows
        rows = self.dealt(rows, key).withColumn("most_", F.max("mark_").over(Window.partitionBy(BUCKET, "part_", key)))
        return rows.filter((F.col("mark_") == 1) | ((F.col("mark_") == 0) & ((F.col("most_") == 0) | F.col(key).isNull()))).select(*columns, BUCKET)

    def dealt(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows by bucket, each bucket in `PARTS` parts of whole keys."""
        part = F.pmod(F.shiftright(F.xxhash64(F.col(key).cast("string")), 32), F.lit(PARTS)).cast("int")
        return rows.withColumn(BUCKET, self.bucket(F.col(key))).withColumn("part_", part).repartition(BUCKET, "part_")

    def stage(self, changes: dict[str, tuple[DataFrame | None, ...]]) -> Staged:
        """Writes a change: {table: (new rows, keys that go)}. All rows of a key in either are replaced by the new ones; untouched buckets are taken over as they are.

        Whoever knows all these keys without working out the new rows gives them third.
        """
        number, name_of_change = self.current(), f"data/{uuid.uuid4().hex}"
        manifest = self.manifest(number)
        if manifest["buckets"] != self.buckets:
            raise ValueError(f"the store has {manifest['buckets']} buckets, not {self.buckets}")
        for name, (new, gone, *known) in changes.items():
            schema, key = self.tables[name]
            fields = StructType.fromDDL(schema)
            columns = fields.fieldNames()
            typed = lambda d: d.select(*(F.col(f.name).cast(f.dataType) for f in fields))  # noqa: B023, E731
            keys = known or [d for d in (new, gone) if d is not None]
            if not keys:
                continue
            keys = [d.select(F.col(key).cast(fields[key].dataType)) for d in keys]
            keys = keys[0].unionByName(keys[1]) if len(keys) > 1 else keys[0]
            touched = [r[0] for r in keys.select(self.bucket(F.col(key))).distinct().collect()]  # no more than there are buckets
            if not touched:
                continue
            new = typed(new) if new is not None else None
            own = manifest["tables"].setdefault(name, {})
            if any(str(b) in own for b in touched):
                rows = self.merged(self.read(name, number, touched), new, keys, columns, key)
            else:
                rows = self.dealt(new if new is not None else self.spark.createDataFrame([], schema), key).drop("part_")
            folder = f"{name_of_change}/{name}"
            rows.write.partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
            filled = self.filled(folder)
            for b in touched:
                own.pop(str(b), None)
                if b in filled:
                    own[str(b)] = folder
        return Staged(number, manifest)

    def filled(self, folder: str) -> set[int]:
        """Buckets that have rows in a folder."""
        return {int(f.getPath().getName().split("=")[1]) for f in self.files.util().listStatus(self.path(folder)) if "=" in f.getPath().getName()}

    def commit(self, staged: Staged) -> int:
        """Makes a staged change the current version of all its tables; the new number. Fails with `Conflict` if another was made meanwhile."""
        jvm, number = self.spark._jvm, staged.number + 1
        temporary = self.path("versions", f"_{uuid.uuid4().hex}")
        fs = temporary.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(temporary, False)
        try:
            out.write(bytearray(json.dumps(staged.manifest).encode()))
        finally:
            out.close()
        keep = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # never over a file that is there
        try:
            self.files.rename(temporary, self.path("versions", f"{number:012d}"), keep)
        except Exception as e:
            fs.delete(temporary, False)
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"version {number} is there already") from e
            raise
        return number

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all versions but the newest `keep`, and folders that none of these names; how many folders went. Not for use while a change is being staged."""
        fs, now = self.path("").getFileSystem(self.spark._jsc.hadoopConfiguration()), self.current()
        named = {folder for n in range(max(1, now - keep + 1), now + 1) for t in self.manifest(n)["tables"].values() for folder in t.values()}
        for n in range(1, now - keep + 1):
            fs.delete(self.path("versions", f"{n:012d}"), False)
        gone = 0
        if not fs.exists(self.path("data")):
            return gone
        for change in fs.listStatus(self.path("data")):
            for table in fs.listStatus(change.getPath()):
                if f"data/{change.getPath().getName()}/{table.getPath().getName()}" not in named:
                    gone += bool(fs.delete(table.getPath(), True))
        return gone

"""Execution of a batch of imports, in order: registering, indexing, metadata updates and retirement, with a failure of one row kept to that row.

A row is judged against what the rows before it have made of the registry. Rows influence each other only through a content hash or
a URL that they share, by way of the registry's records too. So lines and records are grouped by the hashes and URLs that they share, each group passes
through one task in order, and groups run side by side. What a task holds is the records of its group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import spread, written
from .decide import COMPARED, REQUIRED, missing_fields
from .groups import grouped_by

PENDING, INDEXED, SUPERSEDED, MANUAL, FAILED = "pending", "indexed", "superseded", "needs_manual", "failed"


class Book:
    """The records of a group, and what lines make of them. A record is a dict with doc_id, status, content_hash and the fields."""

    def __init__(self, fields: tuple[str, ...], carried: tuple[str, ...]):
        self.fields, self.carried = fields, carried
        self.records: dict[int, dict] = {}
        self.by_hash: dict[str, int] = {}
        self.active: dict[str, set[int]] = {}  # indexed records of a URL
        self.changed: dict[int, int | None] = {}  # record: the last line that indexed it

    def put(self, record: dict) -> None:
        i = record["doc_id"]
        self.records[i] = record
        if record["content_hash"] is not None:
            self.by_hash[record["content_hash"]] = min(i, self.by_hash.get(record["content_hash"], i))
        if record["status"] == INDEXED and record.get("source_url") is not None:
            self.active.setdefault(record["source_url"], set()).add(i)

    def become(self, i: int, status: str | None = None, values: dict | None = None) -> None:
        """A record with another status or other fields."""
        record = self.records[i]
        self.active.get(record.get("source_url"), set()).discard(i)
        record |= (values or {}) | ({"status": status} if status else {})
        self.put(record)
        self.changed.setdefault(i, None)

    def judge(self, line: dict) -> tuple[str, int | None, int | None]:
        """(action, matched record, earlier version)."""
        i = self.by_hash.get(line["content_hash"])
        if i is None:
            known = self.active.get(line.get("source_url")) if line.get("source_url") is not None else None
            return ("SUPERSEDE_AND_NEW", None, min(known)) if known else ("NEW", None, None)
        record = self.records[i]
        if record["status"] != INDEXED:
            return "REINDEX", i, None
        return ("UPDATE_META" if any(record[c] != line[c] for c in self.fields) else "SKIP"), i, None

    def take(self, line: dict) -> tuple:
        """(action, doc_id, previous_id, status, ok, detail, parents, children) of a line, which takes effect."""
        if line["content_hash"] is None:
            return None, None, None, FAILED, False, "no content", 0, 0
        action, i, previous = self.judge(line)
        if action == "SKIP":
            return action, i, None, INDEXED, True, "nothing changed", 0, 0
        values, lost = {c: line[c] for c in self.fields}, ", ".join(line["lost"])
        if action == "UPDATE_META":
            self.become(i, PENDING if lost else None, values)
            return action, i, None, self.records[i]["status"], True, f"metadata now lacks {lost}; taken out of the index" if lost else "metadata updated", 0, 0
        if i is None:
            i = line["doc_id"]
            self.put({"doc_id": i, "status": PENDING, "content_hash": line["content_hash"], **values, **{c: line[c] for c in self.carried}})
            self.changed[i] = None
        else:  # where the file lies stays as it was registered
            self.become(i, PENDING, values)
        error = line["error"]
        if lost:
            return action, i, previous, PENDING, True, f"registered only, lacks {lost}", 0, 0
        if not line["parsed"]:
            if error is not None:  # the parser itself broke: the record shows that it was begun
                return None, i, previous, PENDING, False, error, 0, 0
            self.become(i, MANUAL)
            return action, i, previous, MANUAL, False, "no parser could read it", 0, 0
        if not line["indexed"]:
            self.become(i, FAILED)
            return None, i, previous, FAILED, False, error or "indexing failed", 0, 0
        self.become(i, INDEXED)
        self.changed[i] = line["line_number"]
        url = self.records[i].get("source_url")
        for other in sorted(self.active.get(url, ())) if url is not None else ():
            if other != i:
                self.become(other, SUPERSEDED)
        parents, children = line["parents"] or 0, line["children"] or 0
        return action, i, previous, INDEXED, True, f"indexed {parents} parents and {children} children", parents, children


def import_batch(incoming: DataFrame, registry: DataFrame, parsed: DataFrame, new_id: Column, required: tuple[str, ...] = REQUIRED, carried: tuple[str, ...] = ("raw_path",)) -> tuple[DataFrame, DataFrame]:
    """(outcomes, records) of `import_changes`, with the records that no line touched; their indexed_by is null."""
    outcomes, changed = import_changes(incoming, registry, parsed, new_id, required, carried)
    names = [c for c in changed.columns if c != "indexed_by"]
    kept = registry.select(names).join(spread(changed.select("doc_id")), "doc_id", "left_anti").withColumn("indexed_by", F.lit(None).cast("long"))
    return outcomes, kept.unionByName(changed)


def import_changes(incoming: DataFrame, registry: DataFrame, parsed: DataFrame, new_id: Column, required: tuple[str, ...] = REQUIRED, carried: tuple[str, ...] = ("raw_path",)) -> tuple[DataFrame, DataFrame]:
    """(outcomes, records) of importing the lines of `incoming` (line_number, content_hash, fields) in order.

    registry: (doc_id long, content_hash, status, fields). parsed: (content_hash, parsed, indexed, parents, children and, if wanted, error), what parsing and indexing
    made of each content. new_id: the id of a record that a line makes, larger than those there. Fields are those of `COMPARED` that both tables have; they follow the manifest. The columns of `carried` are set once, when a record is made.

    outcomes: line_number, action, doc_id, previous_id, status, ok, detail, parents, children, a row for each line. action is null where indexing or a parser raised an error, or there is no content; nothing else happens to a line without a hash.
    records: doc_id, status, content_hash, fields, carried and indexed_by, the line that indexed the record last, null if none did; a row for each record that a line made or touched. Both are read from one written table.

    Same hash as a record: REINDEX unless that is indexed, UPDATE_META if a field differs (null-safe), else SKIP. Other rows are NEW, or SUPERSEDE_AND_NEW if an indexed record has their URL. A null URL matches nothing;
    of several records of a hash or URL the smallest id counts. A row that lacks a required field is registered and no more; one whose metadata changes so that a field is missing leaves the index. Only a record
    that was indexed anew retires the others of its URL. Lines with equal numbers stand in the order of their hashes; empty tables give no rows.
    """
    fields = tuple(c for c in COMPARED if c in incoming.columns and c in registry.columns)
    carried = tuple(c for c in carried if c in incoming.columns and c in registry.columns)
    url = F.col("source_url").cast("string") if "source_url" in fields else F.lit(None).cast("string")
    node = lambda kind, c: F.xxhash64(F.lit(kind), c)  # noqa: E731 (two keys of one value join two groups, which does no harm)
    known = ["content_hash", "parsed", "indexed", "parents", "children", *(["error"] if "error" in parsed.columns else [])]
    lines = incoming.withColumn("lost", missing_fields(incoming, required)).withColumn("doc_id", new_id.cast("long"))
    lines = lines.select("line_number", "doc_id", "content_hash", "lost", *fields, *carried).join(spread(parsed.select(known)), "content_hash", "left")
    if "error" not in known:
        lines = lines.withColumn("error", F.lit(None).cast("string"))

    # Records without a hash can still be retired by their URL.
    own = F.when(F.col("content_hash").isNotNull(), node("hash", F.col("content_hash"))).otherwise(node("record", F.col("doc_id")))
    both = lambda d, new: d.select(own.alias("a"), F.when(url.isNotNull(), node("url", url)).alias("b"), F.lit(new).alias("new"))
    at = grouped_by(both(lines.filter("content_hash is not null"), True).unionByName(both(registry, False)))
    at = written(at.join(spread(at.filter("new").select("group").distinct()), "group", "left_semi").drop("new"), "import-groups")

    common = ["content_hash", *fields, *carried]
    extra = {"parsed": "boolean", "indexed": "boolean", "parents": "long", "children": "long", "error": "string"}
    types = dict(registry.dtypes)
    old = registry.select(F.col("doc_id").cast("long").alias("doc_id"), "status", *common).withColumns({"line_number": F.lit(None).cast("long"), "lost": F.array().cast("array<string>"), **{c: F.lit(None).cast(t) for c, t in extra.items()}})
    new = lines.withColumns({"status": F.lit(None).cast("string"), "line_number": F.col("line_number").cast("long"), **{c: F.col(c).cast(t) for c, t in extra.items()}, **{c: F.col(c).cast(types[c]) for c in (*fields, *carried)}})
    names = ["line_number", "doc_id", "status", *common, "lost", *extra]
    grouped = lambda d: d.select(names).join(spread(at.select(F.col("node").alias("node_"), F.col("group").alias("group_"))), own == F.col("node_")).drop("node_")
    # Lines without a hash are a group each.
    rows = grouped(old).unionByName(grouped(new.filter("content_hash is not null"))).unionByName(new.filter("content_hash is null").select(names).withColumn("group_", F.xxhash64(F.lit("line"), "line_number", "doc_id")))
    out_names = ["kind", "line_number", "action", "doc_id", "previous_id", "status", "ok", "detail", "parents", "children", *common, "indexed_by"]
    head = "kind string, line_number long, action string, doc_id long, previous_id long, status string, ok boolean, detail string, parents long, children long"
    schema = ", ".join([head, "content_hash string", *(f"`{c}` {types[c]}" for c in (*fields, *carried)), "indexed_by long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, book = None, None
        target = None

        def table(found: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [()] * len(out_names), target, strict=True)], out_names)

        def records(b: Book) -> list[tuple]:
            nothing = [None] * 3
            return [("record", None, None, i, None, r["status"], *nothing, None, *(r[c] for c in common), b.changed[i]) for i, r in b.records.items() if i in b.changed]

        for batch in batches:
            if target is None:
                kinds = [batch.schema.field(c).type for c in common]
                target = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), *kinds, pa.int64()]
            found = []
            for row in batch.to_pylist():
                if row["group_"] != last:
                    if book:
                        found += records(book)
                    last, book = row["group_"], Book(fields, carried)
                if row["line_number"] is None:
                    book.put({c: row[c] for c in ("doc_id", "status", *common)})
                else:
                    action, i, previous, *rest = book.take(row)
                    found.append(("line", row["line_number"], action, i, previous, *rest, *[None] * len(common), None))
            yield table(found)
        if book:
            yield table(records(book))

    done = written(rows.repartition("group_").sortWithinPartitions(F.col("group_"), F.col("line_number").asc_nulls_first(), "content_hash", "doc_id").mapInArrow(run, schema), "import")
    outcomes = done.filter("kind = 'line'").select("line_number", "action", "doc_id", "previous_id", "status", "ok", "detail", "parents", "children")
    return outcomes, done.filter("kind = 'record'").select("doc_id", "status", *common, "indexed_by")


def stale_vectors(vectors: DataFrame, registry: DataFrame) -> DataFrame:
    """Vectors left after retirement: those of indexed documents only, as the index knows no status."""
    return vectors.join(registry.filter("status = 'indexed'").select("doc_id"), "doc_id", "left_semi")

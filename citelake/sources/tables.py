"""Readers of the manifest, evaluation cases, FAQ text and raw files. Errors of rows are data: an error column, null where all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean, parse_day, split_sources, strip

# Columns of the files and the values that their coded columns may have.
MANIFEST = ("file_name", "title", "source_url", "publisher", "country", "doc_type", "effective_date", "platform", "notes")
MANIFEST_REQUIRED = ("file_name", "title", "source_url", "publisher", "country", "doc_type", "effective_date", "platform")
COUNTRIES = ("EU", "DE", "FR", "IT", "ES", "NL", "PL")
DOC_TYPES = ("guideline", "regulation", "policy")
PUBLISHERS = ("amazon", "eu_commission")
PLATFORMS = ("amazon",)
CASES = ("question", "expected_behavior", "category", "expected_sources", "notes")
BEHAVIOURS = ("answer", "refuse")
# The lines that begin an entry or a field of the FAQ text, the fields' names in order with the names they have in JSON, and code fences.
FAQ_ENTRY = r"^={3,}\s*(F-\d+)\s*=*$"
FAQ_FIELD = r"^-{2,}\s*(问题|译文|原文|出处)\s*-*$"
FAQ_FIELDS = {"问题": "question_zh", "译文": "answer_zh", "原文": "answer_en", "出处": "source"}
FENCE = "```"


def csv(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """A CSV with a header, columns by name in any order, all strings; a missing required column is an error. Adds line_number.

    Line numbers count records from 2, as the header is line 1. They come from an index over ordered partitions, not from one task.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = [c.lstrip("﻿").strip() for c in raw.columns]
    raw = raw.toDF(*names)
    if lost := [c for c in required if c not in names]:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return numbered(raw, 2)


def numbered(df: DataFrame, start: int) -> DataFrame:
    """Adds line_number in file order: a row's place in its partition after the rows of the partitions before."""
    d = df.withColumn("mid_", F.monotonically_increasing_id()).withColumn("part_", F.shiftright("mid_", 33))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy("part_").agg(F.count("*").alias("n_")).withColumn("before_", F.coalesce(F.sum("n_").over(before), F.lit(0)))  # one row a partition
    return d.join(F.broadcast(sizes.select("part_", "before_")), "part_").withColumn("line_number", (F.col("before_") + F.col("mid_") - F.shiftleft("part_", 33) + start).cast("long")).drop("mid_", "part_", "before_")


def in_list(name: str, allowed: tuple[str, ...]) -> Column:
    """Error of a value outside a fixed list; null passes."""
    return F.when(F.col(name).isNotNull() & ~F.col(name).isin(*allowed), F.concat(F.lit(f"{name} "), F.col(name), F.lit(f" is not one of {', '.join(sorted(allowed))}")))


def manifest(rows: DataFrame) -> DataFrame:
    """Checked manifest rows: blank ones are dropped, values stripped, the date parsed; error names the first fault. A repeated file name names both lines."""
    r = rows.select("line_number", *(clean(F.col(c)).alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in MANIFEST))
    r = r.filter(F.coalesce(*(F.col(c) for c in MANIFEST)).isNotNull())
    first = F.min("line_number").over(Window.partitionBy("file_name"))
    day = parse_day(F.col("effective_date"))
    faults = [
        *(F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in ("file_name", "title", "platform")),
        F.when(F.col("file_name").rlike(r"[/\\]"), F.lit("file_name holds a path")),
        F.when(F.col("file_name").isNotNull() & (first < F.col("line_number")), F.format_string("file_name of line %d is repeated in line %d", first, F.col("line_number"))),
        in_list("platform", PLATFORMS), in_list("publisher", PUBLISHERS), in_list("country", COUNTRIES), in_list("doc_type", DOC_TYPES),
        F.when(F.col("effective_date").isNotNull() & day.isNull(), F.concat(F.lit("bad date "), F.col("effective_date"))),
    ]
    return r.withColumn("error", F.coalesce(*faults)).withColumn("effective_date", day)


def eval_cases(rows: DataFrame) -> DataFrame:
    """Checked evaluation cases with expected_sources as an array; a record cut short, its notes null, is marked."""
    r = rows.select("line_number", *(clean(F.col(c)).alias(c) for c in CASES))
    fault = F.coalesce(F.when(F.col("question").isNull(), F.lit("question is missing")), F.when(F.col("expected_behavior").isNull(), F.lit("expected_behavior is missing")), in_list("expected_behavior", BEHAVIOURS), F.when(F.col("category").isNull(), F.lit("category is missing")))
    return r.select("line_number", "question", "expected_behavior", "category", split_sources(F.col("expected_sources")).alias("expected_sources"), "notes", F.col("notes").isNull().alias("short_record"), fault.alias("error"))


def raw_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, raw_path, content_hash, format) of all files in a folder."""
    from ..operators.html import sniff

    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("path").alias("raw_path"), F.sha2("content", 256).alias("content_hash"), sniff(F.col("content")).alias("format"))


def faq(text: DataFrame) -> DataFrame:
    """(path, entry_id, question_zh, answer_zh, answer_en, source, error) of marker-delimited texts (path, value), one row an entry, in no order.

    Each field's lines are joined, and the value is stripped. Lines of code fences and lines before a file's first field are dropped. error names the first fault: an empty field, an id
    for the second time in its file, an original without a Latin letter; null if all is well. A field outside any entry gives a row without an id.
    """
    lines = text.select("path", F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("pos", "line")).withColumn("bare", strip(F.col("line"))).filter(~F.col("bare").startswith(FENCE))
    w = Window.partitionBy("path").orderBy("pos")
    lines = lines.withColumn("id", F.nullif(F.regexp_extract("bare", FAQ_ENTRY, 1), F.lit(""))).withColumn("name", F.nullif(F.regexp_extract("bare", FAQ_FIELD, 1), F.lit("")))
    lines = lines.withColumn("n", F.count("id").over(w)).withColumn("field", F.last(F.when(F.col("id").isNotNull(), F.lit("")).otherwise(F.col("name")), True).over(w))
    own = lambda name: F.array_sort(F.collect_list(F.when(F.col("name").isNull() & F.col("id").isNull() & (F.col("field") == name), F.struct("pos", "line"))))
    value = lambda name: clean(F.array_join(F.transform(own(name), lambda x: F.regexp_replace(x["line"], r"(?U)\s+$", "")), "\n"))
    rows = lines.groupBy("path", "n").agg(F.max("id").alias("entry_id"), *(value(k).alias(v) for k, v in FAQ_FIELDS.items()), F.count("name").alias("fields"), F.min("pos").alias("pos"))
    rows = rows.filter("n > 0 or fields > 0")
    twice = F.row_number().over(Window.partitionBy("path", "entry_id").orderBy("pos")) > 1
    fault = F.coalesce(
        F.when(F.col("entry_id").isNull(), F.lit("a field stands outside any entry")),
        *(F.when(F.col(v).isNull(), F.lit(f"{v} is empty")) for v in FAQ_FIELDS.values()),
        F.when(twice, F.lit("the entry is there twice")),
        F.when(~F.col("answer_en").rlike("[A-Za-z]"), F.lit("answer_en has no Latin letter")),
    )
    return rows.select("path", "entry_id", *FAQ_FIELDS.values(), fault.alias("error"))


def write_faq(entries: DataFrame, folder: str) -> None:
    """Write the entries of `faq` as JSON lines with the fields in fixed order. Any fault is an error, and nothing is written."""
    bad = entries.filter("error is not null").select("path", "entry_id", "error").take(5)
    if bad:
        raise ValueError("; ".join(f"{x['path']} {x['entry_id']}: {x['error']}" for x in bad))
    entries.select("entry_id", *FAQ_FIELDS.values()).write.mode("overwrite").json(folder)

"""Requests: validation, trace ids, JSON lists and options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Greatest lengths of a request's fields, and what a trace id may be.
LENGTHS = {"question": 2000, "session_id": 128, "country": 16, "doc_type": 32, "publisher": 64}
TRACE = r"\A[A-Za-z0-9_-]{1,128}\z"


def trace_id(given: Column) -> Column:
    """The given id, or a new one where it is missing or malformed."""
    return F.when(F.coalesce(given.rlike(TRACE), F.lit(False)), given).otherwise(F.uuid())


def validate(rows: DataFrame) -> DataFrame:
    """Requests (body: a JSON object) with their fields and error, null where all is well: not an object, an unknown key, an empty or missing question, a field too long or not a string."""
    body = F.from_json("body", "map<string, string>")
    keys = F.array_except(F.coalesce(F.json_object_keys("body"), F.array().cast("array<string>")), F.array(*map(F.lit, LENGTHS)))
    r = rows.withColumn("b_", body)
    own = {c: F.col("b_")[c] for c in LENGTHS}
    kind = lambda c: F.schema_of_variant(F.variant_get(F.try_parse_json("body"), f"$.{c}", "variant"))
    faults = [
        F.when(F.json_object_keys("body").isNull(), F.lit("not an object")),
        F.when(F.size(keys) > 0, F.concat(F.lit("unknown key "), F.array_join(F.sort_array(keys), ", "))),
        *(F.when(own[c].isNotNull() & (kind(c) != "STRING"), F.lit(f"{c} is not a string")) for c in LENGTHS),
        F.when(F.coalesce(F.length(own["question"]), F.lit(0)) == 0, F.lit("question is missing")),
        *(F.when(F.length(own[c]) > n, F.lit(f"{c} has more than {n} characters")) for c, n in LENGTHS.items()),
    ]
    return r.select(*rows.columns, *(own[c].alias(c) for c in LENGTHS), F.coalesce(*faults).alias("error"))


def encode_list(c: Column) -> Column:
    """A JSON list; an empty one becomes null."""
    return F.when(F.size(c) > 0, F.to_json(c))


def decode_list(c: Column) -> Column:
    """The strings of a JSON list; null: none."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def options(dims: DataFrame, code: str = "code", name: str = "name") -> DataFrame:
    """One row with options: map of `code（name）` to code, for a small table of dimensions, in the order of codes."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(code).alias("c"), F.concat(code, F.lit("（"), name, F.lit("）")).alias("n"))))
    return dims.agg(F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["n"], x["c"]))).alias("options"))

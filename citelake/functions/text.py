"""Text: cleaning, white space, ids, digests, citation markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as garbage (replacement character, C0 controls but tab, LF and CR, private use).
GARBAGE = r"[\x{FFFD}\x00-\x08\x0b\x0c\x0e-\x1f\x{E000}-\x{F8FF}]"
# Fixed value: citation markers in ASCII or full-width brackets.
MARKER = r"[\[［](\d+)[\]］]"
IDENTIFIER = r"\A[A-Za-z0-9_-]+\z"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Stripped; empty becomes null."""
    return F.nullif(strip(c), F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of Unicode white space become one space; ends are stripped."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def parse_day(c: Column) -> Column:
    """A date of the form 2021-7-1 or 2021-07-01; anything else is null."""
    return F.when(c.rlike(r"\A\d{4}-\d{1,2}-\d{1,2}\z"), F.try_to_date(c, "yyyy-M-d"))


def garbage_ratio(c: Column) -> Column:
    """Garbage characters per character; 1 for an empty text."""
    return F.when(F.length(c) == 0, 1.0).otherwise(F.regexp_count(c, F.lit(GARBAGE)) / F.length(c))


def cited_numbers(c: Column) -> Column:
    """Distinct numbers of citation markers in order of appearance; numbers too large for a long are dropped."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(c, F.lit(MARKER), 1), lambda x: x.try_cast("long")), lambda x: x.isNotNull()))


def parent_id(doc_id: Column, n: Column) -> Column:
    return F.format_string("%s_p%04d", doc_id.cast("string"), n)


def child_id(doc_id: Column, n: Column) -> Column:
    return F.format_string("%s_c%04d", doc_id.cast("string"), n)


def family(chunk_id: Column) -> Column:
    """What the ids of a document's chunks have in common; any other id stands for itself."""
    return F.regexp_replace(chunk_id.cast("string"), r"_[pc]\d{4,}$", "")


def host(url: Column) -> Column:
    """Host in lower case without a leading www."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def split_sources(c: Column) -> Column:
    """Parts between semicolons, stripped, blank ones dropped; null: none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), strip), lambda x: x != "")


def cache_digest(*parts: Column) -> Column:
    """Digest of a question and its filters; a null part differs from an empty one."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), p), F.lit("-")) for p in parts)), 256)


def preview(c: Column, limit: int = 240) -> Column:
    """One line, cut at `limit` characters with a note of the full length."""
    flat = collapse(c)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.format_string("… (%d)", F.length(flat)))).otherwise(flat)

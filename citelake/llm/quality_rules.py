"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule's cost (seconds a row, with all measures it needs) and selectivity (share of rows it rejects) are estimated on a sample of stated size;
rules then run in the order of rejection per cost. A document leaves at the first rule it fails: measures that only later rules need
are not computed for it. The order changes the time and the rule that is named, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, run_hashes, words

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
#: Rows of the sample on which costs and selectivities are measured, on average.
SAMPLE_ROWS = 2000
#: Times that each row of the sample is measured.
REPEATS = 4


def measure_words(d: DataFrame, open_: Column) -> DataFrame:
    """words_, n_words."""
    return d.withColumn("words_", F.when(open_, words(F.col("text_")))).withColumn("n_words", F.size("words_").cast("long"))


def measure_chars(d: DataFrame, open_: Column) -> DataFrame:
    """word_chars: code points in words."""
    return d.withColumn("word_chars", F.when(open_, F.length(F.array_join("words_", ""))).cast("long"))


def measure_symbols(d: DataFrame, open_: Column) -> DataFrame:
    return d.withColumn("n_symbols", F.when(open_, F.regexp_count("text_", F.lit(SYMBOLS))).cast("long"))


def measure_lines(d: DataFrame, open_: Column) -> DataFrame:
    """n_lines with a word; n_dup_lines: those equal to an earlier one."""
    d = d.withColumn("lines_", F.when(open_, F.filter(F.split("text_", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))))
    return d.withColumn("n_lines", F.size("lines_").cast("long")).withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("lines_")))


def measure_letters(d: DataFrame, open_: Column) -> DataFrame:
    count = lambda c: F.when(open_, F.length(F.regexp_replace("text_", f"[^{c}]+", "")))
    return d.withColumn("n_letters", count("\\p{L}")).withColumn("n_upper", count("\\p{Lu}"))


def measure_repeats(d: DataFrame, open_: Column) -> DataFrame:
    """n_repeat_words: words inside 8-word windows that the text holds twice or more.

    Windows are hashed to 64 bits. Only texts with equal hashes sort their windows; equal neighbours give positions,
    and one pass over these in order counts the words that they cover.
    """
    d = d.withColumn("hashes_", F.when(open_, F.transform("words_", lambda x: F.xxhash64(x))))
    d = run_hashes(d, "hashes_", "windows_", WINDOW)
    h = F.col("windows_")
    d = d.withColumn("sorted_", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:long,i:int>>")))
    s = F.col("sorted_")
    d = d.withColumn("at_", F.sort_array(F.transform(F.filter(s, lambda e, j: F.coalesce(e["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, j + 1)["h"], F.lit(False))), lambda e: e["i"])))
    seen = F.aggregate("at_", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")))
    return d.withColumn("n_repeat_words", F.when(open_, seen["n"]).cast("long"))


@dataclass(frozen=True)
class Rule:
    """fails: a condition on measures, true for a document that the rule rejects; needs: the measures, in the order in which they are computed."""

    name: str
    fails: str
    needs: tuple[Callable[[DataFrame, Column], DataFrame], ...]


RULES = (
    Rule("few_words", "n_words < 20", (measure_words,)),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words", (measure_words, measure_repeats)),
    Rule("symbols", "10 * n_symbols > 3 * n_words", (measure_words, measure_symbols)),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words", (measure_words, measure_chars)),
    Rule("repeated_lines", "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines", (measure_lines,)),
    Rule("shouting", "10 * n_upper > 6 * n_letters", (measure_letters,)),
)


def with_text(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_", F.coalesce("text", F.lit("")))


def estimate(docs: DataFrame) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a row, share of rows rejected), best rejection per cost first; ties and empty samples keep the stated order.

    Each rule is timed over REPEATS copies of the sample against a job that only reads them, the better of two runs, so a job's own latency does not count.
    """
    rows = docs.count()
    sample = docs.select("doc_id", "text").filter(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, rows // SAMPLE_ROWS))) == 0)
    sample = with_text(Stages(docs.sparkSession, "quality-sample").put(sample))
    copies = sample.withColumn("copy_", F.explode(F.array_repeat(F.lit(0), REPEATS)))

    def timed(d: DataFrame, fails: Column) -> tuple[float, int, int]:
        test = d.agg(F.count("*").alias("n"), F.count_if(fails).alias("bad"))
        best = float("inf")
        for _ in range(2):  # the first run compiles
            start = time.perf_counter()
            got = test.first()
            best = min(best, time.perf_counter() - start)
        return best, got["n"], got["bad"]

    base, _, _ = timed(copies, F.length("text_") < 0)
    found = []
    for rule in RULES:
        d = copies
        for measure in rule.needs:
            d = measure(d, F.lit(True))
        took, n, bad = timed(d, F.expr(rule.fails))
        found.append((rule, max(took - base, 1e-4) / max(1, n), bad / max(1, n)))
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(d: DataFrame, order: list[Rule], done: tuple = ()) -> DataFrame:
    """Adds failed_rule, the name of the first rule failed, or null. Measures that are not `done` already are computed for documents that still pass."""
    d, done = d.withColumn("failed_rule", F.lit(None).cast("string")), list(done)
    for rule in order:
        for measure in rule.needs:
            if measure not in done:
                d = measure(d, F.col("failed_rule").isNull())
                done.append(measure)
        d = d.withColumn("failed_rule", F.coalesce("failed_rule", F.when(F.expr(rule.fails), F.lit(rule.name))))
    return d


def passing(docs: DataFrame) -> DataFrame:
    """Rows of `docs` that fail no rule."""
    names = docs.columns
    # Columns of docs go aside under names of their own, as measures have names too.
    d = with_text(docs.select("text", F.struct(*(F.col(f"`{c}`") for c in names)).alias("row_")))
    d = cascade(d, [rule for rule, _, _ in estimate(docs)])
    # The row number keeps the filter above the measures: below them each would be computed anew wherever it is named.
    d = d.withColumn("n_", F.monotonically_increasing_id())
    return d.filter(F.col("failed_rule").isNull() & (F.col("n_") >= 0)).select("row_.*")


def quality(docs: DataFrame) -> DataFrame:
    """Measures and verdict of each row of `docs` (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have no words and fail. Rows are judged one by one, so ties and repeated rows do not matter; other columns are ignored.
    kept: no rule of the cascade is failed; base_failed is two of its rules. The measures that are returned are computed once, for every row; the cascade reads them.
    """
    order = [rule for rule, _, _ in estimate(docs)]
    returned = (measure_words, measure_chars, measure_symbols, measure_lines, measure_repeats)
    d = with_text(docs.select("doc_id", "text"))
    for measure in returned:
        d = measure(d, F.lit(True))
    d = cascade(d, order, returned)
    base = F.expr(" or ".join(f"({r.fails})" for r in RULES[:2]))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), F.col("failed_rule").isNull().alias("kept"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+7], ' ')) AS n
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, range(8) AS s(k) WHERE g.n > 1 GROUP BY doc_id),
m AS (SELECT d.doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS upper, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters
    FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
        OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines) OR 10 * upper > 6 * letters) AS kept FROM b
"""

"""Acceptance of answers: whether their numbers stand in the passages that they cite, and the rates of refusal and citation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MARKER

#: A number as it is written: sign, digits with separators between them, unit.
WRITTEN = r"[-−+]?[0-9]+(?:[.,'][0-9]+)*(?: ?(?:%|‰|percent))?"
#: Thousands by commas or apostrophes, thousands by points before a decimal comma or twice, a decimal comma.
GROUPED, POINTS, COMMA = r"^-?[0-9]{1,3}([,'][0-9]{3})+(\.[0-9]+)?$", r"^-?[0-9]{1,3}(\.[0-9]{3})+(,[0-9]+|\.[0-9]{3})$", r"^-?[0-9]+,[0-9]+$"


def numbers(text: Column) -> Column:
    """Distinct numbers of a text in one form, in order of appearance; null: none. Citation markers are no numbers.

    Signs count unless they join two words or numbers, as in dates; a plus sign is dropped. Thousands separators go, a decimal comma becomes a point, zeros that say nothing go, and
    `%`, `‰` and `percent` stay as a unit: 20 is not 20 %. One group of three digits behind a point, as in 1.234, is taken for decimals, and what is neither, as 2.1.3, stays as it is written.
    """
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), MARKER, " "), r"([0-9A-Za-z])[-−]([0-9])", "$1 $2")

    def normal(x: Column) -> Column:
        unit = F.when(x.rlike("(%|percent)$"), "%").when(x.rlike("‰$"), "‰").otherwise("")
        core = F.regexp_replace(F.translate(F.regexp_replace(x, " ?(%|‰|percent)$", ""), "−", "-"), r"^\+", "")
        core = F.when(core.rlike(GROUPED), F.translate(core, ",'", "")).when(core.rlike(POINTS), F.replace(F.replace(core, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(core.rlike(COMMA), F.replace(core, F.lit(","), F.lit("."))).otherwise(core)
        core = F.regexp_replace(core, r"^(-?)0+([0-9])", "$1$2")
        return F.concat(F.when(core.rlike(r"^-?[0-9]+\.[0-9]+$"), F.regexp_replace(core, r"\.?0+$", "")).otherwise(core), unit)

    return F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(WRITTEN), 0), normal))


def traced(answers: DataFrame, cited: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """`key`, numbers, found and missing for each of `answers` (key, text): numbers in no passage of `cited` (key, passage) are missing.

    One row a number and answer, joined with the distinct numbers of its passages: no passage meets an answer's whole text. Answers without numbers have none missing.
    """
    own = answers.select(*key, F.posexplode(numbers(F.col(text))).alias("at", "number"))
    there = cited.select(*key, F.explode(numbers(F.col("passage"))).alias("number")).distinct().withColumn("there", F.lit(True))
    found = own.join(there, [*key, "number"], "left").groupBy(*key).agg(
        F.count("*").alias("n"), F.count("there").alias("found"), F.transform(F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.struct("at", "number")))), lambda x: x["number"]).alias("missing")
    )
    out = answers.select(key).join(found, key, "left")
    return out.select(*key, F.coalesce("n", F.lit(0)).alias("numbers"), F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def acceptance(answers: DataFrame, by: str) -> DataFrame:
    """Rates of `answers` (outcome, should_answer, n_valid, n_invalid, numbers, found and the column `by`), in each group and, under null, in all.

    traceability: numbers found in cited passages; validity: markers that name a material; both of answers that were given. refusal: of questions that should be refused, those without an answer;
    false_block: of those that should be answered, those that the gate refused. A rate of nothing is null.
    """
    normal, wanted = F.col("outcome") == "normal", F.col("should_answer")
    rate = lambda a, b: (F.sum(a) / F.nullif(F.sum(b), F.lit(0))).alias
    zero = F.lit(0)
    return answers.rollup(by).agg(
        F.count("*").alias("n"),
        rate(F.when(normal, F.col("found")).otherwise(zero), F.when(normal, F.col("numbers")).otherwise(zero))("traceability"),
        rate(F.when(normal, F.col("n_valid")).otherwise(zero), F.when(normal, F.col("n_valid") + F.col("n_invalid")).otherwise(zero))("validity"),
        rate(F.when(~wanted & ~normal, 1).otherwise(0), F.when(~wanted, 1).otherwise(0))("refusal"),
        rate(F.when(wanted & (F.col("outcome") == "refused"), 1).otherwise(0), F.when(wanted, 1).otherwise(0))("false_block"),
    )

"""Calibration of the refusal threshold on labelled questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sweep(cases: DataFrame, max_missed: int = 0) -> DataFrame:
    """(threshold, blocked, missed) for each different score of `cases` (expected_behavior, score), null as -1, that loses at most `max_missed` answerable questions.

    blocked and missed: questions to refuse and to answer below the threshold. Scores are aggregated first and their running sums taken over ranges of
    scores: the window runs over the few ranges, then within each of them, so no task holds all scores.
    """
    per = cases.withColumn("threshold", F.coalesce("score", F.lit(-1.0))).groupBy("threshold").agg(F.count_if(F.col("expected_behavior") == "refuse").alias("r"), F.count_if(F.col("expected_behavior") == "answer").alias("a"))
    per = per.withColumn("range", F.floor(F.col("threshold") * 64))
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = per.groupBy("range").agg(F.sum("r").alias("r0"), F.sum("a").alias("a0"))
    ranges = ranges.select("range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("r0", "a0")))
    within = Window.partitionBy("range").orderBy("threshold").rowsBetween(Window.unboundedPreceding, -1)
    out = per.join(ranges, "range").select("threshold", *((F.col(f"{c}0") + F.coalesce(F.sum(c).over(within), F.lit(0))).cast("long").alias(n) for c, n in (("r", "blocked"), ("a", "missed"))))
    return out.filter(F.col("missed") <= max_missed).orderBy(F.desc("blocked"), F.desc("threshold"))


def scored(cases: DataFrame, scores: DataFrame) -> DataFrame:
    """`cases` (qid, anything else) with the score that search gave each question of `scores` (qid, dense_top_score); null where it found nothing or was not asked."""
    return cases.drop("score").join(scores.select("qid", F.col("dense_top_score").alias("score")), "qid", "left")


def describe(cases: DataFrame) -> DataFrame:
    """Number, least, median and greatest score of each class; nulls do not count."""
    return cases.filter("score is not null").groupBy("expected_behavior").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.median("score").alias("middle"), F.max("score").alias("high"))


def separability(cases: DataFrame) -> DataFrame:
    """One row: the least score to answer, the greatest to refuse, and how many of the other class lie beyond each."""
    answer, refuse = F.col("expected_behavior") == "answer", F.col("expected_behavior") == "refuse"
    ends = cases.agg(F.min(F.when(answer, F.col("score"))).alias("low_answer"), F.max(F.when(refuse, F.col("score"))).alias("high_refuse"))
    both = cases.join(F.broadcast(ends))  # one row
    return both.groupBy("low_answer", "high_refuse").agg(F.count_if(refuse & (F.col("score") >= F.col("low_answer"))).alias("refuse_above"), F.count_if(answer & (F.col("score") <= F.col("high_refuse"))).alias("answer_below"))

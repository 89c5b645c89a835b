"""Citation checks, degraded answers and prompt context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import cited_numbers

# Texts of answers and prompts.
NO_EVIDENCE = "No evidence was found for this question."
UNMARKED, UNREGISTERED = "未标注", "未登记"
NO_MATERIAL = "（没有检索到任何材料）"
UNDATED = "检索到的材料里有未标注生效日期的，无法判断它与其他材料孰新。"
REMOVED = "模型引用了不存在的材料编号（%s），已从引用中剔除。"
MATERIAL = "[%d] %s\n    发布机构：%s  适用国家：%s  文档类型：%s  生效日期：%s\n    出处：%s\n    ---\n%s"
PROMPT = "问题：%s\n\n材料：\n%s"


def check(answers: DataFrame) -> DataFrame:
    """Adds valid, in the order of the materials, and invalid, in order of appearance, to `answers` (text, n_materials). Numbers run from 1."""
    n = cited_numbers(F.col("text"))
    ok = lambda x: (x >= 1) & (x <= F.col("n_materials"))
    return answers.withColumn("valid", F.array_sort(F.filter(n, ok))).withColumn("invalid", F.filter(n, lambda x: ~ok(x)))


def degrade(checked: DataFrame, undated: Column | None = None) -> DataFrame:
    """Adds degraded, final_text, raw_text and notes to what `check` gives.

    An answer without a valid citation is replaced by fixed text, and its own is kept as raw_text; without materials raw_text is empty and there are no notes. notes: first
    that a material has no date (undated), then, unless the answer is replaced, the citations that were taken out.
    """
    none = F.col("n_materials") == 0
    bad = none | (F.size("valid") == 0)
    notes = [] if undated is None else [F.when(undated & ~none, F.lit(UNDATED))]
    notes.append(F.when(~bad & (F.size("invalid") > 0), F.format_string(REMOVED, F.array_join("invalid", "、"))))
    return checked.select("*", bad.alias("degraded"), F.when(bad, F.lit(NO_EVIDENCE)).otherwise(F.col("text")).alias("final_text"), F.when(none, F.lit("")).otherwise(F.col("text")).alias("raw_text"), F.array_compact(F.array(*notes)).alias("notes"))


def outcome(refused: Column, degraded: Column) -> Column:
    return F.when(refused, "refused").when(degraded, "degraded").otherwise("normal")


def by_document(cited: DataFrame) -> DataFrame:
    """(answer keys, doc_id, title, n): one row a cited document with its first title. cited: qid, position, doc_id, title."""
    return cited.groupBy("qid", "doc_id").agg(F.min_by("title", "position").alias("title"), F.count("*").alias("n"))


def context(materials: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """(qid, context): numbered materials in order, each with its title, metadata, source and text. Questions (qid) without materials get a fixed text.

    materials: qid, position, text, title, publisher, country, doc_type, effective_date, source_url; unknown metadata is named as such.
    """
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(UNMARKED))
    day = F.date_format("effective_date", "yyyy-MM-dd")
    head = F.format_string(MATERIAL, "position", "title", *map(known, (F.col("publisher"), F.col("country"), F.col("doc_type"), day)), F.coalesce(F.nullif("source_url", F.lit("")), F.lit(UNREGISTERED)), "text")
    rows = materials.select("qid", "position", head.alias("part"))
    out = rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "part"))), lambda x: x["part"]), "\n\n").alias("context"))
    if questions is None:
        return out
    return questions.select("qid").distinct().join(out, "qid", "left").select("qid", F.coalesce("context", F.lit(NO_MATERIAL)).alias("context"))


def prompt(question: Column, context: Column) -> Column:
    """The user's message: the question stands before the materials."""
    return F.format_string(PROMPT, question, context)


def recalled_tokens(parents: DataFrame) -> DataFrame:
    """(qid, tokens, budget) of recalled parents (qid, token_count)."""
    return parents.groupBy("qid").agg(F.sum("token_count").alias("tokens")).withColumn("budget", budget(F.col("tokens")))


RESPONSE = """text string, raw_text string, degraded boolean, notes array<string>, cited array<struct<parent_id:string, doc_id:string, score:double, text:string, token_count:bigint, title:string, source_url:string,
    country:string, doc_type:string, publisher:string, effective_date:string, matched_children:array<struct<chunk_id:string, score:double, text:string, start_offset:bigint, end_offset:bigint>>>>,
    invalid_numbers array<bigint>, top_score double, parent_count bigint, refused boolean"""


def encode(responses: DataFrame) -> DataFrame:
    """Adds payload, the response's columns as JSON for the cache, cited materials in full; nulls are kept."""
    names = [f.name for f in StructType.fromDDL(RESPONSE)]
    return responses.withColumn("payload", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))


def decode(cached: DataFrame) -> DataFrame:
    """The response's columns of `cached` (payload), with cache_hit; its other columns are kept."""
    return cached.withColumn("r_", F.from_json("payload", RESPONSE)).select(*(c for c in cached.columns if c != "payload"), "r_.*", F.lit(True).alias("cache_hit"))


def budget(tokens: Column) -> Column:
    return F.when(tokens < 8000, "low").when(tokens < 16000, "middle").otherwise("high")


def answer(questions: DataFrame, threshold: float, model) -> DataFrame:
    """Answers of questions (qid, prompt, dense_top_score, n_materials): what the gate refuses never reaches the model, a function from prompt column to text column."""
    from .retrieve import gate

    q = questions.withColumn("answered", gate(F.col("dense_top_score"), threshold))
    asked = degrade(check(q.filter("answered").withColumn("text", model(F.col("prompt"))))).withColumn("outcome", outcome(F.lit(False), F.col("degraded")))
    refused = q.filter("not answered").select("qid", F.lit(NO_EVIDENCE).alias("final_text"), F.lit("refused").alias("outcome"))
    return asked.select("qid", "final_text", "outcome").unionByName(refused)

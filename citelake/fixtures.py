"""Views over the driver tables that serve as inputs of the queries, each as Spark and DuckDB SQL.

Whole tables throughout. Questions are the rows whose id is divisible by 100, asked of all rows.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

BOTH: dict[str, str] = {
    "chunk_vectors": "select vec_id chunk_id, vec_id - vec_id % 2 parent_id, vec_id - vec_id % 8 doc_id, case label % 3 when 0 then 'EU' when 1 then 'DE' else 'FR' end country, case label % 2 when 0 then 'guideline' else 'policy' end doc_type, case when label < 5 then 'amazon' else 'eu_commission' end publisher, embedding dense from embeddings",
    "cases": "select l.doc_id qid, case when l.quality = 1 then 'answer' else 'refuse' end expected_behavior, case when l.toxic = 1 then 'out_of_scope' else 'factual' end category, case when l.doc_id % 17 = 0 then cast(null as double) else round(cast((l.doc_id * 7919 + l.quality * 2500) % 10007 as double) / 10007, 4) end score from labels l",
    "pdf_lines": "select doc_id, ord seq, cast(floor(ord / 8) as bigint) + 1 page, cast(case when type = 'heading' and length(text) < 20 then 18 when type = 'heading' then 14 else 12 end as double) size, round(cast(800 + (ord % 8) * 138 + case when ord % 8 >= 4 then 120 else 0 end as double) / 10, 1) top, text from blocks",
    "dims": "select n_name code, r_name name_en, n_nationkey % 4 <> 0 is_active from nation join region on n_regionkey = r_regionkey",
}
SPARK: dict[str, str] = BOTH | {
    "blocks": r"with l as (select doc_id, pos, trim(line) text from documents lateral view posexplode(split(text,'\n')) as pos,line) select doc_id, cast(row_number() over (partition by doc_id order by pos) - 1 as bigint) ord, case when length(text) < 10 then 'table' when length(text) < 40 then 'heading' else 'paragraph' end type, case when length(text) between 10 and 39 then 1 else 0 end level, text, cast(size(split(text,' ')) as bigint) tok from l where text <> ''",
    "terms": r"with w as (select doc_id, explode(split(lower(text),'[^\\p{L}]+')) tok from documents) select doc_id chunk_id, tok, count(*) n from w where tok <> '' group by doc_id, tok",
    "registry": "select doc_id, case when doc_id % 2 = 0 then sha2(text,256) else sha2(concat(text,' (old)'),256) end content_hash, case when doc_id % 10 = 0 then 'pending' when doc_id % 14 = 0 then 'superseded' else 'indexed' end status, concat(lang,'-',source) title, concat('https://docs.example.com/', cast(doc_id - doc_id % 3 as string)) source_url, 'amazon' publisher, lang country, case when doc_id % 6 = 0 then cast(null as date) else date '2021-07-01' end effective_date, concat('/raw/',cast(doc_id as string)) raw_path from documents",
    "incoming": "select doc_id line_number, sha2(text,256) content_hash, concat(lang,'-',source) title, case when doc_id % 11 = 0 then cast(null as string) else concat('https://docs.example.com/', cast(doc_id - doc_id % 3 + 3 * (doc_id % 2) as string)) end source_url, case when doc_id % 13 = 0 then cast(null as string) when doc_id % 8 = 2 then 'eu_commission' else 'amazon' end publisher, lang country, case when doc_id % 6 = 0 then cast(null as date) else date '2021-07-01' end effective_date, concat('/raw/',cast(doc_id + doc_id % 7 as string)) raw_path from documents",
    "answers": "select conv_id, turn, concat(text, case turn % 4 when 0 then '' when 1 then concat(' [',cast(conv_id % 7 as string),']') when 2 then ' [2][1] [2]' else ' ［3］ [1,2] [9]' end) text, cast(case when conv_id % 11 = 0 then 0 else 5 end as bigint) n_materials from conversations where role = 'assistant'",
    "requests": "select event_id request_id, user_id, ts, concat('q', cast(event_id % 20 as string)) question, event_type country from events",
}
DUCK: dict[str, str] = BOTH | {
    "blocks": r"with l as (select doc_id, u.pos - 1 pos, trim(u.line) as text from documents, lateral (select unnest(string_split(documents.text,chr(10))) line, generate_subscripts(string_split(documents.text,chr(10)),1) pos) u) select doc_id, cast(row_number() over (partition by doc_id order by pos) - 1 as bigint) ord, case when length(text) < 10 then 'table' when length(text) < 40 then 'heading' else 'paragraph' end type, case when length(text) between 10 and 39 then 1 else 0 end level, text, cast(len(string_split(text,' ')) as bigint) tok from l where text <> ''",
    "terms": r"with w as (select doc_id, unnest(regexp_split_to_array(lower(text),'[^\p{L}]+')) tok from documents) select doc_id chunk_id, tok, count(*) n from w where tok <> '' group by doc_id, tok",
    **{k: SPARK[k].replace("as string)", "as varchar)").replace("sha2(text,256)", "sha256(text)").replace("sha2(concat(text,' (old)'),256)", "sha256(concat(text,' (old)'))") for k in ("registry", "incoming", "answers", "requests")},
}
NEEDS = {"pdf_lines": ["blocks"]}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, **instead: DataFrame) -> DataFrame:
    """A derived view as a DataFrame; `instead` has rows for tables by name, where those that can't matter are left out before the view multiplies them."""
    sql = SPARK[name]
    used = {t: instead[t] if t in instead else table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b(from|join) {t}\b", sql)}
    used |= {v: view(spark, sf_dir, v) for v in NEEDS.get(name, [])}
    for t, df in used.items():
        df.createOrReplaceTempView(own := f"{t}_{uuid.uuid4().hex}")
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {own}", sql)
    return spark.sql(sql)


def duck(names: list[str], query: str) -> str:
    """DuckDB SQL of a query over derived views; `query` may begin with further CTEs after a comma."""
    order: list[str] = []
    for n in names:
        order += [*NEEDS.get(n, []), n]
    ctes = ", ".join(f"{n} AS ({DUCK[n]})" for n in dict.fromkeys(order))
    return f"WITH RECURSIVE {ctes}{query}"

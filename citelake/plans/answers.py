"""Queries on answers, calibration, pages, PDF geometry and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import duck, table, view
from ..functions import text as T
from ..operators import calibrate, cite, html, pdfgeom, requests, trace
from ..sources.shared import fresh
from ..streaming import answering, state

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


A = ["answers"]
CITED = r""", x AS (SELECT *, list_transform(regexp_extract_all(text, '[\[［](\d+)[\]］]', 1), lambda x: CAST(x AS BIGINT)) AS raw FROM answers),
c AS (SELECT *, list_filter(raw, lambda v, i: list_position(raw, v) = i) AS nums FROM x)"""


@query(duck(A, CITED + " SELECT conv_id, turn, unnest(nums) AS number FROM c"))
def citation_numbers(spark, sf_dir):
    return view(spark, sf_dir, "answers").select("conv_id", "turn", F.explode(T.cited_numbers(F.col("text"))).alias("number"))


@query(duck(A, CITED + " SELECT conv_id, turn, array_to_string(list_sort(list_filter(nums, lambda v: v BETWEEN 1 AND n_materials)), ',') AS valid, array_to_string(list_filter(nums, lambda v: NOT v BETWEEN 1 AND n_materials), ',') AS invalid FROM c"))
def citation_validity(spark, sf_dir):
    return cite.check(view(spark, sf_dir, "answers")).select("conv_id", "turn", *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("valid", "invalid")))


@query(
    duck(
        A,
        CITED
        + f""", g AS (SELECT *, n_materials = 0 AS none, n_materials = 0 OR len(list_filter(nums, lambda v: v BETWEEN 1 AND n_materials)) = 0 AS degraded, array_to_string(list_filter(nums, lambda v: NOT v BETWEEN 1 AND n_materials), '、') AS bad FROM c)
SELECT conv_id, turn, degraded, CASE WHEN degraded THEN '{cite.NO_EVIDENCE}' ELSE text END AS final_text, CASE WHEN none THEN '' ELSE text END AS raw_text,
    concat_ws('|', CASE WHEN NOT none AND turn % 3 = 0 THEN '{cite.UNDATED}' END, CASE WHEN NOT degraded AND bad <> '' THEN replace('{cite.REMOVED}', '%s', bad) END) AS notes FROM g""",
    )
)
def degraded_answers(spark, sf_dir):
    return cite.degrade(cite.check(view(spark, sf_dir, "answers")), F.col("turn") % 3 == 0).select("conv_id", "turn", "degraded", "final_text", "raw_text", F.array_join("notes", "|").alias("notes"))


@query(duck(A, CITED + f", g AS (SELECT *, n_materials = 0 OR len(list_filter(nums, lambda v: v BETWEEN 1 AND n_materials)) = 0 AS degraded FROM c) SELECT conv_id, turn, CASE WHEN degraded THEN '{cite.NO_EVIDENCE}' ELSE text END AS text, degraded, array_to_string(list_transform(list_sort(list_filter(nums, lambda v: v BETWEEN 1 AND n_materials)), lambda v: 'p' || v), ',') AS cited, array_to_string(list_filter(nums, lambda v: NOT v BETWEEN 1 AND n_materials), ',') AS invalid, true AS cache_hit FROM g"))
def response_round_trip(spark, sf_dir):
    d = cite.degrade(cite.check(view(spark, sf_dir, "answers")))
    null = F.lit(None)
    parent = lambda n: F.struct(
        F.concat(F.lit("p"), n.cast("string")).alias("parent_id"), F.lit("d").alias("doc_id"), F.lit(0.25).alias("score"), F.lit("text \"quoted\"").alias("text"), n.alias("token_count"), F.lit("title").alias("title"), null.cast("string").alias("source_url"),
        null.cast("string").alias("country"), null.cast("string").alias("doc_type"), null.cast("string").alias("publisher"), null.cast("string").alias("effective_date"),
        F.array(F.struct(F.lit("c").alias("chunk_id"), F.lit(0.25).alias("score"), F.lit("é").alias("text"), F.lit(0).cast("long").alias("start_offset"), F.lit(1).cast("long").alias("end_offset"))).alias("matched_children"),
    )
    r = d.select("conv_id", "turn", F.col("final_text").alias("text"), "raw_text", "degraded", "notes", F.transform("valid", parent).alias("cited"), F.col("invalid").alias("invalid_numbers"), null.cast("double").alias("top_score"), F.col("n_materials").alias("parent_count"), F.lit(False).alias("refused"))
    back = cite.decode(cite.encode(r).select("conv_id", "turn", "payload"))
    return back.select("conv_id", "turn", "text", "degraded", F.array_join(F.transform("cited", lambda x: x["parent_id"]), ",").alias("cited"), F.array_join("invalid_numbers", ",").alias("invalid"), "cache_hit")


MATERIALS = ", m AS (SELECT doc_id - doc_id % 5 AS qid, doc_id % 5 + 1 AS position, doc_id - doc_id % 2 AS doc, title, effective_date, CASE WHEN doc_id % 4 > 0 THEN source_url END AS source_url, publisher, country FROM registry)"


def materials(spark, sf_dir):
    r, d = view(spark, sf_dir, "registry"), F.col("doc_id")
    return r.select((d - d % 5).alias("qid"), (d % 5 + 1).alias("position"), (d - d % 2).alias("doc_id"), "title", "effective_date", F.when(d % 4 > 0, F.col("source_url")).alias("source_url"), "publisher", "country", F.lit(None).cast("string").alias("doc_type"))


@query(duck(["registry"], MATERIALS + " SELECT qid, doc AS doc_id, arg_min(title, position) AS title, count(*) AS n FROM m GROUP BY 1, 2"))
def citations_by_document(spark, sf_dir):
    return cite.by_document(materials(spark, sf_dir))


@query(duck(["registry"], MATERIALS + " SELECT qid, bool_or(effective_date IS NULL) AS undated FROM m GROUP BY 1"))
def undated_notes(spark, sf_dir):
    return materials(spark, sf_dir).groupBy("qid").agg(F.bool_or(F.col("effective_date").isNull()).alias("undated"))


@query(
    duck(
        ["registry"],
        MATERIALS
        + """ SELECT qid, string_agg('[' || position || '] ' || title || chr(10) || '    发布机构：' || coalesce(publisher, '未标注') || '  适用国家：' || coalesce(country, '未标注') || '  文档类型：未标注  生效日期：' || coalesce(CAST(effective_date AS VARCHAR), '未标注')
    || chr(10) || '    出处：' || coalesce(source_url, '未登记') || chr(10) || '    ---' || chr(10) || title, chr(10) || chr(10) ORDER BY position) AS context FROM m GROUP BY 1 UNION ALL SELECT DISTINCT qid + 1, '（没有检索到任何材料）' FROM m""",
    )
)
def build_context(spark, sf_dir):
    m = materials(spark, sf_dir).withColumn("text", F.col("title"))
    ids = m.select("qid").distinct()
    return cite.context(m, ids.unionByName(ids.select((F.col("qid") + 1).alias("qid"))))


@query(duck(["registry"], MATERIALS + " SELECT qid, CAST(sum(2000 + doc * 7 % 3000) AS BIGINT) AS tokens, CASE WHEN sum(2000 + doc * 7 % 3000) < 8000 THEN 'low' WHEN sum(2000 + doc * 7 % 3000) < 16000 THEN 'middle' ELSE 'high' END AS budget FROM m GROUP BY 1"))
def recalled_tokens(spark, sf_dir):
    return cite.recalled_tokens(materials(spark, sf_dir).select("qid", (2000 + F.col("doc_id") * 7 % 3000).alias("token_count")))


@query(r"SELECT doc_id, CASE WHEN length(flat) > 240 THEN substr(flat, 1, 240) || '… (' || length(flat) || ')' ELSE flat END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents)".replace("\\\\", "\\"))
def text_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


VALID = """, q AS (SELECT request_id, CASE WHEN request_id % 6 = 0 THEN repeat('x', 2001) WHEN request_id % 6 = 1 THEN '' ELSE question END AS question, CASE WHEN request_id % 6 = 2 THEN repeat('c', 17) ELSE country END AS country, request_id % 6 = 3 AS odd FROM requests)"""


@query(duck(["requests"], VALID + " SELECT request_id, CASE WHEN odd THEN 'unknown key extra' WHEN question = '' THEN 'question is missing' WHEN length(question) > 2000 THEN 'question has more than 2000 characters' WHEN length(country) > 16 THEN 'country has more than 16 characters' END AS error FROM q"))
def request_validation(spark, sf_dir):
    n = F.col("request_id")
    question = F.when(n % 6 == 0, F.repeat(F.lit("x"), F.lit(2001))).when(n % 6 == 1, "").otherwise(F.col("question"))
    country = F.when(n % 6 == 2, F.repeat(F.lit("c"), F.lit(17))).otherwise(F.col("country"))
    body = F.to_json(F.struct(question.alias("question"), country.alias("country"), F.when(n % 6 == 3, 1).alias("extra")))
    return requests.validate(view(spark, sf_dir, "requests").select("request_id", body.alias("body"))).select("request_id", "error")


@query(duck(["requests"], " SELECT request_id, request_id % 3 > 0 AS kept FROM requests"))
def trace_ids(spark, sf_dir):
    given = F.when(F.col("request_id") % 3 > 0, F.concat(F.lit("t_"), F.col("request_id").cast("string"))).otherwise("bad id!")
    r = view(spark, sf_dir, "requests").select("request_id", given.alias("given"))
    return r.withColumn("id", requests.trace_id(F.col("given"))).select("request_id", ((F.col("id") == F.col("given")) & F.col("id").rlike(requests.TRACE)).alias("kept"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN '[\"' || lang || '\",\"' || source || '\"]' END AS list, CASE WHEN doc_id % 3 > 0 THEN lang || '|' || source ELSE '' END AS again FROM documents")
def list_round_trip(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    c = requests.encode_list(F.when(F.col("doc_id") % 3 > 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>")))
    return d.select("doc_id", c.alias("list")).withColumn("again", F.array_join(requests.decode_list(F.col("list")), "|"))


@query(duck(["dims"], " SELECT code || '（' || name_en || '）' AS shown, code FROM dims"))
def dimension_options(spark, sf_dir):
    return requests.options(view(spark, sf_dir, "dims"), "code", "name_en").select(F.explode("options").alias("shown", "code"))


C = ["cases"]


@query(duck(C, ", s AS (SELECT *, coalesce(score, -1.0) AS t FROM cases), d AS (SELECT DISTINCT t AS threshold FROM s) SELECT threshold, (SELECT count(*) FROM s WHERE t < threshold AND expected_behavior = 'refuse') AS blocked, (SELECT count(*) FROM s WHERE t < threshold AND expected_behavior = 'answer') AS missed FROM d WHERE missed <= 100"))
def threshold_sweep(spark, sf_dir):
    return calibrate.sweep(view(spark, sf_dir, "cases"), 100)


@query(duck(C, " SELECT expected_behavior, count(*) AS n, min(score) AS low, median(score) AS middle, max(score) AS high FROM cases WHERE score IS NOT NULL GROUP BY 1"))
def class_distribution(spark, sf_dir):
    return calibrate.describe(view(spark, sf_dir, "cases"))


@query(duck(C, ", e AS (SELECT min(score) FILTER (expected_behavior = 'answer') AS low_answer, max(score) FILTER (expected_behavior = 'refuse') AS high_refuse FROM cases) SELECT low_answer, high_refuse, count(*) FILTER (expected_behavior = 'refuse' AND score >= low_answer) AS refuse_above, count(*) FILTER (expected_behavior = 'answer' AND score <= high_refuse) AS answer_below FROM cases, e GROUP BY 1, 2"))
def separability(spark, sf_dir):
    return calibrate.separability(view(spark, sf_dir, "cases"))


@query(duck(C, " SELECT category, CASE WHEN score IS NULL OR score < 0.3 THEN 'refused' WHEN score < 0.5 THEN 'degraded' ELSE 'normal' END AS outcome, count(*) AS n FROM cases GROUP BY 1, 2"))
def outcome_by_category(spark, sf_dir):
    s = F.col("score")
    return view(spark, sf_dir, "cases").groupBy("category", cite.outcome(s.isNull() | (s < 0.3), s < 0.5).alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, trim(u) AS source FROM (SELECT doc_id, unnest(string_split(concat(lang, '; ', source, ' ;;', lang), ';')) AS u FROM documents) WHERE trim(u) <> ''")
def eval_sources_exploded(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(T.split_sources(F.concat("lang", F.lit("; "), "source", F.lit(" ;;"), "lang"))).alias("source"))


HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)), '^www\.', '')"


def sites(spark, sf_dir):
    """Half of the hosts that the pages have, with a selector each."""
    hosts = table(spark, sf_dir, "pages").select(T.host(F.col("url")).alias("host")).distinct().filter("length(host) % 2 = 0")
    return hosts.withColumn("selector", F.when(F.length("host") % 4 == 0, "article").otherwise("no-such-id"))


@query(f"SELECT page_id, host, CASE WHEN length(host) % 4 = 0 THEN 'article' WHEN length(host) % 2 = 0 THEN 'no-such-id' END AS selector FROM (SELECT page_id, {HOST} AS host FROM pages)")
def site_selector_lookup(spark, sf_dir):
    return html.selectors(table(spark, sf_dir, "pages"), sites(spark, sf_dir)).select("page_id", "host", "selector")


@query(f"SELECT page_id, CASE WHEN url IS NULL THEN 'no source_url' WHEN length(host) % 2 = 1 THEN 'no selector for its host' WHEN length(host) % 4 > 0 THEN 'nothing in the container' END AS error FROM (SELECT page_id, CASE WHEN page_id % 13 > 0 THEN url END AS url, {HOST} AS host FROM pages)")
def html_file_outcomes(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 13 > 0, F.col("url")).alias("url"), F.col("html").cast("binary").alias("content"))
    return html.parse_files(p, sites(spark, sf_dir))[1]


@query(r"SELECT doc_id AS page_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ord, text FROM (SELECT doc_id, pos, trim(regexp_replace(line, '\s+', ' ', 'g')) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)) WHERE text <> ''")
def plain_text_blocks(spark, sf_dir):
    return html.text_blocks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text")).select("page_id", "ord", "text")


@query("SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'pdf' WHEN page_id % 10 <> 1 THEN 'html' END AS format FROM pages")
def format_sniff(spark, sf_dir):
    n = F.col("page_id") % 10
    content = F.when(n == 0, F.concat(F.lit("%PDF-1.7\n"), "html")).when(n == 1, F.concat(F.lit("plain text, a < b "), "html")).when(n == 2, F.concat(F.lit("\ufeff \r\n\t"), "html")).otherwise(F.col("html")).cast("binary")
    content = F.when(n == 3, F.concat(F.lit(b"\xff\xfe"), F.col("html").cast("binary"))).otherwise(content)
    return table(spark, sf_dir, "pages").select("page_id", html.sniff(content).alias("format"))


TITLE = r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages"""


@query(TITLE)
def html_title(spark, sf_dir):
    return html.titles(table(spark, sf_dir, "pages"))


@query()
def html_blocks(spark, sf_dir):
    return html.blocks(table(spark, sf_dir, "pages"))


@query("SELECT page_id AS doc_id, CAST(CASE WHEN page_id % 3 > 0 THEN 1 WHEN page_id % 2 = 0 THEN 2 END AS INTEGER) AS tier, CASE WHEN page_id % 3 > 0 THEN '1:true' ELSE '1:false' END || CASE WHEN page_id % 2 = 0 THEN ' 2:true' ELSE '' END AS log FROM pages")
def tier_routing(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    d = F.col("doc_id")
    hard = html.difficulty(F.lit("html"), d % 2 == 1, F.lit(None).cast("double")).alias("difficulty")
    a = p.select("doc_id", F.lit(1).alias("tier"), hard, (d % 3 > 0).alias("passed"))
    routed = html.route(a.unionByName(p.select("doc_id", F.lit(2).alias("tier"), hard, F.lit(True).alias("passed"))))
    return routed.select("doc_id", "tier", F.array_join(F.transform("log", lambda x: F.concat(x["tier"].cast("string"), F.lit(":"), x["passed"].cast("string"))), " ").alias("log"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN CASE WHEN page_id % 4 = 0 AND length(url) >= 50 THEN 'simple' ELSE 'hard' END WHEN page_id % 3 = 0 THEN 'simple' ELSE 'hard' END AS difficulty FROM pages")
def difficulty_probe(spark, sf_dir):
    n = F.col("page_id")
    d = html.difficulty(F.when(n % 2 == 0, "pdf").otherwise("html"), n % 3 == 0, F.when(n % 4 == 0, F.length("url").cast("double")))
    return table(spark, sf_dir, "pages").select("page_id", d.alias("difficulty"))


P = ["pdf_lines"]
BODY = ", bs AS (SELECT doc_id, size AS body FROM (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, size) AS k FROM pdf_lines GROUP BY 1, 2) WHERE k = 1), lv AS (SELECT doc_id, size, dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC) AS level FROM (SELECT DISTINCT p.doc_id, size FROM pdf_lines p JOIN bs ON bs.doc_id = p.doc_id WHERE size > body))"


@query(duck(P, BODY + " SELECT doc_id, body FROM bs"))
def pdf_body_size(spark, sf_dir):
    return pdfgeom.body_size(view(spark, sf_dir, "pdf_lines"))


@query(duck(P, BODY + " SELECT doc_id, size, level FROM lv"))
def pdf_heading_levels(spark, sf_dir):
    return pdfgeom.heading_levels(view(spark, sf_dir, "pdf_lines"))


@query(
    duck(
        P,
        BODY
        + r""", l AS (SELECT p.*, lv.level, lag(p.page) OVER w AS pp, lag(p.top) OVER w AS pt, lag(lv.level) OVER w AS pl FROM pdf_lines p LEFT JOIN lv ON lv.doc_id = p.doc_id AND lv.size = p.size WINDOW w AS (PARTITION BY p.doc_id ORDER BY p.seq)),
k AS (SELECT *, CAST(sum(CASE WHEN pp IS NULL OR level IS NOT NULL OR pl IS NOT NULL OR pp <> page OR top - pt > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS BIGINT) AS ord FROM l)
SELECT doc_id, ord, CASE WHEN max(level) IS NULL THEN 'paragraph' ELSE 'heading' END AS type, coalesce(max(level), 0) AS level, trim(regexp_replace(string_agg(text, ' ' ORDER BY seq), '\s+', ' ', 'g')) AS text FROM k GROUP BY doc_id, ord""",
    )
)
def pdf_blocks(spark, sf_dir):
    return pdfgeom.build_blocks(view(spark, sf_dir, "pdf_lines"))


@query(duck(P, r", n AS (SELECT doc_id, seq, top, CASE WHEN seq % 8 = 7 THEN page || ' / 9' ELSE text END AS text FROM pdf_lines) SELECT doc_id, seq FROM n WHERE NOT (top >= 0.9 * 200 AND regexp_matches(trim(text), '^\d+\s*/\s*\d+$'))"))
def page_number_filter(spark, sf_dir):
    n = view(spark, sf_dir, "pdf_lines").withColumn("text", F.when(F.col("seq") % 8 == 7, F.concat(F.col("page").cast("string"), F.lit(" / 9"))).otherwise(F.col("text")))
    return pdfgeom.drop_page_numbers(n, 200.0).select("doc_id", "seq")


def pdf_words(spark, sf_dir, *more):
    tops = F.array(*(F.round(F.col("top") + F.lit(k) * 0.4, 1) for k in range(3)))  # three heights a line
    lines = view(spark, sf_dir, "pdf_lines").select("doc_id", "page", *more, tops.alias("tops"), "text").select("doc_id", "page", "tops", *more, F.posexplode(F.split("text", " ")).alias("i", "text"))
    top = F.col("tops")[F.col("i") % 3]
    return lines.select("doc_id", "page", top.alias("top"), (top + 10).alias("bottom"), (F.col("i") * 30.0).alias("x0"), (F.col("i") * 30.0 + 20).alias("x1"), "text", *more)


# Words of a row read by top, then x.
WORDS = ", w AS (SELECT doc_id, page, seq, size, i, round(top + ((i - 1) % 3) * 0.4, 1) AS top, (i - 1) * 30.0 AS x0, s[i] AS text FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (SELECT *, string_split(text, ' ') AS s FROM pdf_lines)))"
ROW = r"trim(regexp_replace(string_agg(text, ' ' ORDER BY top, x0), '\s+', ' ', 'g')) AS text"


@query(duck(P, WORDS + f" SELECT doc_id, page, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY seq) - 1 AS line, {ROW} FROM w GROUP BY doc_id, page, seq"))
def words_to_lines(spark, sf_dir):
    return pdfgeom.words_to_lines(pdf_words(spark, sf_dir))


@query(duck(P, ", w AS (SELECT doc_id, page, round(top + ((i - 1) % 3) * 0.4, 1) AS top, (i - 1) * 30.0 AS x0, s[i] AS text FROM (SELECT doc_id, page, top, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT *, string_split(text, ' ') AS s FROM pdf_lines))) SELECT doc_id, page, x0, top, text FROM w WHERE NOT (x0 + 10 BETWEEN 50 AND 200 AND top + 5 BETWEEN 100 AND 150 AND page % 2 = 1)"))
def words_outside_tables(spark, sf_dir):
    w = pdf_words(spark, sf_dir)
    boxes = view(spark, sf_dir, "pdf_lines").select("doc_id", "page").distinct().filter("page % 2 = 1").select("doc_id", "page", F.lit(50.0).alias("left"), F.lit(200.0).alias("right"), F.lit(100.0).alias("upper"), F.lit(150.0).alias("lower"))
    return pdfgeom.outside_tables(w, boxes).select("doc_id", "page", "x0", "top", "text")


@query(
    duck(
        P,
        WORDS
        + f""", k AS (SELECT * FROM w WHERE NOT (page % 2 = 1 AND top + 5 BETWEEN 100 AND 150 AND (x0 + 10 BETWEEN 50 AND 200 OR x0 + 10 BETWEEN 300 AND 400))),
l AS MATERIALIZED (SELECT * FROM (SELECT doc_id, page, seq, max(size) AS size, min(top) AS top, {ROW} FROM k GROUP BY doc_id, page, seq) WHERE text <> ''),
b AS (SELECT doc_id, size AS body FROM (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, size) AS r FROM l GROUP BY 1, 2) WHERE r = 1),
v AS (SELECT doc_id, page, size, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY size DESC) AS level FROM (SELECT DISTINCT l.doc_id, page, size FROM l JOIN b ON b.doc_id = l.doc_id WHERE size > body)),
g AS (SELECT l.*, v.level, lag(l.top) OVER p AS pt, lag(v.level) OVER p AS pl FROM l LEFT JOIN v ON v.doc_id = l.doc_id AND v.page = l.page AND v.size = l.size WINDOW p AS (PARTITION BY l.doc_id, l.page ORDER BY l.seq)),
o AS (SELECT *, sum(CASE WHEN pt IS NULL OR level IS NOT NULL OR pl IS NOT NULL OR top - pt > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY seq) AS place FROM g),
x AS (SELECT doc_id, page, 0 AS kind, place, CASE WHEN max(level) IS NULL THEN 'paragraph' ELSE 'heading' END AS type, coalesce(max(level), 0) AS level, string_agg(text, ' ' ORDER BY seq) AS text FROM o GROUP BY doc_id, page, place
UNION ALL SELECT doc_id, page, 1, n, 'table', 0, 'p' || page || ' | ' || chr(10) || doc_id || ' x | y' || n FROM (SELECT DISTINCT doc_id, page FROM pdf_lines WHERE page % 4 = 1), (SELECT unnest([1, 2]) AS n) WHERE doc_id IN (SELECT doc_id FROM l))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, kind, place) - 1 AS ord, page, type, level, text FROM x""",
    )
)
def page_blocks(spark, sf_dir):
    """From words and tables to blocks: two tables on odd pages, those of each second one are blank."""
    w = pdf_words(spark, sf_dir, "size")
    pages = view(spark, sf_dir, "pdf_lines").select("doc_id", "page").distinct().filter("page % 2 = 1").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    text = lambda c: F.when(F.col("page") % 4 == 1, c)
    cells = F.array(F.array(text(F.concat(F.lit("p"), "page")), F.lit(None).cast("string")), F.array(F.lit(""), F.lit(" ")), F.array(text(F.concat("doc_id", F.lit("  x"))), text(F.concat(F.lit(" y"), "n"))))
    second = F.col("n") == 2
    side = lambda a, b: F.when(second, F.lit(b)).otherwise(F.lit(a))
    boxes = pages.select("doc_id", "page", "n", side(50.0, 300.0).alias("left"), side(200.0, 400.0).alias("right"), F.lit(100.0).alias("upper"), F.lit(150.0).alias("lower"), cells.alias("cells"))
    return pdfgeom.page_blocks(w, boxes)


@query(duck(P, " SELECT doc_id, page, seq, size, top, replace(text, ' ', '') AS text FROM pdf_lines WHERE replace(text, ' ', '') <> ''"))
def span_lines(spark, sf_dir):
    lines = view(spark, sf_dir, "pdf_lines").select("doc_id", "page", "seq", "top", "size", F.posexplode(F.split("text", " ")).alias("span", "text"))
    return pdfgeom.span_lines(lines.withColumn("size", F.when(F.col("span") > 0, F.col("size") - 1).otherwise(F.col("size"))))


@query("SELECT doc_id, nullif(concat_ws(chr(10), CASE WHEN doc_id % 3 > 0 THEN lang || ' |  | ' || source END, CASE WHEN doc_id % 2 = 0 THEN source || ' | x y' END), '') AS text FROM documents")
def table_texts(spark, sf_dir):
    none = F.lit(None).cast("string")
    first = F.when(F.col("doc_id") % 3 > 0, F.array(F.concat(F.lit(" "), "lang"), none, F.col("source"))).otherwise(F.array(none, F.lit("  ")))
    second = F.when(F.col("doc_id") % 2 == 0, F.array(F.col("source"), F.lit("x\n y"))).otherwise(F.array(F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", pdfgeom.table_text(F.array(first, second)).alias("text"))


PAGES = ", g AS (SELECT doc_id, page, sum(length(text)) AS chars FROM pdf_lines GROUP BY 1, 2), n AS (SELECT doc_id, max(page) AS n FROM g GROUP BY 1)"


@query(duck(P, PAGES + " SELECT g.doc_id, round(avg(chars), 6) AS chars FROM g JOIN n ON n.doc_id = g.doc_id WHERE page IN (1, n // 2 + 1, n) GROUP BY 1"))
def sampled_pages(spark, sf_dir):
    g = view(spark, sf_dir, "pdf_lines").groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("chars"))
    return pdfgeom.sampled_pages(g).select("doc_id", F.round("chars", 6).alias("chars"))


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3")
def session_last_n(spark, sf_dir):
    return state.last_messages(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn")


GAP = "date_diff('microsecond', lag(ts) OVER w, ts)"


@query(f"SELECT event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT event_id, user_id, ts, CASE WHEN {GAP} >= 3600000000 THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def session_ttl_islands(spark, sf_dir):
    return state.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("event_id", "session")


@query(
    duck(
        ["requests"],
        """, o AS MATERIALIZED (SELECT request_id, question, epoch_us(ts) AS us, row_number() OVER (PARTITION BY question ORDER BY ts, request_id) AS k FROM requests),
h AS (SELECT question, k, request_id, us, us AS written, false AS hit FROM o WHERE k = 1
UNION ALL SELECT o.question, o.k, o.request_id, o.us, CASE WHEN o.us - h.written < 600000000 THEN h.written ELSE o.us END, o.us - h.written < 600000000 FROM h JOIN o ON o.question = h.question AND o.k = h.k + 1)
SELECT request_id, hit FROM h""",
    )
)
def cache_hits(spark, sf_dir):
    return state.cache_hits(view(spark, sf_dir, "requests"), "question", "ts", "request_id").select("request_id", "hit")


@query(duck(["requests"], " SELECT request_id, sha256(concat_ws(chr(31), coalesce('=' || question, '-'), coalesce('=' || country, '-'), '-')) AS digest FROM requests"))
def cache_digest(spark, sf_dir):
    return view(spark, sf_dir, "requests").select("request_id", T.cache_digest(F.col("question"), F.col("country"), F.lit(None).cast("string")).alias("digest"))


def streamed(spark, sf_dir, columns, step, mode, order="ts", batches=5):
    """A table as a stream of micro-batches in the order of a column, drained into the shared folder; the result is read back as a batch."""
    root = fresh(spark, "stream")
    events = table(spark, sf_dir, "events")
    place = F.col(order).cast("timestamp").cast("double") if order == "ts" else F.col(order).cast("double")
    cuts = events.select(place.alias("x")).approxQuantile("x", [i / batches for i in range(1, batches)], 0.01)
    for i in range(batches):  # one after the other, as the source takes files by their time
        low, high = cuts[i - 1 : i] if i else [], cuts[i : i + 1]
        part = events
        for bound, keep in ((low, lambda c: place >= c), (high, lambda c: place < c)):
            if bound:
                part = part.filter(keep(bound[0]))
        part.coalesce(1).write.parquet(f"{root}/in/{i}")
    out = step(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*").selectExpr(*columns))

    def keep(df, batch):  # under its own name: a batch that is tried again replaces what it wrote
        df.write.mode("overwrite").parquet(f"{root}/out/batch={batch}")

    # A drain ends with its data: batches without data, which lifetimes by the machine's clock would ask for again and again, are off.
    flag, before = "spark.sql.streaming.noDataMicroBatches.enabled", spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    spark.conf.set(flag, "false")
    try:
        q = out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    finally:
        spark.conf.set(flag, before)
    q.awaitTermination()
    return spark.read.schema(out.schema.add("batch", "long")).parquet(f"{root}/out")


@query(
    """WITH c AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) >= 3600000000 THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM c),
k AS (SELECT *, max(session) OVER (PARTITION BY user_id) AS newest, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM s)
SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n, '[' || string_agg('"' || event_type || '"', ', ' ORDER BY ts, event_id) || ']' AS messages FROM k WHERE session = newest AND back <= 20 GROUP BY user_id"""
)
def session_stream(spark, sf_dir):
    out = streamed(spark, sf_dir, ["cast(user_id as string) key", "cast(ts as timestamp) ts", "event_type text"], state.session_stream, "update")
    return out.groupBy("key").agg(F.max_by(F.struct("n", "messages"), "batch").alias("last")).select("key", "last.n", "last.messages")


@query()
def cache_stream(spark, sf_dir):
    return streamed(spark, sf_dir, ["concat('q', cast(event_id % 20 as string)) key", "event_id id", "cast(ts as timestamp) ts"], state.cache_stream, "append").select("id", "hit")


ORACLES["cache_stream"] = ORACLES["cache_hits"].replace("SELECT request_id, hit FROM h", "SELECT request_id AS id, hit FROM h")


ASKED = ["event_id id", "cast(ts as timestamp) ts", "case when event_id % 3 = 0 then cast(user_id as string) end session_id", "concat('q', cast(event_id % 20 as string)) question", "event_type country",
    "concat(cast(event_id % 5 as string), case event_id % 4 when 0 then '' when 1 then ' [1]' when 2 then ' [2][9][2]' else ' [7]' end) prompt", "case when event_id % 13 > 0 then cast(event_id % 100 as double) / 100 end top_score", "cast(case when event_id % 11 = 0 then 0 else 5 end as bigint) n_materials", "event_id % 6 = 0 undated"]


def echo(prompts):
    """A test model: it answers with its prompt and cannot bear a 4."""
    if any(p.startswith("4") for p in prompts):
        raise RuntimeError("overloaded")
    return prompts


#: In order of arrival; the clock of a key is the greatest time so far. Hits are a recursion over the requests of a key, each row naming the request whose answer it has.
ANSWERED = f"""WITH RECURSIVE r AS (SELECT event_id AS id, ts, event_id % 3 > 0 AS single, CASE WHEN event_id % 3 = 0 THEN 's:' || user_id ELSE 'c:' || sha256(concat_ws(chr(31), '=q' || event_id % 20, coalesce('=' || event_type, '-'))) END AS key,
    event_id % 5 || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' [1]' WHEN 2 THEN ' [2][9][2]' ELSE ' [7]' END AS prompt, event_id % 13 = 0 OR event_id % 100 < 30 AS refused, event_id % 11 = 0 AS none, event_id % 5 = 4 AS broken, event_id % 4 AS kind, event_id % 6 = 0 AS undated FROM events),
o AS (SELECT *, NOT refused AND NOT none AND broken AS failed, max(ts) OVER (PARTITION BY key ORDER BY id) AS clock, row_number() OVER (PARTITION BY key ORDER BY id) AS k FROM r),
h(key, k, id, hit, writer, written) AS (SELECT key, k, id, false, id, CASE WHEN NOT failed THEN clock END FROM o WHERE single AND k = 1
    UNION ALL SELECT o.key, o.k, o.id, h.written IS NOT NULL AND date_diff('microsecond', h.written, o.clock) < 600000000, CASE WHEN h.written IS NOT NULL AND date_diff('microsecond', h.written, o.clock) < 600000000 THEN h.writer WHEN o.failed THEN o.id ELSE o.id END,
        CASE WHEN h.written IS NOT NULL AND date_diff('microsecond', h.written, o.clock) < 600000000 THEN h.written WHEN o.failed THEN h.written ELSE o.clock END FROM h JOIN o ON o.key = h.key AND o.k = h.k + 1),
s AS (SELECT *, max(CASE WHEN NOT failed THEN clock END) OVER (PARTITION BY key ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM o WHERE NOT single),
cut AS (SELECT *, sum(CASE WHEN date_diff('microsecond', last, clock) >= 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY id) AS session FROM s),
n AS (SELECT id, least(20, 2 * count(*) FILTER (NOT failed) OVER (PARTITION BY key, session ORDER BY id)) AS messages FROM cut),
a AS (SELECT id AS writer, CASE WHEN refused THEN 'refused' WHEN none THEN 'degraded' WHEN broken THEN 'failed' WHEN kind IN (0, 3) THEN 'degraded' ELSE 'normal' END AS outcome, CASE WHEN refused OR none THEN '' WHEN broken THEN 'RuntimeError: overloaded' ELSE prompt END AS raw_text,
    CASE WHEN NOT refused AND NOT none AND broken THEN NULL WHEN refused OR none OR kind IN (0, 3) THEN '{cite.NO_EVIDENCE}' ELSE prompt END AS text,
    CASE WHEN refused OR none OR broken THEN '' ELSE concat_ws('|', CASE WHEN undated THEN '{cite.UNDATED}' END, CASE WHEN kind = 2 THEN replace('{cite.REMOVED}', '%s', '9') END) END AS notes,
    CASE WHEN refused OR none OR broken THEN '' WHEN kind = 1 THEN '1' WHEN kind = 2 THEN '2' ELSE '' END AS cited, CASE WHEN refused OR none OR broken THEN '' WHEN kind = 2 THEN '9' WHEN kind = 3 THEN '7' ELSE '' END AS invalid FROM o)
SELECT o.id, o.key, coalesce(h.hit, false) AS hit, CAST(coalesce(n.messages, 0) AS BIGINT) AS messages, a.outcome, a.text, a.raw_text, a.notes, a.cited, a.invalid FROM o LEFT JOIN h ON h.id = o.id LEFT JOIN n ON n.id = o.id JOIN a ON a.writer = coalesce(h.writer, o.id)"""


def flat(df):
    return df.select("id", "key", "hit", "messages", "outcome", "text", "raw_text", F.array_join("notes", "|").alias("notes"), *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("cited", "invalid")))


@query(ANSWERED)
def answered_requests(spark, sf_dir):
    """Every event as a request, answered in order of arrival."""
    return flat(answering.answered(table(spark, sf_dir, "events").selectExpr(*ASKED), echo, 0.3))


@query(ANSWERED)
def answer_stream(spark, sf_dir):
    """The same from a stream of several micro-batches."""
    return flat(streamed(spark, sf_dir, ASKED, lambda df: answering.answer_stream(df, echo, 0.3), "append", "event_id"))


#: Answers with numbers in several forms, and what they cite: the turn before, in which each third answer's number is another one.
SAID = "SELECT conv_id, turn, text || CASE conv_id % 6 WHEN 0 THEN ' 1,' || lpad(CAST(turn * 7 % 1000 AS VARCHAR), 3, '0') || '.50 [1]' WHEN 1 THEN ' EUR ' || turn || ',5 % and -3 [1]' WHEN 2 THEN ' 0' || turn || '0.0 2021-07-01' WHEN 3 THEN ' +12 ‰ (art. 2.1.' || turn || ')' WHEN 4 THEN ' no number [2]' ELSE ' 1.' || '234.' || '567 ' || turn END AS text FROM conversations WHERE role = 'assistant'"
CITES = "SELECT conv_id, turn + 1 AS turn, text || CASE conv_id % 6 WHEN 0 THEN ' 1' || lpad(CAST(turn * 7 % 1000 + 7 AS VARCHAR), 3, '0') || ',5' WHEN 1 THEN ' −3 x ' || (turn + 1) || '.50 percent' WHEN 2 THEN ' 7 ' || (turn + 1) || '0 [01]' WHEN 3 THEN ' 12‰ 2.1.' || (turn + turn % 3) ELSE ' 1234567 ' || turn END AS passage FROM conversations WHERE role = 'user'"


def _numbers_sql(text: str) -> str:
    plain = rf"regexp_replace(regexp_replace({text}, '[\[［](\d+)[\]］]', ' ', 'g'), '([0-9A-Za-z])[-−]([0-9])', '\1 \2', 'g')"
    unit = "CASE WHEN regexp_matches(x, '(%|percent)$') THEN '%' WHEN regexp_matches(x, '‰$') THEN '‰' ELSE '' END"
    core = r"regexp_replace(replace(regexp_replace(x, ' ?(%|‰|percent)$', ''), '−', '-'), '^\+', '')"
    step = lambda expr, over: f"list_transform({over}, lambda x: {expr})"
    # Each step maps a list of {c: core, u: unit}.
    first = step(f"{{'c': {core}, 'u': {unit}}}", f"regexp_extract_all({plain}, '[-−+]?[0-9]+(?:[.,''][0-9]+)*(?: ?(?:%|‰|percent))?')")
    two = step(r"{'c': CASE WHEN regexp_matches(x.c, '^-?[0-9]{1,3}([,''][0-9]{3})+(\.[0-9]+)?$') THEN replace(replace(x.c, ',', ''), '''', '') WHEN regexp_matches(x.c, '^-?[0-9]{1,3}(\.[0-9]{3})+(,[0-9]+|\.[0-9]{3})$') THEN replace(replace(x.c, '.', ''), ',', '.') WHEN regexp_matches(x.c, '^-?[0-9]+,[0-9]+$') THEN replace(x.c, ',', '.') ELSE x.c END, 'u': x.u}", first)
    three = step(r"{'c': regexp_replace(x.c, '^(-?)0+([0-9])', '\1\2'), 'u': x.u}", two)
    four = step(r"CASE WHEN regexp_matches(x.c, '^-?[0-9]+\.[0-9]+$') THEN regexp_replace(x.c, '\.?0+$', '') ELSE x.c END || x.u", three)
    return four


TRACED = f"""WITH said AS ({SAID}), cites AS ({CITES}), a AS (SELECT conv_id, turn, {_numbers_sql("text")} AS raw FROM said), own AS (SELECT conv_id, turn, list_filter(raw, lambda v, i: list_position(raw, v) = i) AS ns FROM a),
p AS (SELECT conv_id, turn, list_distinct(flatten(list({_numbers_sql("passage")}))) AS there FROM cites GROUP BY 1, 2)
SELECT own.conv_id, own.turn, CAST(len(ns) AS BIGINT) AS numbers, CAST(len(list_filter(ns, lambda v: list_contains(coalesce(there, []), v))) AS BIGINT) AS found, array_to_string(list_filter(ns, lambda v: NOT list_contains(coalesce(there, []), v)), ' ') AS missing FROM own LEFT JOIN p ON p.conv_id = own.conv_id AND p.turn = own.turn"""


def said(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    c.createOrReplaceTempView("said_conversations")
    as_spark = lambda sql: sql.replace("FROM conversations", "FROM said_conversations").replace("VARCHAR", "STRING")
    return spark.sql(as_spark(SAID)), spark.sql(as_spark(CITES))


@query(TRACED)
def numeric_traceability(spark, sf_dir):
    return trace.traced(*said(spark, sf_dir), ["conv_id", "turn"]).withColumn("missing", F.array_join("missing", " "))


@query(
    f"""WITH t AS ({TRACED}), r AS (SELECT t.*, conv_id % 3 AS category, conv_id % 5 > 0 AS wanted, CASE WHEN conv_id % 4 = 0 THEN 'refused' WHEN conv_id % 6 IN (2, 3, 5) THEN 'degraded' ELSE 'normal' END AS outcome, CASE WHEN conv_id % 6 < 2 THEN 1 ELSE 0 END AS n_valid, CASE WHEN conv_id % 6 = 4 THEN 1 ELSE 0 END AS n_invalid FROM t)
SELECT category, count(*) AS n, sum(found) FILTER (outcome = 'normal') / nullif(sum(numbers) FILTER (outcome = 'normal'), 0) AS traceability, sum(n_valid) FILTER (outcome = 'normal') / nullif(sum(n_valid + n_invalid) FILTER (outcome = 'normal'), 0) AS validity,
    count(*) FILTER (NOT wanted AND outcome <> 'normal') / nullif(count(*) FILTER (NOT wanted), 0) AS refusal, count(*) FILTER (wanted AND outcome = 'refused') / nullif(count(*) FILTER (wanted), 0) AS false_block FROM r GROUP BY ROLLUP (category)"""
)
def acceptance_rates(spark, sf_dir):
    c = F.col("conv_id")
    t = trace.traced(*said(spark, sf_dir), ["conv_id", "turn"])
    rows = t.select(
        (c % 3).alias("category"), (c % 5 > 0).alias("should_answer"), F.when(c % 4 == 0, "refused").when((c % 6).isin(2, 3, 5), "degraded").otherwise("normal").alias("outcome"),
        F.when(c % 6 < 2, 1).otherwise(0).alias("n_valid"), F.when(c % 6 == 4, 1).otherwise(0).alias("n_invalid"), "numbers", "found",
    )
    return trace.acceptance(rows, "category")

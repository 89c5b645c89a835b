"""Queries on the corpus side: quality, chunks, import decisions, index rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import duck, table, view
from ..functions import text as T
from ..operators import chunk, decide, importing, index, quality
from ..sources import tables

QUERIES, ORACLES = {}, {}
BOUNDS = (100, 200, 30)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat, CAST(length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS BIGINT) AS n FROM documents")
def normalised_blocks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse(F.col("text")).alias("flat")).withColumn("n", F.length("flat").cast("long"))


QUALITY = """, c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, text) AS copies FROM blocks),
m AS (SELECT doc_id, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS total_chars, count(*) AS blocks, count(*) FILTER (type = 'heading') AS headings,
    coalesce(count(*) FILTER (type <> 'heading' AND length(text) < 10) / nullif(count(*) FILTER (type <> 'heading'), 0), 0.0) AS fragment_ratio,
    count(*) FILTER (copies > 1) / count(*) AS duplicate_ratio,
    sum(length(text) - length(regexp_replace(text, '[\\x{FFFD}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{E000}-\\x{F8FF}]', '', 'g'))) / nullif(sum(length(text)) + count(*) - 1, 0) AS garbage_ratio FROM c GROUP BY doc_id)""".replace("\\\\", "\\")


@query(duck(["blocks"], QUALITY + " SELECT doc_id, total_chars, blocks, headings, round(fragment_ratio, 6) AS fragment_ratio, round(duplicate_ratio, 6) AS duplicate_ratio, round(garbage_ratio, 6) AS garbage_ratio FROM m"))
def quality_metrics(spark, sf_dir):
    r = quality.assess(view(spark, sf_dir, "blocks"))
    return r.select("doc_id", "total_chars", "blocks", "headings", *(F.round(c, 6).alias(c) for c in ("fragment_ratio", "duplicate_ratio", "garbage_ratio")))


@query(duck(["blocks"], QUALITY + " SELECT doc_id, f AS failure FROM (SELECT doc_id, unnest(list_filter([CASE WHEN total_chars < 200 THEN 'chars' END, CASE WHEN garbage_ratio > 0.01 THEN 'garbage' END, CASE WHEN fragment_ratio > 0.2 THEN 'fragments' END, CASE WHEN duplicate_ratio > 0.25 THEN 'duplicates' END], lambda x: x IS NOT NULL)) AS f FROM m)"))
def quality_failures(spark, sf_dir):
    return quality.assess(view(spark, sf_dir, "blocks")).select("doc_id", F.explode("failures").alias("failure"))


@query(duck(["blocks"], " SELECT doc_id, text, count(*) AS copies FROM blocks GROUP BY 1, 2 HAVING count(*) > 1"))
def duplicate_blocks(spark, sf_dir):
    return view(spark, sf_dir, "blocks").groupBy("doc_id", "text").agg(F.count("*").alias("copies")).filter("copies > 1")


@query(r"SELECT doc_id, CASE WHEN length(text) = 0 THEN 1.0 ELSE round((length(text) - length(regexp_replace(text, '[\x{FFFD}\x00-\x08\x0b\x0c\x0e-\x1f\x{E000}-\x{F8FF}]', '', 'g'))) / CAST(length(text) AS DOUBLE), 6) END AS ratio FROM documents")
def garbage_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.garbage_ratio(F.col("text")), 6).alias("ratio"))


PARENTS = """, pf AS (SELECT doc_id, ord, tok, 0 AS parent, tok AS acc FROM blocks WHERE ord = 0
UNION ALL SELECT b.doc_id, b.ord, b.tok,
    CASE WHEN pf.acc >= 200 OR (pf.acc >= 100 AND b.type = 'heading') THEN pf.parent + 1 ELSE pf.parent END,
    CASE WHEN pf.acc >= 200 OR (pf.acc >= 100 AND b.type = 'heading') THEN b.tok ELSE pf.acc + b.tok END
    FROM pf JOIN blocks b ON b.doc_id = pf.doc_id AND b.ord = pf.ord + 1),
pb AS (SELECT pf.doc_id, pf.ord, pf.tok, pf.parent, b.text, row_number() OVER (PARTITION BY pf.doc_id, pf.parent ORDER BY pf.ord) AS k,
    coalesce(sum(length(b.text) + 1) OVER (PARTITION BY pf.doc_id, pf.parent ORDER BY pf.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM pf JOIN blocks b ON b.doc_id = pf.doc_id AND b.ord = pf.ord)"""
CHILDREN = PARENTS + """, cf AS (SELECT doc_id, parent, k, ord, tok, text, s, 0 AS child, tok AS acc FROM pb WHERE k = 1
UNION ALL SELECT b.doc_id, b.parent, b.k, b.ord, b.tok, b.text, b.s, CASE WHEN cf.acc >= 30 THEN cf.child + 1 ELSE cf.child END, CASE WHEN cf.acc >= 30 THEN b.tok ELSE cf.acc + b.tok END
    FROM cf JOIN pb b ON b.doc_id = cf.doc_id AND b.parent = cf.parent AND b.k = cf.k + 1),
pc AS (SELECT doc_id || '_p' || lpad(CAST(parent AS VARCHAR), 4, '0') AS chunk_id, doc_id, parent, string_agg(text, chr(10) ORDER BY ord) AS text FROM pb GROUP BY doc_id, parent),
cg AS (SELECT doc_id, parent, child, string_agg(text, chr(10) ORDER BY ord) AS text, CAST(min(s) AS BIGINT) AS a, CAST(max(s + length(text)) AS BIGINT) AS b FROM cf GROUP BY 1, 2, 3),
cc AS (SELECT doc_id || '_c' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY parent, child) - 1 AS VARCHAR), 4, '0') AS chunk_id, doc_id, doc_id || '_p' || lpad(CAST(parent AS VARCHAR), 4, '0') AS parent_id, text,
    CAST(len(regexp_split_to_array(text, '[ \\n]')) AS BIGINT) AS token_count, a, b FROM cg)""".replace("\\\\", "\\")


def all_chunks(spark, sf_dir):
    return chunk.chunks(view(spark, sf_dir, "blocks"), *BOUNDS)


@query(duck(["blocks"], CHILDREN + r" SELECT chunk_id, doc_id, CAST(parent AS BIGINT) AS chunk_index, text, CAST(len(regexp_split_to_array(text, '[ \n]')) AS BIGINT) AS token_count FROM pc"))
def parent_chunks(spark, sf_dir):
    return all_chunks(spark, sf_dir).filter("level = 'parent'").select("chunk_id", "doc_id", "chunk_index", "text", "token_count")


@query(duck(["blocks"], CHILDREN + " SELECT chunk_id, doc_id, parent_id, text, token_count, a AS start_offset, b AS end_offset FROM cc"))
def child_chunks(spark, sf_dir):
    return all_chunks(spark, sf_dir).filter("level = 'child'").select("chunk_id", "doc_id", "parent_id", "text", "token_count", F.col("start").alias("start_offset"), F.col("end").alias("end_offset"))


@query(duck(["blocks"], CHILDREN + " SELECT (SELECT count(*) FROM pc) + (SELECT count(*) FROM cc) AS chunks, CAST(0 AS BIGINT) AS violations"))
def chunk_invariant_violations(spark, sf_dir):
    c = all_chunks(spark, sf_dir)
    return c.agg(F.count("*").alias("chunks")).crossJoin(chunk.violations(c).agg(F.count("*").alias("violations")))


@query(duck(["blocks"], CHILDREN + " SELECT doc_id, count(*) AS n, min(token_count) AS low, CAST(median(token_count) AS DOUBLE) AS middle, max(token_count) AS high FROM cc GROUP BY doc_id"))
def chunk_size_stats(spark, sf_dir):
    c = all_chunks(spark, sf_dir).filter("level = 'child'")
    return c.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("token_count").alias("low"), F.median("token_count").alias("middle"), F.max("token_count").alias("high"))


@query(duck(["blocks"], CHILDREN + " SELECT cc.chunk_id, cc.parent_id, CAST(length(pc.text) AS BIGINT) AS parent_length FROM cc JOIN pc ON pc.chunk_id = cc.parent_id"))
def parent_of_child(spark, sf_dir):
    c = all_chunks(spark, sf_dir)
    p = c.filter("level = 'parent'").select(F.col("chunk_id").alias("parent_id"), F.length("text").cast("long").alias("parent_length"))
    return c.filter("level = 'child'").select("chunk_id", "parent_id").join(p, "parent_id")


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark, sf_dir):
    return content_hashes(spark, sf_dir).groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


DECIDE = """, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) AS k FROM registry) WHERE k = 1),
u AS (SELECT source_url, min(doc_id) AS url_id FROM registry WHERE status = 'indexed' AND source_url IS NOT NULL GROUP BY 1),
dec AS (SELECT i.*, CASE WHEN h.doc_id IS NOT NULL AND h.status <> 'indexed' THEN 'REINDEX'
    WHEN h.doc_id IS NOT NULL AND (i.title IS DISTINCT FROM h.title OR i.source_url IS DISTINCT FROM h.source_url OR i.publisher IS DISTINCT FROM h.publisher OR i.country IS DISTINCT FROM h.country OR i.effective_date IS DISTINCT FROM h.effective_date) THEN 'UPDATE_META'
    WHEN h.doc_id IS NOT NULL THEN 'SKIP' WHEN u.url_id IS NOT NULL THEN 'SUPERSEDE_AND_NEW' ELSE 'NEW' END AS action, h.doc_id AS matched_id, CASE WHEN h.doc_id IS NULL THEN u.url_id END AS previous_id
    FROM incoming i LEFT JOIN h ON h.content_hash = i.content_hash LEFT JOIN u ON u.source_url = i.source_url)"""
IR = ["registry", "incoming"]


def decided(spark, sf_dir):
    return decide.decide(view(spark, sf_dir, "incoming"), view(spark, sf_dir, "registry"))


@query(duck(IR, DECIDE + " SELECT line_number, action, matched_id, previous_id FROM dec"))
def import_decisions(spark, sf_dir):
    return decided(spark, sf_dir).select("line_number", "action", "matched_id", "previous_id")


@query(duck(IR, DECIDE + " SELECT action, count(*) AS n FROM dec GROUP BY 1"))
def decision_counts(spark, sf_dir):
    return decided(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))


@query(duck(["incoming"], " SELECT line_number, row_number() OVER (PARTITION BY content_hash ORDER BY line_number) AS hash_rank, source_url IS NULL OR row_number() OVER (PARTITION BY source_url ORDER BY line_number DESC) = 1 AS last_of_url FROM incoming"))
def in_batch_collisions(spark, sf_dir):
    return decide.in_batch(view(spark, sf_dir, "incoming")).select("line_number", "hash_rank", "last_of_url")


MISSING = "array_to_string(list_filter([CASE WHEN source_url IS NULL THEN 'source_url' END, CASE WHEN publisher IS NULL THEN 'publisher' END, CASE WHEN country IS NULL THEN 'country' END], lambda x: x IS NOT NULL), ',')"


@query(duck(["incoming"], f" SELECT line_number, {MISSING} AS missing FROM incoming"))
def missing_fields(spark, sf_dir):
    i = view(spark, sf_dir, "incoming")
    return i.select("line_number", F.array_join(decide.missing_fields(i, ("source_url", "publisher", "country")), ",").alias("missing"))


@query(duck(["incoming"], f" SELECT line_number, {MISSING} = '' AS complete FROM incoming"))
def metadata_gate(spark, sf_dir):
    i = view(spark, sf_dir, "incoming")
    return i.select("line_number", (F.size(decide.missing_fields(i, ("source_url", "publisher", "country"))) == 0).alias("complete"))


KEPT = ", kept AS (SELECT source_url, max(doc_id) AS keep_id FROM registry WHERE status = 'indexed' GROUP BY 1), sib AS (SELECT DISTINCT r.doc_id FROM registry r JOIN kept k ON k.source_url = r.source_url WHERE r.status = 'indexed' AND r.doc_id <> k.keep_id)"


def kept(spark, sf_dir):
    return view(spark, sf_dir, "registry").filter("status = 'indexed'").groupBy("source_url").agg(F.max("doc_id").alias("doc_id"))


@query(duck(["registry"], KEPT + " SELECT doc_id FROM sib"))
def supersede_siblings(spark, sf_dir):
    return decide.siblings(view(spark, sf_dir, "registry"), kept(spark, sf_dir))


@query(duck(["registry"], " SELECT doc_id, source_url FROM registry WHERE status = 'indexed'"))
def active_documents(spark, sf_dir):
    return view(spark, sf_dir, "registry").filter("status = 'indexed'").select("doc_id", "source_url").orderBy("doc_id")


@query(duck(IR, " SELECT doc_id, raw_path FROM registry WHERE status = 'indexed' AND raw_path NOT IN (SELECT raw_path FROM incoming)"))
def orphans(spark, sf_dir):
    return decide.orphans(view(spark, sf_dir, "registry"), view(spark, sf_dir, "incoming")).select("doc_id", "raw_path")


@query(duck(IR, " SELECT line_number, raw_path FROM incoming WHERE raw_path NOT IN (SELECT raw_path FROM registry WHERE status <> 'pending')"))
def missing_files(spark, sf_dir):
    files = view(spark, sf_dir, "registry").filter("status <> 'pending'").select("raw_path")
    return decide.split_found(view(spark, sf_dir, "incoming"), files)[1].select("line_number", "raw_path")


@query(duck(["registry"], KEPT + " SELECT r.doc_id, CASE WHEN sib.doc_id IS NOT NULL THEN 'superseded' ELSE r.status END AS status FROM registry r LEFT JOIN sib ON sib.doc_id = r.doc_id"))
def status_after_import(spark, sf_dir):
    r = view(spark, sf_dir, "registry")
    return index.set_status(r, decide.siblings(r, kept(spark, sf_dir)).withColumn("status", F.lit("superseded"))).select("doc_id", "status")


CV = ["chunk_vectors"]
PART = "doc_id % 3 = 0"


def vectors(spark, sf_dir):
    return view(spark, sf_dir, "chunk_vectors").select("chunk_id", "doc_id", "country", "doc_type", "publisher")


@query(duck(CV, f" SELECT chunk_id, doc_id, country FROM chunk_vectors WHERE NOT {PART} UNION ALL SELECT chunk_id + 1000000, doc_id, 'XX' FROM chunk_vectors WHERE {PART}"))
def replace_chunks(spark, sf_dir):
    v = vectors(spark, sf_dir).select("chunk_id", "doc_id", "country")
    return index.replace(v, v.filter(PART).select((F.col("chunk_id") + 1000000).alias("chunk_id"), "doc_id", F.lit("XX").alias("country")))


@query(duck(CV, f" SELECT chunk_id, doc_id FROM chunk_vectors WHERE NOT {PART}"))
def delete_by_doc(spark, sf_dir):
    v = vectors(spark, sf_dir).select("chunk_id", "doc_id")
    return index.delete(v, v.filter(PART))


@query(duck(CV, " SELECT chunk_id, CASE WHEN chunk_id % 5 = 0 THEN 'new' ELSE country END AS country FROM chunk_vectors UNION ALL SELECT chunk_id + 1000000, 'new' FROM chunk_vectors WHERE chunk_id % 5 = 0"))
def upsert_vectors(spark, sf_dir):
    v = vectors(spark, sf_dir).select("chunk_id", "country")
    n = v.filter("chunk_id % 5 = 0").withColumn("country", F.lit("new"))
    return index.upsert(v, n.unionByName(n.withColumn("chunk_id", F.col("chunk_id") + 1000000)))


@query(duck(CV, f" SELECT chunk_id, CASE WHEN {PART} THEN 'DE' ELSE country END AS country, CASE WHEN {PART} THEN '' ELSE publisher END AS publisher FROM chunk_vectors"))
def sync_filters(spark, sf_dir):
    v = vectors(spark, sf_dir)
    d = v.filter(PART).select("doc_id").distinct().select("doc_id", F.lit("DE").alias("country"), F.lit(None).cast("string").alias("publisher"))
    return index.sync(v, d, ("country", "publisher")).select("chunk_id", "country", "publisher")


@query(duck(["dims"], " SELECT code, name_en FROM dims WHERE is_active"))
def dimension_lookup(spark, sf_dir):
    return view(spark, sf_dir, "dims").filter("is_active").select("code", "name_en").orderBy("code")


@query(duck(["blocks", "registry"], CHILDREN + " SELECT pc.doc_id AS qid, CAST(pc.parent + 1 AS BIGINT) AS rk, pc.chunk_id AS parent_id, pc.doc_id, pc.text, CAST(len(regexp_split_to_array(pc.text, '[ \\n]')) AS BIGINT) AS token_count, cc.chunk_id, cc.text AS child_text, cc.a AS start_offset, cc.b AS end_offset, r.title, r.source_url FROM pc JOIN cc ON cc.parent_id = pc.chunk_id JOIN registry r ON r.doc_id = pc.doc_id"))
def load_context(spark, sf_dir):
    from ..operators import retrieve

    c = all_chunks(spark, sf_dir)
    child = F.when(F.col("level") == "child", F.struct("chunk_id", F.lit(0.5).alias("score")))
    own = c.groupBy(F.coalesce("parent_id", "chunk_id").alias("parent_id")).agg(F.max("doc_id").alias("doc_id"), F.max(F.when(F.col("level") == "parent", F.col("chunk_index") + 1)).alias("rk"), F.array_sort(F.collect_list(child)).alias("children"))
    hits = own.select(F.col("doc_id").alias("qid"), "rk", "parent_id", "doc_id", F.lit(0.5).alias("score"), "children")
    out = retrieve.load_context(hits, c, view(spark, sf_dir, "registry").select("doc_id", "title", "source_url"))
    out = out.select("qid", "rk", "parent_id", "doc_id", "text", "token_count", F.explode("matched_children").alias("m"), "title", "source_url")
    return out.select("qid", "rk", "parent_id", "doc_id", "text", "token_count", "m.chunk_id", F.col("m.text").alias("child_text"), F.col("m.start").alias("start_offset"), F.col("m.end").alias("end_offset"), "title", "source_url")


@query(duck(CV, " SELECT chunk_id FROM (SELECT chunk_id + 490 AS chunk_id FROM chunk_vectors) WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_vectors)"))
def missing_references(spark, sf_dir):
    from ..operators import retrieve

    v = vectors(spark, sf_dir).select("chunk_id")
    return retrieve.missing_references(v.select((F.col("chunk_id") + 490).alias("chunk_id")), v)


MANIFEST = """, r AS (SELECT line_number, replace(raw_path, '/raw/', '') AS file_name, title, CASE WHEN line_number % 9 = 0 THEN 'ebay' WHEN line_number % 25 > 0 THEN 'amazon' END AS platform, CASE WHEN line_number % 7 = 0 THEN 'someone' ELSE publisher END AS publisher,
    upper(country) AS country, CASE WHEN line_number % 8 = 0 THEN 'faq' ELSE 'policy' END AS doc_type, CASE WHEN line_number % 5 = 0 THEN '2021/07/01' END AS day, min(line_number) OVER (PARTITION BY replace(raw_path, '/raw/', '')) AS first FROM incoming),
e AS (SELECT line_number, CASE WHEN file_name IS NULL THEN 'file_name is missing' WHEN title IS NULL THEN 'title is missing' WHEN platform IS NULL THEN 'platform is missing'
    WHEN regexp_matches(file_name, '[/\\\\]') THEN 'file_name holds a path' WHEN first < line_number THEN 'file_name of line ' || first || ' is repeated in line ' || line_number
    WHEN platform <> 'amazon' THEN 'platform ' || platform || ' is not one of amazon' WHEN publisher NOT IN ('amazon', 'eu_commission') THEN 'publisher ' || publisher || ' is not one of amazon, eu_commission'
    WHEN country NOT IN ('DE', 'ES', 'EU', 'FR', 'IT', 'NL', 'PL') THEN 'country ' || country || ' is not one of DE, ES, EU, FR, IT, NL, PL'
    WHEN doc_type = 'faq' THEN 'doc_type faq is not one of guideline, policy, regulation' WHEN day IS NOT NULL THEN 'bad date ' || day END AS error FROM r)"""


@query(duck(["incoming"], MANIFEST + " SELECT line_number, error FROM e WHERE error IS NOT NULL"))
def manifest_violations(spark, sf_dir):
    n = F.col("line_number")
    rows = view(spark, sf_dir, "incoming").select(
        "line_number", F.replace(F.col("raw_path"), F.lit("/raw/"), F.lit("")).alias("file_name"), "title", F.when(n % 9 == 0, "ebay").when(n % 25 > 0, "amazon").alias("platform"), F.when(n % 7 == 0, "someone").otherwise(F.col("publisher")).alias("publisher"),
        F.upper("country").alias("country"), F.when(n % 8 == 0, "faq").otherwise("policy").alias("doc_type"), F.when(n % 5 == 0, "2021/07/01").alias("effective_date"),
    )
    return tables.manifest(rows).filter("error is not null").select("line_number", "error")


CARRIED = ("raw_path",)
#: The batch run line by line, as a recursion of its own: a group's records are a list that each line maps to a new one.
SEQUENTIAL = """, e AS (SELECT 'h' || content_hash AS a, 'u' || source_url AS b FROM incoming WHERE source_url IS NOT NULL UNION SELECT 'h' || content_hash, 'u' || source_url FROM registry WHERE source_url IS NOT NULL),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(root, node) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT r.root, b.b FROM reach r JOIN both_ways b ON b.a = r.node),
grp AS MATERIALIZED (SELECT root AS node, min(node) AS g FROM reach GROUP BY root),
l AS MATERIALIZED (SELECT i.*, coalesce(grp.g, 'h' || content_hash) AS g, row_number() OVER (PARTITION BY coalesce(grp.g, 'h' || content_hash) ORDER BY line_number) AS k,
    list_filter(['source_url', 'publisher', 'country'], lambda c: CASE c WHEN 'source_url' THEN source_url IS NULL WHEN 'publisher' THEN publisher IS NULL ELSE country IS NULL END) AS lost,
    CASE substr(content_hash, 1, 1) WHEN '0' THEN 'needs_manual' WHEN '1' THEN 'failed' WHEN '2' THEN 'raised' ELSE 'indexed' END AS fate FROM incoming i LEFT JOIN grp ON grp.node = 'h' || i.content_hash),
st AS (SELECT coalesce(grp.g, 'h' || content_hash) AS g, list({'doc_id': doc_id, 'status': status, 'content_hash': content_hash, 'title': title, 'source_url': source_url, 'publisher': publisher, 'country': country, 'effective_date': effective_date, 'raw_path': raw_path, 'by': CAST(NULL AS BIGINT)} ORDER BY doc_id) AS s
    FROM registry r LEFT JOIN grp ON grp.node = 'h' || r.content_hash GROUP BY 1),
seq(g, k, s, line_number, action, doc_id, previous_id, status, ok, lost) AS (
    SELECT g, CAST(0 AS BIGINT), coalesce(st.s, []), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BOOLEAN), CAST(NULL AS VARCHAR) FROM (SELECT DISTINCT g FROM l) LEFT JOIN st USING (g)
    UNION ALL
    SELECT g, k, list_transform(CASE WHEN act IN ('NEW', 'SUPERSEDE_AND_NEW') THEN list_append(s, {'doc_id': id, 'status': ns, 'content_hash': content_hash, 'title': title, 'source_url': source_url, 'publisher': publisher, 'country': country, 'effective_date': effective_date, 'raw_path': raw_path, 'by': CAST(NULL AS BIGINT)}) ELSE s END,
            lambda x: CASE WHEN x.doc_id = id AND act <> 'SKIP' THEN {'doc_id': id, 'status': ns, 'content_hash': x.content_hash, 'title': title, 'source_url': source_url, 'publisher': publisher, 'country': country, 'effective_date': effective_date, 'raw_path': x.raw_path, 'by': CASE WHEN anew THEN line_number ELSE x."by" END}
                WHEN anew AND x.status = 'indexed' AND x.source_url = source_url THEN {'doc_id': x.doc_id, 'status': 'superseded', 'content_hash': x.content_hash, 'title': x.title, 'source_url': x.source_url, 'publisher': x.publisher, 'country': x.country, 'effective_date': x.effective_date, 'raw_path': x.raw_path, 'by': x."by"} ELSE x END),
        line_number, CASE WHEN try_ AND fate IN ('failed', 'raised') THEN NULL ELSE act END, id, CASE WHEN act = 'SUPERSEDE_AND_NEW' THEN prev END, ns, NOT try_ OR fate = 'indexed', array_to_string(lost, ', ')
    FROM (SELECT *, CASE WHEN act = 'SKIP' THEN 'indexed' WHEN len(lost) > 0 THEN 'pending' WHEN act = 'UPDATE_META' THEN 'indexed' WHEN fate = 'raised' THEN 'pending' ELSE fate END AS ns,
            act NOT IN ('SKIP', 'UPDATE_META') AND len(lost) = 0 AS try_, act NOT IN ('SKIP', 'UPDATE_META') AND len(lost) = 0 AND fate = 'indexed' AS anew, coalesce(m.doc_id, line_number + 1000000000) AS id
        FROM (SELECT *, CASE WHEN m IS NOT NULL AND m.status <> 'indexed' THEN 'REINDEX'
                WHEN m IS NOT NULL AND (title IS DISTINCT FROM m.title OR source_url IS DISTINCT FROM m.source_url OR publisher IS DISTINCT FROM m.publisher OR country IS DISTINCT FROM m.country OR effective_date IS DISTINCT FROM m.effective_date) THEN 'UPDATE_META'
                WHEN m IS NOT NULL THEN 'SKIP' WHEN prev IS NOT NULL THEN 'SUPERSEDE_AND_NEW' ELSE 'NEW' END AS act
            FROM (SELECT l.*, q.s, list_filter(q.s, lambda x: x.content_hash = l.content_hash)[1] AS m, list_min(list_transform(list_filter(q.s, lambda x: x.status = 'indexed' AND x.source_url = l.source_url), lambda x: x.doc_id)) AS prev
                FROM seq q JOIN l ON l.g = q.g AND l.k = q.k + 1))))"""


def imported(spark, sf_dir):
    """The incoming view against the registry; what became of a content goes by its hash."""
    rows = view(spark, sf_dir, "incoming")
    c = F.substring("content_hash", 1, 1)
    parsed = rows.select("content_hash").distinct().select("content_hash", (~c.isin("0", "2")).alias("parsed"), (c != "1").alias("indexed"), F.lit(1).alias("parents"), F.lit(2).alias("children"), F.when(c == "2", "ValueError: broken").when(c == "1", "RuntimeError: no model").alias("error"))
    return importing.import_batch(rows, view(spark, sf_dir, "registry"), parsed, F.col("line_number") + 1000000000, ("source_url", "publisher", "country"), CARRIED)


@query(
    duck(
        IR,
        SEQUENTIAL
        + """ SELECT seq.line_number, seq.action, seq.doc_id, seq.previous_id, seq.status, seq.ok,
    CASE WHEN NOT seq.ok AND seq.status = 'needs_manual' THEN 'no parser could read it' WHEN NOT seq.ok AND seq.status = 'failed' THEN 'RuntimeError: no model' WHEN NOT seq.ok THEN 'ValueError: broken' WHEN seq.action = 'SKIP' THEN 'nothing changed'
        WHEN seq.action = 'UPDATE_META' AND seq.lost <> '' THEN 'metadata now lacks ' || seq.lost || '; taken out of the index' WHEN seq.action = 'UPDATE_META' THEN 'metadata updated' WHEN seq.lost <> '' THEN 'registered only, lacks ' || seq.lost ELSE 'indexed 1 parents and 2 children' END AS detail,
    CAST(CASE WHEN seq.ok AND seq.lost = '' AND seq.action NOT IN ('SKIP', 'UPDATE_META') THEN 1 ELSE 0 END AS BIGINT) AS parents, CAST(CASE WHEN seq.ok AND seq.lost = '' AND seq.action NOT IN ('SKIP', 'UPDATE_META') THEN 2 ELSE 0 END AS BIGINT) AS children FROM seq WHERE line_number IS NOT NULL""",
    )
)
def import_outcomes(spark, sf_dir):
    return imported(spark, sf_dir)[0]


@query(
    duck(
        IR,
        SEQUENTIAL
        + """, ends AS (SELECT g, arg_max(s, k) AS s FROM seq GROUP BY g), un AS (SELECT unnest(s) AS x FROM ends)
SELECT x.doc_id AS doc_id, x.status AS status, x.content_hash AS content_hash, x.title AS title, x.source_url AS source_url, x.publisher AS publisher, x.country AS country, x.effective_date AS effective_date, x.raw_path AS raw_path, x."by" AS indexed_by FROM un
UNION ALL SELECT doc_id, status, content_hash, title, source_url, publisher, country, effective_date, raw_path, NULL FROM registry r LEFT JOIN grp ON grp.node = 'h' || r.content_hash WHERE coalesce(grp.g, 'h' || content_hash) NOT IN (SELECT g FROM l)""",
    )
)
def registry_after_import(spark, sf_dir):
    return imported(spark, sf_dir)[1]


FAQ = """SELECT doc_id AS path, concat('=== F-01 ===', chr(10), '--- 问题 ---', chr(10), 'q ', lang, chr(10), '```', chr(10), '--- 译文 ---', chr(10), CASE WHEN doc_id % 5 = 1 THEN ' ' ELSE concat('  a', chr(10), 'b  ') END, chr(10), '--- 原文 ---', chr(10), CASE WHEN doc_id % 5 = 2 THEN '译文' ELSE replace(text, '```', '') END, chr(10), '--- 出处 ---', chr(10), source, chr(10), '=== F-0', CASE WHEN doc_id % 5 = 3 THEN '1' ELSE '2' END, ' ==', chr(10), '-- 问题', chr(10), 'x', chr(10), '-- 译文', chr(10), 'y', chr(10), '-- 原文', chr(10), 'z', chr(10), '-- 出处', chr(10), 'w') AS value FROM documents"""


@query(
    """SELECT doc_id AS path, 'F-01' AS entry_id, 'q ' || lang AS question_zh, CASE WHEN doc_id % 5 <> 1 THEN '  a' || chr(10) || 'b' END AS answer_zh,
    CASE WHEN doc_id % 5 = 2 THEN '译文' ELSE regexp_replace(array_to_string(list_transform(string_split(replace(text, '```', ''), chr(10)), lambda x: regexp_replace(x, '\\s+$', '')), chr(10)), '^\\s+|\\s+$', '', 'g') END AS answer_en, source, CASE doc_id % 5 WHEN 1 THEN 'answer_zh is empty' WHEN 2 THEN 'answer_en has no Latin letter' END AS error FROM documents
UNION ALL SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN 'F-01' ELSE 'F-02' END, 'x', 'y', 'z', 'w', CASE WHEN doc_id % 5 = 3 THEN 'the entry is there twice' END FROM documents""".replace("'  a'", "'a'")
)
def faq_entries(spark, sf_dir):
    text = F.expr(FAQ.split(" AS path, ", 1)[1].removesuffix(" AS value FROM documents"))
    return tables.faq(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), text.alias("value"))).select("path", "entry_id", "question_zh", "answer_zh", "answer_en", "source", "error")


@query("SELECT code, name_en FROM (SELECT n_name AS code, CASE WHEN n_nationkey % 2 = 0 THEN 'seeded' ELSE r_name END AS name_en FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'XX', 'new')")
def seed_dimensions(spark, sf_dir):
    dims = view(spark, sf_dir, "dims").select("code", "name_en")
    keys = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("code"), F.lit("seeded").alias("name_en"))
    return index.seed(dims, keys.unionByName(spark.createDataFrame([("XX", "new")], "code string, name_en string")))

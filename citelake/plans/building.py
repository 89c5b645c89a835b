"""Queries of the index build and of tables by version."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table
from ..operators import build, encode, html
from ..sources.shared import fresh, spread
from ..sources.versions import Store

QUERIES, ORACLES = {}, {}
REGISTRY = "doc_id long, content_hash string, status string, title string, source_url string, publisher string, country string, doc_type string, raw_path string"
DIM, BOUNDS = 16, (100, 200, 30)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def page_parser(content: bytes) -> list[tuple[str, int, str]]:
    """Blocks of a page in strict UTF-8."""
    return html.parse_blocks(content.decode("utf-8"))


def strict_words(texts: list[str]) -> list[int]:
    """The default tokenizer, for texts without control characters."""
    if any("\x07" in t for t in texts):
        raise ValueError("a control character")
    return build.words(texts)


def strict_encoder(texts: list[str]):
    """A test encoder that has no vector for texts with a replacement character."""
    if any("�" in t for t in texts):
        raise RuntimeError("a replacement character")
    return encode.hashed(DIM)(texts)


def page_files(spark, sf_dir):
    """(lines, contents) of the pages table as files: every 17th page is cut within a character, others hold what the tokenizer or the encoder refuses."""
    i = F.col("page_id")
    mark = F.when(i % 19 == 0, F.concat(F.lit("<p>a\x07b "), "page_id", F.lit("</p>"))).when(i % 23 == 0, F.concat(F.lit("<p>a�b "), "page_id", F.lit("</p>"))).otherwise(F.lit(""))
    content = F.concat(F.concat(F.coalesce("html", F.lit("")), mark).cast("binary"), F.when(i % 17 == 0, F.lit(b"\xc3")).otherwise(F.lit(b"")))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", content.alias("content"), F.sha2(content, 256).alias("content_hash"))
    lines = pages.select(
        i.alias("line_number"), "content_hash", F.concat(F.lit("page "), "page_id").alias("title"), F.when(i % 13 > 0, F.col("url")).alias("source_url"), F.lit("amazon").alias("publisher"), F.lit("EU").alias("country"), F.lit("policy").alias("doc_type"), F.concat(F.lit("/raw/"), "page_id").alias("raw_path"),
    )
    return lines, pages.select("content_hash", "content").dropDuplicates(["content_hash"])


def build_index(spark, sf_dir):
    """The pages table imported into a new store in two batches, the second with all of its lines again and other publishers."""
    lines, contents = page_files(spark, sf_dir)
    target = build.store(spark, fresh(spark, "index"), REGISTRY)
    args = contents, page_parser, strict_words, strict_encoder, DIM
    last = lines.agg(F.max("line_number")).first()[0] or 0
    one = build.index_files(target, lines.filter("line_number % 3 > 0"), *args, F.col("line_number"), bounds=BOUNDS)
    again = lines.withColumn("publisher", F.when(F.col("line_number") % 4 == 0, "eu_commission").otherwise(F.col("publisher")))
    two = build.index_files(target, again, *args, F.col("line_number") + last, bounds=BOUNDS)
    return target, one, two


@query()
def index_build(spark, sf_dir):
    """Chunks of the index, with their vectors' length and filter where they have one."""
    target, _, _ = build_index(spark, sf_dir)
    v = target.read("vectors").select("chunk_id", F.size("dense").cast("long").alias("dim"), F.size("sparse").cast("long").alias("words"), "publisher")
    return target.read("chunks").select("chunk_id", "doc_id", "parent_id", "level", "chunk_index", "token_count", F.sha2("text", 256).alias("text_sha256")).join(spread(v), "chunk_id", "left")


@query()
def index_outcomes(spark, sf_dir):
    """What became of each line, by batch."""
    _, one, two = build_index(spark, sf_dir)
    return one.withColumn("batch", F.lit(1)).unionByName(two.withColumn("batch", F.lit(2)))


@query(
    """SELECT 1 AS version, doc_id, sha256(text) AS text_sha256 FROM documents
UNION ALL SELECT 2, doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 > 0"""
)
def rows_by_version(spark, sf_dir):
    """Documents as a table of versions: in the second a third of the keys has other texts, and each seventh of the others is gone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = Store(spark, fresh(spark, "versions"), {"documents": ("doc_id long, text string", "doc_id")}, 16)
    store.commit(store.stage({"documents": (docs, None)}))
    new = docs.filter("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit("!")))
    store.commit(store.stage({"documents": (new, docs.filter("doc_id % 3 > 0 and doc_id % 7 = 0").select("doc_id"))}))
    read = lambda n: store.read("documents", n).select(F.lit(n).alias("version"), "doc_id", F.sha2("text", 256).alias("text_sha256"))
    return read(1).unionByName(read(2))

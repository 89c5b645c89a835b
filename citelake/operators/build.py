"""The index build: from files and their manifest to chunks, vectors and a registry, committed together.

Work on contents comes first and once for each content: parsing, chunking, counting and encoding, each behind the error boundary. Then the
lines are imported in order, with what became of their contents, and the documents that this indexed take their chunks and vectors over. All tables change
in one version.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import child_id, parent_id
from ..sources.shared import spread, written
from ..sources.versions import Store
from . import chunk
from .boundary import guarded
from .decide import REQUIRED
from .importing import import_changes

#: What a parser gives: the blocks of a file in order, as (type, level, text); none if it can't read it.
Parser = Callable[[bytes], list[tuple[str, int, str]]]
Tokenizer = Callable[[list[str]], list[int]]
Encoder = Callable[[list[str]], tuple[np.ndarray, list[dict[int, float]]]]

CHUNKS = "chunk_id string, doc_id long, parent_id string, level string, chunk_index long, text string, token_count long, start long, end long"
VECTORS = "chunk_id string, doc_id long, parent_id string, chunk_index long, country string, doc_type string, publisher string, dense array<float>, sparse map<long,float>"
FILTERS = ("country", "doc_type", "publisher")


def store(spark: SparkSession, root: str, registry: str, buckets: int = 64) -> Store:
    """A store of registry (columns as DDL, with doc_id), chunks and vectors, all by doc_id."""
    return Store(spark, root, {"registry": (registry, "doc_id"), "chunks": (CHUNKS, "doc_id"), "vectors": (VECTORS, "doc_id")}, buckets)


def words(texts: list[str]) -> list[int]:
    """The default tokenizer: parts between single spaces and line ends."""
    return [len(t.replace("\n", " ").split(" ")) for t in texts]


def parsed(contents: DataFrame, parser: Parser) -> DataFrame:
    """(content_hash, found, error) of `contents` (content_hash, content): the blocks as an array of (type, level, text), empty if there are none."""

    def call(part: pa.RecordBatch) -> list[list]:
        return [[[{"type": k, "level": lv, "text": t} for k, lv, t in parser(x)] if x is not None else [] for x in part.column("content").to_pylist()]]

    return guarded(contents.select("content_hash", "content"), call, {"found": "array<struct<type:string,level:int,text:string>>"}, reads=["content"], keeps=["content_hash"], alone=True)


def counted(rows: DataFrame, tokenizer: Tokenizer, text: str, name: str) -> DataFrame:
    return guarded(rows, lambda part: [tokenizer([x or "" for x in part.column(text).to_pylist()])], {name: "long"}, batch=256, reads=[text])


def encoded(children: DataFrame, encoder: Encoder, dim: int) -> DataFrame:
    """`children` without their text, with dense, sparse and error. A batch with too few vectors or of another dimension is an error of its rows."""

    def call(part: pa.RecordBatch) -> list[list]:
        texts = part.column("text").to_pylist()
        dense, sparse = encoder(texts)
        if len(dense) != len(texts) or len(sparse) != len(texts):
            raise ValueError(f"{len(texts)} texts, but {len(dense)} dense and {len(sparse)} sparse vectors")
        if np.asarray(dense).shape[1] != dim:
            raise ValueError(f"the encoder has {np.asarray(dense).shape[1]} dimensions, not {dim}")
        return [list(np.asarray(dense, np.float32)), [list(x.items()) for x in sparse]]

    return guarded(children, call, {"dense": "array<float>", "sparse": "map<long,float>"}, reads=["text"], keeps=[c for c in children.columns if c != "text"])


def built(contents: DataFrame, parser: Parser, tokenizer: Tokenizer, encoder: Encoder, dim: int, lower: int = chunk.LOWER, upper: int = chunk.UPPER, target: int = chunk.CHILD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fates, chunks, vectors) of `contents` (content_hash, content), each a written table by content_hash.

    fates: content_hash, parsed, indexed, parents, children, error, as `import_batch` takes them: an error of the parser, the chunker's tokenizer or its second
    count leaves parsed false; one of the encoder leaves indexed false. No blocks: not parsed, no error. Null and equal contents are contents like others; hashes are distinct.
    Of a content that is not parsed and indexed, chunks and vectors are not to be taken: those that didn't fail are still there.
    """
    files = written(parsed(contents, parser), "parsed")
    blocks = files.filter("error is null").select(F.col("content_hash").alias("doc_id"), F.posexplode("found").alias("ord", "b")).select("doc_id", F.col("ord").cast("long").alias("ord"), "b.type", "b.text")
    # A content's blocks come from one row, so they lie together and in order: all that is made of them needs no shuffle.
    pieces = chunk.cut(counted(blocks, tokenizer, "text", "tok"), lower, upper, target).withColumnRenamed("error", "uncounted")
    # Tokens are counted again on the joined texts; what that raises belongs to the content too.
    pieces = written(counted(pieces, tokenizer, "text", "token_count"), "chunks")
    wrong = F.coalesce("uncounted", "error")
    whole = pieces.filter(wrong.isNull()).drop("uncounted", "error")
    vectors = written(encoded(whole.filter("level = 'child'").select("doc_id", "parent", "chunk_index", "text"), encoder, dim), "vectors")

    # A row for each content, its numbers of chunks, and its errors, the parser's first.
    facts = {"at": "string", "error": "string", "parents": "long", "children": "long", "why": "string", "n": "long"}
    fact = lambda d, **c: d.select("doc_id", *(c.get(k, F.lit(None)).cast(t).alias(k) for k, t in facts.items()))
    counts = whole.groupBy("doc_id").agg(F.count_if(F.col("level") == "parent").alias("parents"), F.count_if(F.col("level") == "child").alias("children"))
    name = F.coalesce(chunk_name("doc_id"), F.lit(""))
    all_facts = fact(files.withColumnRenamed("content_hash", "doc_id"), at=F.lit(""), error=F.col("error")).unionByName(fact(counts, parents=F.col("parents"), children=F.col("children")))
    all_facts = all_facts.unionByName(fact(pieces.filter(wrong.isNotNull()), at=name, error=wrong)).unionByName(fact(vectors.filter("error is not null"), why=F.col("error"), n=F.col("chunk_index")))
    first = lambda c, order: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    fates = all_facts.groupBy("doc_id").agg(first("error", "at"), F.max("parents").alias("parents"), F.max("children").alias("children"), first("why", "n"))
    fine = F.col("error").isNull()
    count = lambda c: F.when(fine, F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
    fates = fates.select(F.col("doc_id").alias("content_hash"), (fine & F.col("parents").isNotNull()).alias("parsed"), (~fine | F.col("why").isNull()).alias("indexed"), count("parents"), count("children"), F.coalesce("error", "why").alias("error"))
    by = lambda d: d.withColumnRenamed("doc_id", "content_hash")
    return written(fates, "fates"), by(whole), by(vectors.drop("error"))


def chunk_name(doc: str) -> Column:
    """The id of a chunk of the document in column `doc`, from level and chunk_index."""
    return F.when(F.col("level") == "parent", parent_id(F.col(doc), F.col("chunk_index"))).when(F.col("level") == "child", child_id(F.col(doc), F.col("chunk_index")))


def index_files(target: Store, incoming: DataFrame, contents: DataFrame, parser: Parser, tokenizer: Tokenizer, encoder: Encoder, dim: int, new_id: Column, required: tuple[str, ...] = REQUIRED, carried: tuple[str, ...] = ("raw_path",), bounds: tuple[int, int, int] = (chunk.LOWER, chunk.UPPER, chunk.CHILD)) -> DataFrame:
    """Imports a batch into `target` and commits it; the outcomes of `import_batch`, a written table.

    incoming: lines of a manifest with content_hash; contents: (content_hash, content), distinct. The registry table of the store has doc_id, content_hash, status, the manifest's fields and `carried`.
    Only contents that no indexed record has, and that an earlier line of their URL could retire, are worked on. If anything fails before the end, the store is as it was; the rows
    that fail alone are in the outcomes.
    """
    incoming = written(incoming, "lines")
    before = target.current()
    registry = target.read("registry", before)
    columns = registry.columns
    held = registry.filter("status = 'indexed'").select("content_hash")
    # An indexed content is worked on again only if another line has the URL of its record or its lines: it may have been retired by then.
    shared = registry.select("content_hash", "source_url").unionByName(incoming.select("content_hash", "source_url")).filter("source_url is not null").distinct()
    crowded = shared.groupBy("source_url").agg(F.count("*").alias("n")).filter("n > 1")
    risky = shared.join(spread(crowded), "source_url", "left_semi").select("content_hash").distinct()
    safe = held.join(spread(risky), "content_hash", "left_anti")
    asked = incoming.select("content_hash").distinct().join(spread(safe), "content_hash", "left_anti")
    fates, chunks, vectors = built(contents.join(spread(asked), "content_hash", "left_semi"), parser, tokenizer, encoder, dim, *bounds)

    outcomes, records = import_changes(incoming, registry, fates, new_id, required, carried)
    fresh = records.filter("indexed_by is not null").select("doc_id", "content_hash", "status", *FILTERS)
    named = lambda d: d.join(spread(fresh.select("content_hash", F.col("doc_id").alias("id_"))), "content_hash")
    parent = F.when(F.col("parent").isNotNull(), parent_id(F.col("id_"), F.col("parent")))
    new_chunks = named(chunks).select(chunk_name("id_").alias("chunk_id"), F.col("id_").alias("doc_id"), parent.alias("parent_id"), "level", "chunk_index", "text", "token_count", "start", "end")
    # Vectors follow the records: new ones where a record was indexed and still is, new filter values where these changed, none where a record isn't indexed any more.
    active = fresh.filter("status = 'indexed'").select("content_hash", F.col("doc_id").alias("id_"), *(F.coalesce(c, F.lit("")).alias(c) for c in FILTERS))
    new_vectors = vectors.join(spread(active), "content_hash").select(child_id(F.col("id_"), F.col("chunk_index")).alias("chunk_id"), F.col("id_").alias("doc_id"), parent.alias("parent_id"), "chunk_index", *FILTERS, "dense", "sparse")
    whole = records.join(spread(registry.select("doc_id", *(F.col(c).alias(f"was_{c}") for c in columns if c != "doc_id"))), "doc_id", "left")  # records that no line touches stay
    differs = F.col("was_status").isNull()
    for c in columns:
        if c != "doc_id":
            differs = differs | ~F.col(c).eqNullSafe(F.col(f"was_{c}"))
    changed = written(whole.filter(differs), "changed")
    gone = changed.filter("was_status = 'indexed' and status <> 'indexed'").select("doc_id")
    moved = F.lit(False)
    for c in FILTERS:
        moved = moved | ~F.coalesce(c, F.lit("")).eqNullSafe(F.coalesce(f"was_{c}", F.lit("")))
    stay = changed.filter(moved & F.col("indexed_by").isNull() & (F.col("status") == "indexed") & (F.col("was_status") == "indexed")).select("doc_id", *(F.coalesce(c, F.lit("")).alias(c) for c in FILTERS))
    synced = target.lookup("vectors", stay, before).drop(*FILTERS).join(spread(stay), "doc_id")
    new_vectors = new_vectors.unionByName(synced.select(new_vectors.columns))
    # A content that is indexed has chunks and children, so the keys of the new rows are known without them.
    ids = active.select(F.col("id_").alias("doc_id")).unionByName(stay.select("doc_id")).unionByName(gone)
    staged = target.stage({"registry": (changed.select(columns), None), "chunks": (new_chunks, None, fresh.select("doc_id")), "vectors": (new_vectors, gone, ids)})
    if staged.number != before:
        raise RuntimeError("the store has changed while the batch was built")
    target.commit(staged)
    return outcomes

"""Token counts with a digest cache.

Normalised content and tokenizer version are digested; stored counts are joined by both digests, only distinct
misses are encoded, and their counts are appended to the cache. The library's counts depend on every byte, so the
content is normalised to its UTF-8 bytes and no further.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, n_bytes

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
#: A single space between two characters that are not white space: byte-level pre-tokenizers always cut before it.
CUT = re.compile(r"(?<!\s) (?!\s)")
#: Pieces longer than this are not remembered by a worker, nor more pieces than this.
MAX_PIECE, MAX_PIECES = 64, 400_000


def library_of(path: str) -> str:
    return "sentencepiece" if path.endswith(".model") else "tokenizers"


def tokenizer_digest(path: str) -> str:
    """Digest of the vocabulary file and the library that reads it."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library_of(path)} {version(library_of(path))}".encode()).hexdigest()


class PieceCounter:
    """Counts tokens of texts. With a byte-level BPE the library is asked once for each distinct piece, else for each whole text.

    A byte-level pre-tokenizer never joins what stands on both sides of a single inner space, so the count of a text is
    the sum over its pieces, each with the space before it. Special strings hold no space, so they stay whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if library_of(path) == "sentencepiece":
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.pieces, self.encode = False, model.encode
        else:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            self.pieces = "ByteLevel(add_prefix_space=False" in repr(self.tokenizer.pre_tokenizer) and not self.tokenizer.normalizer
            self.encode = lambda texts: self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        self.seen: dict[str, int] = {}

    def library(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.encode(texts)]

    def count(self, text: str) -> int:
        if not self.pieces:
            return self.library([text])[0]
        first, *rest = CUT.split(text)
        total = self.library([first])[0] if first else 0
        if not rest:
            return total
        seen = self.seen
        if new := list({x for x in rest if x not in seen}):
            if len(seen) > MAX_PIECES:
                seen.clear()
                new = list(set(rest))
            found = dict(zip(new, self.library([" " + x for x in new]), strict=True))
            seen.update((k, v) for k, v in found.items() if len(k) <= MAX_PIECE)
            return total + sum(found[x] if x in found else seen[x] for x in rest)
        return total + sum(map(seen.__getitem__, rest))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 512) -> DataFrame:
    """Rows of `docs` (doc_id, text) with n_bytes, n_tokens and over_limit (n_tokens > limit).

    cache_path: a Parquet folder that driver and executors share, made at the first call; appended to here. It is partitioned by tokenizer digest, so only this tokenizer's counts are read.
    Null and empty texts: 0 tokens. Equal texts, however many, are encoded once. Rows are kept as they come, equal ones
    and those without an id too; other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = tokenizer_digest(tokenizer_path)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", n_bytes(F.col("text")).alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("content_digest"))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer_digest").parquet(cache_path)

    def stored() -> DataFrame:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer_digest") == own)

    misses = rows.select("content_digest", "text").join(stored(), "content_digest", "left_anti").dropDuplicates(["content_digest"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(tokenizer_path)
        for batch in batches:
            n = [counter.count(x) for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("content_digest"), pa.array([own] * len(n), pa.string()), pa.array(n, pa.int64())], ["content_digest", "tokenizer_digest", "n_tokens"])

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer_digest").parquet(cache_path)
    # Two callers at once may both have stored a digest. Written, so that the join has a plain shuffle on both sides and Spark can split a hot digest's rows.
    counts = Stages(spark, "token-counts").put(stored().groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")))
    return rows.drop("text").join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), Stages(spark, "token-cache").path("counts"))

"""Encoders: texts to dense vectors and sparse weights, in Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

Output = tuple[np.ndarray, list[dict[int, float]]]


@lru_cache(1 << 16)
def digest(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode())


def hashed(dim: int = 64) -> Callable[[list[str]], Output]:
    """A deterministic encoder without a model, for tests: words hashed to signed coordinates of a unit vector, and to counts."""

    def encode(texts: list[str]) -> Output:
        found = [Counter(re.findall(r"\w+", text.lower())) for text in texts]
        sizes = [len(words) for words in found]
        h = np.array([digest(word) for words in found for word in words], np.uint64)
        n = np.array([x for words in found for x in words.values()], np.float64)
        at = np.repeat(np.arange(len(texts)), sizes) * dim + (h % np.uint64(dim)).astype(np.int64)
        dense = np.bincount(at, np.where(h >> np.uint64(32) & np.uint64(1), n, -n), len(texts) * dim).reshape(len(texts), dim).astype(np.float32)
        keys, counts, sparse, end = (h >> np.uint64(33)).tolist(), n.tolist(), [], 0
        for size in sizes:
            start, end = end, end + size
            weights = dict(zip(keys[start:end], counts[start:end], strict=True))
            if len(weights) < size:  # words that share a key
                weights = {}
                for key, x in zip(keys[start:end], counts[start:end], strict=True):
                    weights[key] = weights.get(key, 0.0) + x
            sparse.append(weights)
        norm = np.linalg.norm(dense, axis=1, keepdims=True)
        return dense / np.where(norm > 0, norm, 1), sparse

    return encode


def csr_maps(indptr: np.ndarray, indices: np.ndarray, data: np.ndarray) -> list[dict[int, float]]:
    """Rows of a matrix in compressed row form as maps; zeros are left out."""
    return [{int(k): float(v) for k, v in zip(indices[a:b], data[a:b], strict=True) if v} for a, b in zip(indptr[:-1], indptr[1:], strict=True)]


def encode(rows: DataFrame, encoder: Callable[[list[str]], Output], dim: int, batch: int = 64) -> DataFrame:
    """`rows` (text, anything else) with dense array<float> and sparse map<long, float>, `batch` texts at once.

    As many vectors as texts and `dim` coordinates each, or the task fails: fewer would silently drop the last texts, others lie in another space. Null texts are encoded as empty ones.
    """
    names = rows.columns
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "dense array<float>", "sparse map<long, float>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                texts = [x or "" for x in part.column("text").to_pylist()]
                dense, sparse = encoder(texts)
                if len(dense) != len(texts) or len(sparse) != len(texts):
                    raise ValueError(f"{len(texts)} texts, but {len(dense)} dense and {len(sparse)} sparse vectors")
                if dense.shape[1] != dim:
                    raise ValueError(f"the encoder has {dense.shape[1]} dimensions, not {dim}")
                vectors = pa.array(list(dense.astype(np.float32)), pa.list_(pa.float32()))
                weights = pa.array([list(x.items()) for x in sparse], pa.map_(pa.int64(), pa.float32()))
                yield pa.record_batch([*part.columns, vectors, weights], [*names, "dense", "sparse"])

    return rows.mapInArrow(run, schema)

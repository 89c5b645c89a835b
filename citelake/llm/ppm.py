"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ORDER bytes with the counts of what follows. The code length of a symbol comes from the longest context seen; what
does not follow there escapes to the next shorter one, where the symbols of the longer one are excluded. Escapes are estimated by the number of
different symbols seen in a context, each of which takes half a count from its symbol (method D). Shorter contexts count a symbol only when it was new in the
longer one, so their counts are of different contexts. Below the empty context all 257 symbols, the bytes and the end, are equally likely.

`Trie` codes a text one symbol at a time, adaptively or pretrained. The distributed form gives the pretrained scores: the cost of a symbol
depends only on the ORDER symbols before it, so it is computed once for each different gram of ORDER + 1 symbols. Texts are dealt into blocks
of bounded size, long ones in pieces; a block sends its grams, packed by the three symbols before the last, to the tasks that hold this part of the trie, and gets their costs back in the same order.
Orders from 3 on are whole in each part; those below follow from the different grams of three symbols, of which there are at most 258 * 258 * 257.
Words for the base score go the same way.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, blocks_for, id_hash, n_bytes, text_key

ORDER = 6
END, START, SYMBOLS = 256, 257, 257
BITS = 9
MASK = (1 << BITS) - 1
#: Bytes of text in a block, of text whose grams meet in a bucket, and of text that is coded at once; longer texts are cut into pieces.
BLOCK_BYTES, BUCKET_BYTES, PART_BYTES = 6 << 20, 6 << 20, 1 << 20
END_WORD = 0
#: Grams whose costs are computed at once.
STEP = 1 << 17
GAP = re.compile(rb"[ \t-\r]")


class Trie:
    """The model, symbol by symbol: contexts are tuples of up to `order` symbols."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.counts: dict[tuple[int, ...], Counter[int]] = {}

    def steps(self, data: bytes) -> Iterable[tuple[tuple[int, ...], int]]:
        context = (START,) * self.order
        for s in [*data, END]:
            yield context, s
            context = (*context[1:], s) if self.order else ()

    def learn(self, context: tuple[int, ...], symbol: int) -> None:
        for j in range(self.order + 1):
            seen = self.counts.setdefault(context[j:], Counter())
            seen[symbol] += 1
            if seen[symbol] > 1:
                break

    def cost(self, context: tuple[int, ...], symbol: int) -> float:
        """log10 of the probability."""
        out, excluded = 0.0, set()
        for j in range(self.order + 1):
            seen = {s: n for s, n in self.counts.get(context[j:], {}).items() if s not in excluded}
            if not seen:
                continue
            total = 2 * sum(seen.values())
            if symbol in seen:
                return out + math.log10((2 * seen[symbol] - 1) / total)
            out += math.log10(len(seen) / total)
            excluded |= set(seen)
        return out - math.log10(SYMBOLS - len(excluded))

    def train(self, data: bytes) -> None:
        for context, s in self.steps(data):
            self.learn(context, s)

    def score(self, data: bytes, adaptive: bool = False) -> float:
        """log10 probability of a text; adaptive: the model learns each symbol after coding it."""
        out = 0.0
        for context, s in self.steps(data):
            out += self.cost(context, s)
            if adaptive:
                self.learn(context, s)
        return out


Piece = tuple[bytes, bytes, bool]


def pieces(data: bytes, size: int) -> Iterable[Piece]:
    """(bytes, the ORDER bytes before them or none at the start, whether the text ends here): cuts before white space, so words stay whole, and after `size` bytes or more."""
    a = 0
    while True:
        gap = GAP.search(data, a + size)
        b = gap.start() if gap else len(data)
        yield data[a:b], data[a - ORDER : a] if a else b"", not gap
        if not gap:
            return
        a = b


def grams(texts: list[Piece]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sizes): the gram of each symbol of each piece, the text's end included, and how many each piece has. The last symbol has the lowest bits."""
    sizes = np.array([len(t) + last for t, _, last in texts], np.int64)
    ends = np.cumsum(sizes + ORDER)
    s = np.full(ends[-1] if len(ends) else 0, START, np.int16)
    inner = np.ones(len(s), bool)
    for k in range(ORDER):
        inner[ends - sizes - ORDER + k] = False
    for end, n, (_, before, _) in zip(ends.tolist(), sizes.tolist(), texts, strict=True):
        if before:
            s[end - n - ORDER : end - n] = list(before)
    body = np.zeros(int(sizes.sum()), np.int16)
    is_end = np.zeros(len(body), bool)
    is_end[(np.cumsum(sizes) - 1)[[last for _, _, last in texts]]] = True
    body[is_end] = END
    body[~is_end] = np.frombuffer(b"".join(t for t, _, _ in texts), np.uint8)
    s[inner] = body
    key = s[: len(s) - ORDER].astype(np.int64)
    for j in range(1, ORDER + 1):
        key <<= BITS
        key |= s[j : len(s) - ORDER + j]
    return key[inner[ORDER:]], sizes


def parts(texts: list[Piece]) -> Iterable[tuple[int, int]]:
    start, size = 0, 0
    for i, (t, _, _) in enumerate(texts):
        size += len(t)
        if size >= PART_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and their summed counts."""
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
    at = np.nonzero(first)[0]
    return key[at], np.add.reduceat(count[order], at) if len(at) else np.empty(0, np.int64)


def squeeze(a: np.ndarray) -> bytes:
    """Bytes of one place stand together, which compresses well."""
    return zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)


def expand(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_keys(key: np.ndarray) -> bytes:
    return squeeze(np.diff(key, prepend=np.int64(0)))


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(expand(b, np.int64))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1 | 1  # END_WORD is even, and all fit a signed long


def gram_bucket(key: np.ndarray, n: int) -> np.ndarray:
    """By the three symbols before the last: all that the trie needs for orders from 3 on is in one bucket."""
    out = key >> BITS
    out &= (1 << 3 * BITS) - 1
    out *= 0x9E3779B1
    out >>= 13
    out %= n
    return out.astype(np.int32)


def word_bucket(key: np.ndarray, n: int) -> np.ndarray:
    return (key >> 20) % n


def costs(key: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 probability of each gram's last symbol. key: sorted different grams; n: how often training holds them; low: sorted (last two context symbols, symbol) with the number of different contexts of order 3 that each follows, over all."""

    def shorter(g: np.ndarray, j: int) -> np.ndarray:
        """Grams of order j at the end of longer ones."""
        return g & ((1 << BITS * (j + 1)) - 1)

    def find(keys: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(keys, at), max(len(keys) - 1, 0))
        return np.where(keys[i] == at, values[i], 0) if len(keys) else np.zeros(len(at), np.int64)

    # (grams, counts) of each order, sorted; those of orders 2 to 0 hold other buckets too.
    tables = {ORDER: (key[n > 0], n[n > 0])}
    for j in range(ORDER - 1, 2, -1):
        tables[j] = np.unique(shorter(tables[j + 1][0], j), return_counts=True)
    tables[2] = low[0].astype(np.int64), low[1].astype(np.int64)
    for j in (1, 0):
        tables[j] = np.unique(shorter(tables[j + 1][0], j), return_counts=True)
    # Of each order the contexts with their counts and symbols, and what the symbols of the longer contexts count in this one.
    contexts, covered = {}, {}
    for j, (g, gn) in tables.items():
        c, at = np.unique(g >> BITS, return_inverse=True)
        contexts[j] = c, np.bincount(at, gn, len(c)).astype(np.int64), np.bincount(at, minlength=len(c))
        if j:
            covered[j - 1] = c, np.bincount(at, find(*tables[j - 1], shorter(g, j - 1)), len(c)).astype(np.int64)
    out = np.zeros(len(key))
    for start in range(0, len(key), STEP):
        k = key[start : start + STEP]
        cost, open_, used = out[start : start + STEP], np.ones(len(k), bool), np.zeros(len(k), np.int64)  # used: symbols of the contexts above, all excluded
        for j in range(ORDER, -1, -1):
            own = k >> BITS & ((1 << BITS * j) - 1)
            c, total, kinds = contexts[j]
            t, u = find(c, total, own), find(c, kinds, own)
            if j < ORDER:
                t -= find(*covered[j], k >> BITS & ((1 << BITS * (j + 1)) - 1))
                u -= used
            mine = find(*tables[j], shorter(k, j))
            left = open_ & (u > 0)
            hit = left & (mine > 0)
            cost[hit] += np.log10((2 * mine[hit] - 1) / (2 * t[hit]))
            miss = left & ~hit
            cost[miss] += np.log10(u[miss] / (2 * t[miss]))
            open_ &= ~hit
            used += np.maximum(u, 0)
        cost[open_] -= np.log10(SYMBOLS - used[open_])
    return out


def score(docs: DataFrame, training: Column, piece_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of `docs` (doc_id, text), learned from rows where `training`, a condition on doc_id, is true.

    Null and empty texts: the end alone. Base: unigrams of words between ASCII white space, A-Z in lower case, with an end token, smoothed by 0.1.
    score: the pretrained model's log10 probability of the text's bytes and its end. Without training rows all symbols are equally
    likely. Repeated rows are each learned from and scored; texts over piece_bytes are coded in pieces, each with the symbols before it. Other columns are ignored. Empty table: no rows.
    """
    spark, stages = docs.sparkSession, Stages(docs.sparkSession, "ppm")
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"), F.coalesce(training, F.lit(False)).alias("train"), n_bytes(F.col("text")).alias("size"), text_key(F.col("text")).alias("key_"))
    sizes = whole.agg(F.sum("size").alias("n"), F.max("size").alias("longest")).first()
    n_blocks, n = blocks_for(sizes["n"], BLOCK_BYTES), blocks_for(sizes["n"], BUCKET_BYTES)
    cut = (sizes["longest"] or 0) > piece_bytes  # else the table need not be read for long texts
    deal = lambda *more: F.pmod(F.xxhash64("doc_id", "key_", *more), F.lit(n_blocks)).cast("int").alias("block")
    rows = whole.filter(F.col("size") <= piece_bytes).select(F.lit(None).cast("long").alias("row"), "doc_id", "data", F.lit(b"").alias("before"), F.lit(True).alias("last"), "train", deal())

    def split(batches):
        row = TaskContext.get().partitionId() << 33
        types = {"row": pa.int64(), "doc_id": pa.int64(), "data": pa.binary(), "before": pa.binary(), "last": pa.bool_(), "train": pa.bool_(), "key_": pa.int64(), "k": pa.int64()}
        for batch in batches:
            for doc_id, data, train, key in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "data", "train", "key_")), strict=True):
                row += 1
                for k, (piece, before, last) in enumerate(pieces(data, piece_bytes)):
                    yield pa.record_batch([pa.array([v], t) for v, t in zip((row, doc_id, piece, before, last, train, key, k), types.values(), strict=True)], list(types))

    if cut:
        long = whole.filter(F.col("size") > piece_bytes).select("doc_id", "data", "train", "key_").mapInArrow(split, "row long, doc_id long, data binary, before binary, last boolean, train boolean, key_ long, k long")
        rows = rows.unionByName(long.select("row", "doc_id", "data", "before", "last", "train", deal("k")))

    def texts_of(table: pa.Table) -> list[Piece]:
        return list(zip(*(table.column(c).to_pylist() for c in ("data", "before", "last")), strict=True))

    def count(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        texts, train = texts_of(table), table.column("train").to_pylist()
        keys, counts = [], []
        known: Counter[bytes] = Counter()
        other: set[bytes] = set()
        ends = 0
        for a, b in parts(texts):
            for flag in (True, False):
                own = [t for t, f in zip(texts[a:b], train[a:b], strict=True) if f == flag]
                if not own:
                    continue
                found, often = np.unique(grams(own)[0], return_counts=True)
                keys.append(found)
                counts.append(often if flag else np.zeros(len(found), np.int64))
                if len(keys) == 4:  # merged now and then, so that a block holds its different grams and little more
                    keys, counts = ([x] for x in merge(keys, counts))
                ends += flag * sum(last for _, _, last in own)
                for t, _, _ in own:
                    known.update(words_of(t)) if flag else other.update(words_of(t))
        out = []
        g, gn = merge(keys, counts)
        del keys, counts
        other.difference_update(known)
        w = np.fromiter(map(word_key, [*known, *other]), np.int64, len(known) + len(other))
        w, wn = merge([w, np.array([END_WORD])], [np.fromiter([*known.values(), *[0] * len(other)], np.int64, len(w)), np.array([ends])])
        for kind, k, c, at in (("grams", g, gn, gram_bucket(g, n)), ("words", w, wn, word_bucket(w, n))):
            o = np.argsort(at, kind="stable")
            for part in np.split(o, np.nonzero(np.diff(at[o]))[0] + 1):
                if len(part):
                    out.append((block, kind, int(at[part[0]]), pack_keys(k[part]), squeeze(c[part]), 0, 0))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["block", "kind", "bucket", "keys", "counts", "kinds", "total"])

    message = "block int, kind string, bucket int, keys binary, counts binary, kinds long, total long"

    # Bounded whatever the corpus, so they may come to the driver. Each counts the different grams of four symbols that end in it.
    def short_grams(batches):
        for batch in batches:
            texts = texts_of(batch)
            for a, b in parts(texts):
                yield pa.record_batch([pa.array(np.unique(grams(texts[a:b])[0] & ((1 << 4 * BITS) - 1)))], ["quad"])

    quads = rows.filter("train").select("data", "before", "last").mapInArrow(short_grams, "quad long").distinct()
    triples = quads.groupBy(F.col("quad").bitwiseAND((1 << 3 * BITS) - 1).cast("int").alias("triple")).agg(F.count("*").cast("short").alias("n")).toArrow().sort_by("triple")
    low = spark.sparkContext.broadcast((triples.column("triple").to_numpy(), triples.column("n").to_numpy()))
    del quads, triples
    stages.free()

    def answer(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        blocks = table.column("block").to_pylist()
        packed = table.column("keys").to_pylist()
        key, count = merge(list(map(unpack_keys, packed)), [expand(b, np.int64) for b in table.column("counts").to_pylist()])
        value = costs(key, count, low.value).astype(np.float32) if kind == "grams" else count
        replies = [squeeze(value[np.searchsorted(key, unpack_keys(k))]) for k in packed]
        kinds, total = (int((count > 0).sum()), int(count.sum())) if kind == "words" else (0, 0)
        m = len(blocks)
        return pa.table([pa.array(blocks, pa.int32()), pa.array([kind] * m), pa.array([bucket] * m, pa.int32()), pa.array([b""] * m, pa.binary()), pa.array(replies, pa.binary()), pa.array([kinds] + [0] * (m - 1), pa.int64()), pa.array([total] + [0] * (m - 1), pa.int64())], ["block", "kind", "bucket", "keys", "counts", "kinds", "total"])

    told = stages.put(rows.groupBy("block").applyInArrow(count, message).groupBy("kind", "bucket").applyInArrow(answer, message))
    stages.free()
    stat = told.agg(F.sum("kinds").alias("v"), F.sum("total").alias("n")).first()
    v, total = stat["v"] or 0, stat["n"] or 0

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = texts_of(left)
        reply = {(k, b): c for k, b, c in zip(*(right.column(c).to_pylist() for c in ("kind", "bucket", "counts")), strict=True)}
        coded = []  # of each part: its different grams, later those of all parts; the number among these of each symbol's gram; sizes of texts
        for a, b in parts(texts):
            k, sizes = grams(texts[a:b])
            own, at = np.unique(k, return_inverse=True)
            coded.append((own, at.astype(np.int32), sizes))
        key = np.unique(np.concatenate([x[0] for x in coded])) if coded else np.empty(0, np.int64)
        coded = [(np.searchsorted(key, own).astype(np.int32)[at], sizes) for own, at, sizes in coded]

        def values(k: np.ndarray, kind: str, at: np.ndarray, form: type) -> np.ndarray:
            out = np.zeros(len(k), form)
            o = np.argsort(at, kind="stable")
            for part in np.split(o, np.nonzero(np.diff(at[o]))[0] + 1):
                if len(part):
                    out[part] = expand(reply[kind, int(at[part[0]])], form)
            return out

        cost = values(key, "grams", gram_bucket(key, n), np.float32)
        vocabulary: set[bytes] = set()
        for t, _, _ in texts:
            vocabulary.update(words_of(t))
        names = list(vocabulary)
        w = np.fromiter(map(word_key, names), np.int64, len(names))
        w_all = np.unique(np.append(w, END_WORD))
        counts = values(w_all, "words", word_bucket(w_all, n), np.int64)
        own = counts[np.searchsorted(w_all, w)]
        base = dict(zip(names, np.log10((own + 0.1) / (total + 0.1 * (v + 1))).tolist(), strict=True))
        known = {x for x, c in zip(names, own.tolist(), strict=True) if c > 0}
        end_n = int(counts[0])
        end = math.log10((end_n + 0.1) / (total + 0.1 * (v + 1)))
        scores = []
        for at, sizes in coded:
            scores.append(np.add.reduceat(cost[at].astype(np.float64), np.cumsum(sizes) - sizes))
        found = [words_of(t) for t, _, _ in texts]
        lasts = [last for _, _, last in texts]
        m = len(texts)
        return pa.table(
            [
                left.column("row"), left.column("doc_id"), pa.array([len(x) + last for x, last in zip(found, lasts, strict=True)], pa.int64()),
                pa.array([sum(map(known.__contains__, x)) + (last and end_n > 0) for x, last in zip(found, lasts, strict=True)], pa.int64()), pa.array([total] * m, pa.int64()),
                pa.array([math.fsum(map(base.__getitem__, x)) + end * last for x, last in zip(found, lasts, strict=True)], pa.float64()), pa.array(np.concatenate(scores), pa.float64()),
            ],
            ["row", "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    joined = rows.select("block", "row", "doc_id", "data", "before", "last").groupBy("block").cogroup(told.select("block", "kind", "bucket", "counts").groupBy("block"))
    out = joined.applyInArrow(apply, "row long, doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    if cut:
        out = stages.put(out)
        summed = out.filter("row is not null").groupBy("row", "doc_id").agg(*(F.sum(c).alias(c) if c != "train_tokens" else F.max(c).alias(c) for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score")))
        out = out.filter("row is null").unionByName(summed)
    return out.drop("row")


def op2_ppm(spark, sf_dir: str) -> DataFrame:
    held_out = F.pmod(id_hash(F.col("doc_id")), F.lit(10)) == 0
    found = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

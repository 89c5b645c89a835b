"""Removal of repeated passages by longest-previous-factor arrays.

A position whose longest previous factor (the longest string that starts there and also starts at an earlier position) reaches min_len bytes
starts a later copy. For a whole text the factor follows from suffix order: it is the longer of the common prefixes with the previous
and the next smaller position in that order (`longest_previous_factors`).

Over a corpus the suffixes are sorted in groups that no repeated string crosses. Each min_len-byte string selects one of its 32-byte grams, that
of least hash, as its anchor; equal strings select equal anchors at equal places. So all copies of a string meet in the group of its
anchor, where the suffixes start at the same distance before it. Contexts of an anchor, min_len bytes to the right and what can precede
it to the left, are pre-aggregated: equal ones count once, with their number and first place. A group sorts its contexts once
rightwards and once leftwards, which gives the suffix order of each distance and its common-prefix lengths. A suffix's factor reaches min_len exactly if its
previous or its next smaller position in that order lies in its run of min_len bytes in common (`reaches`). Anchors with more different contexts than one task sorts
are split: the min_len-byte strings around them are grouped by digest instead, which gives the same runs and their smallest positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, blocks_for, text_key

GRAM = 32
#: Bytes of a text that are hashed at once; parts overlap, so nothing depends on it.
PART = 1 << 19
LOW = np.uint64((1 << 20) - 1)
#: Contexts that one task sorts, about.
BLOCK_ROWS = 30_000


def suffix_array(data: bytes) -> np.ndarray:
    """Suffix order by prefix doubling."""
    n = len(data)
    rank = np.frombuffer(data, np.uint8).astype(np.int64) + 1
    order, h = np.argsort(rank, kind="stable"), 1
    while n:
        key = rank * (max(n, 256) + 2)
        key[: n - h if n > h else 0] += rank[h:]
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.cumsum(np.concatenate([[1], s[1:] != s[:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n:
            break
        h *= 2
    return order[:n]


def longest_previous_factors(data: bytes) -> np.ndarray:
    """For each position, the length of the longest string that starts there and at an earlier position too."""
    sa, n = suffix_array(data).tolist(), len(data)
    rank = [0] * n
    for i, p in enumerate(sa):
        rank[p] = i
    lcp, h = [0] * (n + 1), 0  # lcp[i]: of the suffixes i - 1 and i in order
    for p in range(n):
        if i := rank[p]:
            q = sa[i - 1]
            while max(p, q) + h < n and data[p + h] == data[q + h]:
                h += 1
            lcp[i] = h
            h = max(0, h - 1)
        else:
            h = 0
    # A stack of increasing positions: what leaves it has met its next smaller position; below it lies its previous smaller one.
    out, stack = [0] * n, []
    for i in [*range(n), n]:
        p, common = (sa[i], lcp[i]) if i < n else (-1, 0)
        while stack and stack[-1][0] > p:
            q, before = stack.pop()
            out[q] = max(before, common)
            common = min(before, common)
        stack.append((p, common))
    return np.array(out, np.int64)


def reaches(place: np.ndarray, new_run: np.ndarray) -> np.ndarray:
    """In suffix order, whether each suffix's longest previous factor reaches a length: whether the previous or the next smaller position is in its run.

    place: positions of the suffixes; new_run: where the common prefix with the suffix before is shorter than that length.
    """
    if not len(place):
        return np.zeros(0, bool)
    run, far = np.cumsum(new_run), int(place.max()) + 1
    before = place - run * far  # runs lie one below the other, so one pass keeps their minima apart
    after = (place - (run[-1] - run) * far)[::-1]
    return (before > np.minimum.accumulate(before)) | (after > np.minimum.accumulate(after))[::-1]


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every 32-byte gram, by doubling."""
    h = b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    n = 1
    for c in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        h = h[:-n] * np.uint64(c) + h[n:]
        h ^= h >> np.uint64(32)
        n *= 2
    return h


def least(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    n = 1
    while n * 2 <= width:
        a = np.minimum(a[:-n], a[n:])
        n *= 2
    return np.minimum(a[: len(a) - (width - n)], a[width - n :]) if n < width else a


def anchors(data: bytes, min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of all min_len-byte strings in data; of equal least hashes the last counts."""
    width = min_len - GRAM + 1
    at, what = [], []
    for start in range(0, max(1, len(data) - min_len + 1), PART):
        part = np.frombuffer(data, np.uint8, count=max(0, min(PART + min_len - 1, len(data) - start)), offset=start) if len(data) else np.empty(0, np.uint8)
        if len(part) < min_len:
            break
        h = gram_hashes(part)
        p = (LOW - (least((h & ~LOW) | (LOW - np.arange(len(h), dtype=np.uint64)), width) & LOW)).astype(np.int64)
        p = np.unique(p[np.concatenate([[True], p[1:] != p[:-1]])])
        at.append(p + start)
        what.append(h[p])
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    p, first = np.unique(np.concatenate(at), return_index=True)
    return p, np.concatenate(what)[first]


def common_prefixes(rows: list[bytes]) -> np.ndarray:
    """Common-prefix length of each row with the one before it."""
    out = np.zeros(len(rows), np.int64)
    for i in range(1, len(rows)):
        a, b = rows[i - 1], rows[i]
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            out[i] = n
        else:
            lo, hi = 0, n  # a[:lo] equal, a[:hi] not
            while hi - lo > 1:
                mid = (lo + hi) // 2
                if a[lo:mid] == b[lo:mid]:
                    lo = mid
                else:
                    hi = mid
            out[i] = lo
    return out


def sorted_side(group: np.ndarray, side: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by group and bytes, and common-prefix lengths in that order, -1 where a group begins."""
    order = np.array(sorted(range(len(side)), key=lambda i: (group[i], side[i])), np.int64)
    lcp = common_prefixes([side[i] for i in order])
    g = group[order]
    lcp[0] = -1
    lcp[1:][g[1:] != g[:-1]] = -1
    return order, lcp


def repeated_starts(group: np.ndarray, left: list[bytes], right: list[bytes], many: np.ndarray, place: np.ndarray, min_len: int, keep_first: bool) -> list[list[tuple[int, int]]]:
    """For each context the distances (from, to) before its anchor at which repeated strings start.

    left: bytes before the anchor, nearest first. many: the context occurs more than once. place: rank of its first occurrence.
    keep_first: of the first occurrence only, and without strings that occur nowhere earlier.
    """
    n, span = len(group), min_len - GRAM
    lorder, llcp = sorted_side(group, left)
    rorder, rlcp = sorted_side(group, right)
    llen, rlen = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    lclass, rclass, rrank = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    rrank[rorder] = np.arange(n)
    found = np.zeros((n, span + 3), np.int8)
    for d in range(span + 1):
        ok = (llen >= d) & (rlen >= min_len - d)
        if not ok.any():
            continue
        # Suffixes that agree on d bytes to the left stand together, in the order of what follows; a run agrees on min_len - d bytes of that.
        lclass[lorder] = np.cumsum(llcp < d)
        rclass[rorder] = np.cumsum(rlcp < min_len - d)
        i = np.nonzero(ok)[0]
        o = i[np.lexsort((rrank[i], lclass[i]))]
        new = np.concatenate([[True], (lclass[o][1:] != lclass[o][:-1]) | (rclass[o][1:] != rclass[o][:-1])])
        hit = reaches(place[o], new)
        if not keep_first:  # the first copy too: a larger position is in its run, or the same context comes again
            hit |= reaches(n - 1 - place[o], new) | many[o]
        found[o, d + 1] = hit
    step = np.diff(found, axis=1)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for (i, a), (_, b) in zip(np.argwhere(step == 1).tolist(), np.argwhere(step == -1).tolist(), strict=True):
        out[i].append((a, b - 1))
    return out


def spans(docs: DataFrame, min_len: int = 200, keep_first: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, key_, starts, ends): byte ranges of repeated strings, unmerged, for rows that have any.

    keep_first: only copies that are not the first in the order of (doc_id, place), where no id comes first; otherwise all copies.
    """
    spark, stages = docs.sparkSession, Stages(docs.sparkSession, "suffix-dedup")
    before = min_len - GRAM
    texts = docs.select("doc_id", text_key(F.col("text")).alias("key_"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column("data").to_pylist()):
                p, h = anchors(data, min_len)
                if not len(p):
                    continue
                ctx = [xxhash.xxh3_64_intdigest(data[max(0, x - before) : x + min_len], x if x < before else before) for x in p.tolist()]
                same = [pa.repeat(batch.column(c)[i], len(p)) for c in ("doc_id", "key_")]
                yield pa.record_batch([*same, pa.array(p), pa.array(h.view(np.int64)), pa.array(np.array(ctx, np.uint64).view(np.int64))], ["doc_id", "key_", "at", "anchor", "ctx"])

    occ = stages.put(texts.mapInArrow(occurrences, "doc_id long, key_ long, at long, anchor long, ctx long"))
    stages.free()
    place = F.struct("doc_id", "key_", "at")
    contexts = stages.put(occ.groupBy("anchor", "ctx").agg(F.count("*").alias("n"), F.min(place).alias("first")))
    # Written, so that the join has a plain shuffle on both sides and Spark can split a hot anchor's contexts.
    totals = stages.put(contexts.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("k")).filter("total > 1"))
    known = stages.put(contexts.join(totals.select("anchor", "k"), "anchor"))
    stages.drop(contexts)
    stages.free()

    # Contexts whose anchor has others too: their bytes are sorted.
    mixed = known.filter("k > 1")
    sizes = mixed.agg(F.count("*").alias("n"), F.max("k").alias("most")).first()
    n_blocks = blocks_for(sizes["n"], block_rows)
    asked = mixed.select("anchor", "ctx", "n", "k", F.col("first.doc_id").alias("doc_id"), F.col("first.key_").alias("key_"), F.col("first.at").alias("at"))
    asked = asked.groupBy("doc_id", "key_").agg(F.collect_list(F.struct("anchor", "ctx", "n", "k", "at")).alias("asked"))
    cut = texts.withColumnRenamed("doc_id", "id_").join(asked.withColumnRenamed("key_", "k_"), F.col("id_").eqNullSafe(F.col("doc_id")) & (F.col("key_") == F.col("k_"))).select("doc_id", "key_", "data", F.explode("asked").alias("x"))
    lo = F.greatest(F.col("x.at") - before, F.lit(0)).cast("int")
    cut = cut.select("x.anchor", "x.ctx", "x.n", "x.k", "doc_id", "key_", "x.at", F.substring("data", lo + 1, (F.col("x.at") - lo).cast("int")).alias("left"), F.substring("data", (F.col("x.at") + 1).cast("int"), F.lit(min_len)).alias("right"))
    # Rows that are equal in id and text give a context twice.
    cut = cut.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(n_blocks)))
    runs = "anchor long, ctx long, lo array<int>, hi array<int>"

    def decide(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in ("anchor", "ctx", "n", "doc_id", "key_", "at")}
        seen: dict[tuple, int] = {}
        for i, key in enumerate(zip(cols["anchor"], cols["ctx"], strict=True)):
            seen.setdefault(key, i)
        rows = np.array(sorted(seen.values()))
        table = table.take(pa.array(rows))
        pick = {c: [v[i] for i in rows] for c, v in cols.items()}
        where = list(zip((-(2**63) if v is None else v for v in pick["doc_id"]), pick["key_"], pick["at"], strict=True))
        rank = np.empty(len(rows), np.int64)
        rank[sorted(range(len(rows)), key=where.__getitem__)] = np.arange(len(rows))
        _, group = np.unique(np.array(pick["anchor"], np.int64), return_inverse=True)
        left = [bytes(x)[::-1] for x in table.column("left").to_pylist()]
        found = repeated_starts(group, left, table.column("right").to_pylist(), np.array(pick["n"]) > 1, rank, min_len, keep_first)
        return pa.table([pa.array(pick["anchor"], pa.int64()), pa.array(pick["ctx"], pa.int64()), pa.array([[a for a, _ in x] for x in found], pa.list_(pa.int32())), pa.array([[b for _, b in x] for x in found], pa.list_(pa.int32()))], ["anchor", "ctx", "lo", "hi"])

    split = (sizes["most"] or 0) > block_rows
    small = cut.filter(F.col("k") <= block_rows) if split else cut
    sorted_ = stages.put(small.drop("k").groupBy("block").applyInArrow(decide, runs))
    stages.free()
    if split:
        sorted_ = sorted_.unionByName(stages.put(by_digest(cut.filter(F.col("k") > block_rows).drop("k", "block").dropDuplicates(["anchor", "ctx"]), stages, min_len, keep_first)))
    whole = F.array(F.lit(0)), F.array(F.lit(before))
    alone = known.filter("k = 1").select("anchor", "ctx", *(F.array().cast("array<int>").alias(c) if keep_first else w.alias(c) for c, w in zip(("lo", "hi"), whole, strict=True)))
    verdict = sorted_.unionByName(alone)
    if keep_first:
        # Later occurrences of a context are later copies as a whole.
        verdict = verdict.join(known.select("anchor", "ctx", "first"), ["anchor", "ctx"])
    else:
        verdict = verdict.filter(F.size("lo") > 0)
    verdict = stages.put(verdict)
    # Distances that reach before the text's start or past its end are cut away: no string starts there.
    hits = occ.join(verdict, ["anchor", "ctx"])
    if keep_first:
        is_first = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.key_") == F.col("key_")) & (F.col("first.at") == F.col("at"))
        hits = hits.withColumn("lo", F.when(is_first, F.col("lo")).otherwise(whole[0])).withColumn("hi", F.when(is_first, F.col("hi")).otherwise(whole[1]))
    hits = hits.select("doc_id", "key_", "at", F.explode(F.arrays_zip("lo", "hi")).alias("r"))
    hits = hits.select("doc_id", "key_", (F.col("at") - F.col("r.hi")).alias("a"), (F.col("at") - F.col("r.lo")).alias("b"))
    # No more ranges than bytes in a text, as rows equal in id and text give each once. Written, so that the shuffle files and tables before it can go before the texts move.
    out = hits.groupBy("doc_id", "key_").agg(F.collect_set(F.struct("a", "b")).alias("r"))
    out = stages.put(out.select("doc_id", "key_", F.col("r.a").alias("starts"), F.col("r.b").alias("ends")))
    for df in (occ, totals, known, sorted_, verdict):
        stages.drop(df)
    stages.free()
    return out


def by_digest(cut: DataFrame, stages: Stages, min_len: int, keep_first: bool) -> DataFrame:
    """(anchor, ctx, lo, hi) as `repeated_starts` gives them, for anchors with more contexts (anchor, ctx, n, doc_id, key_, at, left, right) than one task sorts.

    Each min_len-byte string around an anchor gets a 128-bit digest; of equal ones the number and the smallest position are pre-aggregated and joined back.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (left, right) in enumerate(zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)):
                data, at = left + right, len(left)
                rows += [(i, d, xxhash.xxh3_128_digest(data[at - d : at - d + min_len])) for d in range(max(0, min_len - len(right)), min(at, min_len - GRAM) + 1)]
            take = pa.array([x[0] for x in rows], pa.int32())
            same = [batch.column(c).take(take) for c in ("anchor", "ctx", "n", "doc_id", "key_", "at")]
            yield pa.record_batch([*same, pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.binary())], ["anchor", "ctx", "n", "doc_id", "key_", "at", "d", "digest"])

    strings = stages.put(cut.select("anchor", "ctx", "n", "doc_id", "key_", "at", "left", "right").mapInArrow(digests, "anchor long, ctx long, n long, doc_id long, key_ long, at long, d int, digest binary"))
    place = F.struct("doc_id", "key_", "at")
    # The anchor is part of the group: distances count from it.
    runs = stages.put(strings.groupBy("anchor", "d", "digest").agg(F.sum("n").alias("total"), F.min(place).alias("first")).filter("total > 1"))
    hits = strings.join(runs, ["anchor", "d", "digest"])
    if keep_first:
        hits = hits.filter(~place.eqNullSafe(F.col("first")))
    found = hits.groupBy("anchor", "ctx").agg(F.sort_array(F.collect_set("d")).alias("d"))  # at most min_len distances
    out = found.select("anchor", "ctx", F.filter("d", lambda x: ~F.array_contains("d", x - 1)).alias("lo"), F.filter("d", lambda x: ~F.array_contains("d", x + 1)).alias("hi"))
    if not keep_first:
        return out
    # First places need a row each, with or without ranges.
    every = cut.select("anchor", "ctx").join(out, ["anchor", "ctx"], "left")
    nothing = F.array().cast("array<int>")
    return every.select("anchor", "ctx", F.coalesce("lo", nothing).alias("lo"), F.coalesce("hi", nothing).alias("hi"))


def merged(starts: list[int] | None, ends: list[int] | None, size: int, min_len: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by min_len-byte strings that start from starts[i] to ends[i] and lie in the text."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts or (), ends or (), strict=True)):
        a, b = max(a, 0), min(b, size - min_len)
        if a > b:
            continue
        b += min_len
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def dedup(docs: DataFrame, min_len: int = 200, keep_first: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text for each row of `docs` (doc_id, text); key_ tells rows of one id apart.

    Removes bytes covered by min_len-byte strings that start elsewhere too (keep_first: earlier) in the table; matches do not cross
    documents. kept_sha256 is of the remaining bytes, kept_text drops what a cut leaves of a broken character. Null and empty texts: nothing.
    Rows equal in id and text are copies of each other; with keep_first neither is the later one. Empty table: no rows.
    """
    if min_len < 2 * GRAM:
        raise ValueError(f"min_len must be {2 * GRAM} or more")
    found = spans(docs, min_len, keep_first, block_rows).select(F.col("doc_id").alias("id_"), F.col("key_").alias("k_"), "starts", "ends")
    texts = docs.select("doc_id", text_key(F.col("text")).alias("key_"), "text")
    rows = texts.join(found, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("key_") == F.col("k_")), "left").select("doc_id", "key_", "text", "starts", "ends")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends")), strict=True):
                data = (text or "").encode()
                gone = merged(starts, ends, len(data), min_len)
                left, at = [], 0
                for a, b in gone:
                    left.append(data[at:a])
                    at = b
                left.append(data[at:])
                kept = b"".join(left)
                out.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), text if not gone else b"".join(x.decode("utf-8", "ignore").encode() for x in left).decode()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, types, strict=True)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("key_"), *cols], ["doc_id", "key_", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return rows.mapInArrow(remove, "doc_id long, key_ long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), 200, keep_first=False).drop("key_", "kept_text")

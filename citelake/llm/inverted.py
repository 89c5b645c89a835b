"""Inverted lists of shingles: T-occurrence search, and how the sets that can be similar come together in tasks."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import groupby
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, blocks_for
from .components import components

#: Prefixes that a shingle may be in before it counts as hot, and how many shingles can be hot at most.
HOT, HOT_SHINGLES = 256, 1 << 20
#: Shingles of prefixes that one task searches, about; whole sets are six to seven times as large, and fewer.
WEIGHT = 1 << 19
#: Weighs probing long lists against merging them.
MU = 0.01
#: Entries of lists that are merged in a heap.
HEAP = 256


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n shares with any set that is similar to it."""
    return -(-n * percent // 100)


class Lists:
    """Inverted lists of some sets, of the shingles that two of them or more share. One array holds them all, in the order of shingles, then of sets."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray):
        self.sets, self.labels, self.n = sets, labels, len(sets)
        self.size = np.array([len(s) for s in sets], np.int64)
        flat, who = np.concatenate(sets), np.repeat(np.arange(self.n), self.size)
        order = np.argsort(flat, kind="stable")
        flat, who = flat[order], who[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(flat))
        of = labels[who]
        lo, hi = np.minimum.reduceat(of, at), np.maximum.reduceat(of, at)
        keep = end - at > 1
        inside = np.repeat(keep, end - at)
        self.token, self.lo, self.hi, self.who = flat[at][keep], lo[keep], hi[keep], who[inside]
        self.length = (end - at)[keep]
        self.at = np.cumsum(self.length) - self.length
        self.entry = np.repeat(np.arange(len(self.token)), self.length) * self.n + self.who  # ascending, so that any list is probed by one search

    def of(self, q: int) -> np.ndarray:
        """The lists of set q that hold a set of another label."""
        k = np.searchsorted(self.token, self.sets[q])
        k[k == len(self.token)] = 0
        k = k[self.token[k] == self.sets[q]] if len(self.token) else k[:0]
        own = self.labels[q]
        return k[(self.lo[k] != own) | (self.hi[k] != own)]

    def counts(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, in how many of the lists k it is)."""
        n = np.bincount(self.members(k), minlength=self.n)
        found = np.flatnonzero(n)
        return found, n[found]

    def members(self, k: np.ndarray) -> np.ndarray:
        """What the lists k hold, one after the other."""
        step = np.cumsum(self.length[k]) - self.length[k]
        return self.who[np.repeat(self.at[k] - step, self.length[k]) + np.arange(self.length[k].sum())]

    def divide_skip(self, k: np.ndarray, t: int, need: np.ndarray | None = None, skip: Callable[[int], bool] = lambda i: False) -> dict[int, int]:
        """(set: number of lists) for sets that are in t of the lists k or more; need: how many each set must be in, if that is more; skip: sets that need not be found.

        The longest lists are set aside, fewer than t. The others are merged in a heap, or, where they hold more than HEAP sets, by a merge sort, as they are runs in order; what occurs often enough
        there is searched for in the long ones.
        """
        if len(k) < t:
            return {}
        k = k[np.argsort(self.length[k], kind="stable")]
        aside = max(0, min(t - 1, ceil(t / (MU * log2(self.length[k[-1]] + 1) + 1))))
        short, long_ = k[: len(k) - aside], k[len(k) - aside :] * self.n
        if self.length[short].sum() <= HEAP:
            merged = [(i, sum(1 for _ in run)) for i, run in groupby(heapq.merge(*(self.who[a:b].tolist() for a, b in zip(self.at[short].tolist(), (self.at[short] + self.length[short]).tolist(), strict=True))))]
            ids, n = np.array([i for i, _ in merged], np.int64), np.array([c for _, c in merged], np.int64)
        else:
            run = np.sort(self.members(short), kind="stable")
            at = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            ids, n = run[at], np.diff(np.append(at, len(run)))
        least = np.full(len(ids), t) if need is None else np.maximum(need[ids], t)
        found = {}
        for i, c, want in zip(*(x[n + aside >= least].tolist() for x in (ids, n, least)), strict=True):
            if skip(i):
                continue
            at = np.searchsorted(self.entry, long_ + i)
            at[at == len(self.entry)] = 0
            c += int((self.entry[at] == long_ + i).sum())
            if c >= want:
                found[i] = c
        return found


def finder(root: list[int]) -> Callable[[int], int]:
    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    return find


def unique(table: pa.Table) -> list[int]:
    """Row numbers of `table` (sid, query), one for each set, in order; a row that asks goes first."""
    rows: dict[int, int] = {}
    asks = table.column("query").to_pylist()
    for i, s in enumerate(table.column("sid").to_pylist()):
        if s not in rows or asks[i]:
            rows[s] = i
    return sorted(rows.values())


def askers(labels: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """Which sets need to ask. Of two labels one is not the most frequent, so if all others ask, the sets of that one need not."""
    most = np.bincount(labels).argmax()
    return np.flatnonzero(asks & (labels != most) if asks[labels != most].all() else asks)


def may_reach(r: np.ndarray, n: int, s: np.ndarray, m: int, both: int, percent: int) -> bool:
    """Whether sets of n and m shingles, with the prefixes r and s and `both` shingles of these in common, can be similar.

    Up to where the first prefix ends, shingles that only one has are known; the rest of each set must suffice.
    """
    if min(n, m) * 100 < percent * max(n, m):
        return False
    need, end = -(-percent * (n + m) // (100 + percent)), min(r[-1], s[-1])
    return both >= need + max(int(np.searchsorted(r, end, "right")) - n, int(np.searchsorted(s, end, "right")) - m)


class Reach:
    """`may_reach` of one set with many: prefixes as one array of ascending keys, of the set and of the shingle's rank."""

    def __init__(self, prefixes: list[np.ndarray], size: np.ndarray, percent: int):
        self.size, self.percent = size, percent
        length = np.array([len(x) for x in prefixes], np.int64)
        self.at = np.cumsum(length) - length
        self.end = self.at + length
        self.rank = np.unique(np.concatenate(prefixes), return_inverse=True)[1].astype(np.int64)
        self.key = (np.repeat(np.arange(len(prefixes)), length) << 32) + self.rank
        self.last = self.rank[self.end - 1]

    def of(self, q: int, found: np.ndarray, both: np.ndarray) -> np.ndarray:
        """Which of the sets `found`, with `both` shingles of their prefixes in that of set q, can be similar to it."""
        n, m = self.size[q], self.size[found]
        need, end = -(-self.percent * (n + m) // (100 + self.percent)), np.minimum(self.last[q], self.last[found])
        own = np.searchsorted(self.rank[self.at[q] : self.end[q]], end, "right")
        other = np.searchsorted(self.key, (found << 32) + end, "right") - self.at[found]
        return (np.minimum(n, m) * 100 >= self.percent * np.maximum(n, m)) & (both >= need + np.maximum(own - n, other - m))


def arrays(lists: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """The rows of a column of lists without nulls."""
    return np.split(pc.list_flatten(lists).to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy())[:-1])


def sieve(table: pa.Table, percent: int) -> pa.Table:
    """Rows of `table` (task, sid, n, label, query, prefix) that may have a similar set of another label here, by prefixes, with the group that they are to meet in."""
    take = unique(table)
    table = table.take(pa.array(take, pa.int64()))
    names, labels = np.unique(table.column("label").to_numpy(), return_inverse=True)
    root = np.arange(len(take))
    find = finder(root)
    kept = np.zeros(len(take), bool)
    if len(names) > 1:
        prefixes = arrays(table.column("prefix"))
        lists, reach = Lists(prefixes, labels), Reach(prefixes, table.column("n").to_numpy(), percent)
        for q in askers(labels, np.array(table.column("query").to_pylist(), bool)).tolist():
            found, both = lists.counts(lists.of(q))
            # What is known to meet q needs no other reason.
            new = (labels[found] != labels[q]) & ~(kept[found] & kept[q] & (root[found] == find(q)))
            found, both = found[new], both[new]
            for i in found[reach.of(q, found, both)].tolist():
                kept[q] = kept[i] = True
                root[find(i)] = find(q)
    sids = table.column("sid").to_pylist()
    rows = np.flatnonzero(kept).tolist()
    out = table.select(["task", "sid", "n", "label", "query"]).take(pa.array(rows, pa.int64()))
    return out.append_column("met", pa.array([sids[find(i)] for i in rows], pa.int64()))


def search(table: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) between sets of different labels in `table` (sid, label, query, hashes), as many as join what can be joined here. Rows that repeat a set count once."""
    take = unique(table)
    table = table.take(pa.array(take, pa.int64()))
    sids = table.column("sid").to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    names, labels = np.unique(np.array(table.column("label").to_pylist(), np.int64), return_inverse=True)
    a, b, root = [], [], list(range(len(names)))
    find = finder(root)
    if len(names) > 1:
        lists = Lists(sets, labels)
        for q in askers(labels, np.array(table.column("query").to_pylist(), bool)).tolist():
            n = len(sets[q])
            need = -(-percent * (n + lists.size) // (100 + percent))
            found = lists.divide_skip(lists.of(q), least_overlap(n, percent), need, lambda i, q=q: find(labels[i]) == find(labels[q]))
            for i, both in found.items():
                if 100 * both >= percent * (n + len(sets[i]) - both) and find(labels[i]) != find(labels[q]):
                    root[find(labels[i])] = find(labels[q])
                    a.append(sids[q])
                    b.append(sids[i])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


LINK, TOKENS = "a long, b long", "sid long, n long, tokens array<long>"


def core_size(n: Column, percent: int) -> Column:
    """Of the first shingles of a set, those among which it has one in common with any similar set that is as large or larger."""
    return n - F.ceil(2 * percent * n / (100 + percent)) + 1


def prefix(hashes: np.ndarray, percent: int, hot: np.ndarray | None = None, spare: int = 0) -> np.ndarray:
    """The first |r| - T + 1 shingles of a set, and `spare` more, in the order of all shingles, ascending, each as its place there: `hot` ones (sorted places) last, then by hash."""
    place = marked((hashes >> np.uint64(8)).astype(np.int64), hot)
    return np.sort(place)[: prefix_size(len(hashes), percent) + spare]


def prefix_size(n: int, percent: int) -> int:
    return n - least_overlap(n, percent) + 1


def spare_size(n: int, percent: int) -> int:
    """Shingles behind its prefix that are kept of a set, to take the place of hot ones."""
    return 4 + prefix_size(n, percent) // 8


def marked(place: np.ndarray, hot: np.ndarray | None) -> np.ndarray:
    if hot is not None and len(hot):
        at = np.searchsorted(hot, place)
        at[at == len(hot)] = 0
        place = place | (hot[at] == place).astype(np.int64) << 60
    return place


def reordered(begin: np.ndarray, n: int, percent: int, hot: np.ndarray) -> np.ndarray | None:
    """The prefix of a set of n with `hot` shingles last, from its `begin` in the order of hashes; None if that is too short to tell."""
    size, place = prefix_size(n, percent), np.sort(marked(begin, hot))
    return place[:size] if len(begin) == n or (len(place) >= size and place[size - 1] < 1 << 60) else None


def band(n: Column, percent: int) -> Column:
    """Sizes in bands, a trifle wider than similarity allows: of two that can be similar, one is in the other's band or in the next."""
    return F.floor(F.log(n.cast("double")) / (float(np.log(100 / percent)) * (1 + 1e-9))).cast("int")


def postings(sets: DataFrame, percent: int) -> DataFrame:
    """(token, sid, n, core) of sets (sid, n, tokens), their prefixes."""
    return sets.select("sid", "n", F.posexplode("tokens").alias("at", "token")).select("token", "sid", "n", (F.col("at") < core_size(F.col("n"), percent)).alias("core"))


def without_hot(sets: DataFrame, again: Callable[[DataFrame, np.ndarray], DataFrame], percent: int, stages: Stages, hot: int = HOT) -> DataFrame:
    """`sets` (sid, n, tokens, spare) with other prefixes where these hold a hot shingle, all hot shingles last: from the spare shingles that follow, or, where these are too few, as `again` gives them for some sids.

    Hot is what more than `hot` prefixes hold, and more than one in HOT_SHINGLES of all postings, so hot shingles are HOT_SHINGLES at most. Any order would do; this one keeps
    passages that many texts share out of the lists, unless a text has little else.
    """
    each = postings(sets, percent)
    total = sets.agg(F.sum(F.size("tokens")).alias("n")).first()["n"] or 0
    found = each.groupBy("token").agg(F.count("*").alias("m")).filter(F.col("m") > max(hot, total // HOT_SHINGLES)).select("token")
    found = stages.put(found)
    places = np.sort(np.array([r["token"] for r in found.collect()], np.int64))
    if not len(places):
        return sets
    shared = sets.sparkSession.sparkContext.broadcast(places)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(lambda b: b.num_rows, batches):
            begins = (np.concatenate(x) for x in zip(arrays(batch.column("tokens")), arrays(batch.column("spare")), strict=True))
            out = [reordered(x, n, percent, shared.value) for x, n in zip(begins, batch.column("n").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("sid"), batch.column("n"), pa.array(out, pa.list_(pa.int64()))], ["sid", "n", "tokens"])

    new = stages.put(sets.select("sid", "n", "tokens", "spare").mapInArrow(order, TOKENS))
    short = stages.put(new.filter("tokens is null").select("sid"))
    return new.filter("tokens is not null").unionByName(stages.put(again(short, places).select("sid", "n", "tokens")))


def live_rows(sets: DataFrame, percent: int, stages: Stages) -> DataFrame:
    """(token, band, sid, n, c): what the lists of sets (sid, n, tokens) hold, and the first set of each; lists of one set, and those that no similar pair needs, are left out.

    Lists hold sets of like size only: each set stands in its own band and in the next. Of a similar pair, one set has the shingle that brings them together in its core.
    """
    each = postings(sets, percent)
    lists = stages.put(each.groupBy("token").agg(F.count("*").alias("m"), F.max("core").alias("any")).filter("m > 1 and any").select("token"))
    shared = each.join(lists, "token").select("token", "sid", "n", "core", F.explode(F.array(band(F.col("n"), percent), band(F.col("n"), percent) + 1)).alias("band"))
    shared = stages.put(shared)
    centres = stages.put(shared.groupBy("token", "band").agg(F.count("*").alias("m"), F.max("core").alias("any"), F.min(F.struct("n", "sid")).alias("c")).filter("m > 1 and any").select("token", "band", "c"))
    live = stages.put(shared.drop("core").join(centres, ["token", "band"]))
    for df in (lists, shared, centres):
        stages.drop(df)
    stages.free()
    return live


class Dealt:
    """Deals sets out to tasks of about `weight` shingles. sets: (sid, tokens), their prefixes; full: gives (sid, hashes) of some sids, for the sets that prefixes leave."""

    def __init__(self, sets: DataFrame, full: Callable[[DataFrame], DataFrame], stages: Stages, percent: int, weight: int):
        self.sets, self.full, self.stages, self.percent, self.weight = sets, full, stages, percent, weight

    def links(self, asked: DataFrame) -> DataFrame:
        """asked: (where, n, sid, label, query); rows of one `where` must meet."""
        percent, stages = self.percent, self.stages
        blocks = lambda d, each: F.lit(blocks_for(d.agg(F.sum("n").alias("n")).first()["n"], each))
        task = F.pmod(F.xxhash64("where"), blocks(asked.select("where", "sid", "n").distinct(), self.weight * 100 // (100 - percent)))
        # Once a task, however many lists bring a set there.
        rows = asked.groupBy(task.alias("task"), "sid", "label").agg(F.max("query").alias("query"), F.first("n").alias("n"))
        left = stages.put(rows.join(self.sets.select("sid", F.col("tokens").alias("prefix")), "sid").groupBy("task").applyInArrow(lambda t: sieve(t, percent), "task long, sid long, n long, label long, query boolean, met long"))
        stages.free()
        meeting = stages.put(families(left, 2 * self.weight, stages))
        full = stages.put(self.full(left.select("sid").distinct()))
        stages.free()
        task = F.pmod(F.xxhash64("where"), blocks(meeting, 2 * self.weight))
        rows = meeting.groupBy(task.alias("deal"), "sid", "label").agg(F.max("query").alias("query"))
        found = stages.put(rows.join(full, "sid").groupBy("deal").applyInArrow(lambda t: search(t, percent), LINK).distinct())
        for df in (left, meeting, full):
            stages.drop(df)
        stages.free()
        return found


def families(left: DataFrame, weight: int, stages: Stages) -> DataFrame:
    """(where, sid, label, query, n) of sets (task, sid, n, label, query, met): where a set meets others, whole.

    A set may have been left by many tasks. Sets that the sieve has joined, by way of others too, are a family: it meets in one place, each set once, unless it is larger than
    `weight`. Of such a family those meet that one task's sieve has joined.
    """
    family = components(left.select(F.col("met").alias("a"), F.col("sid").alias("b")), stages).select(F.col("node").alias("sid"), F.col("label").alias("family"))
    size = left.select("sid", "n").distinct().join(family, "sid").groupBy("family").agg(F.sum("n").alias("w"))
    small = F.col("w") <= weight
    where = F.when(small, F.struct(F.col("family").alias("a"), F.lit(-1).cast("long").alias("b"))).otherwise(F.struct(F.col("met").alias("a"), F.col("task").alias("b")))
    return left.join(family, "sid").join(size, "family").groupBy(where.alias("where"), "sid", "label").agg(F.max("query").alias("query"), F.first("n").alias("n"))


def parts_of(where: list[str], rows: DataFrame, stages: Stages, weight: int) -> DataFrame:
    """(where, parts): tasks that what meets in one place is cut into."""
    return stages.put(rows.groupBy(*where).agg(F.greatest(F.ceil(F.sum("n") / weight), F.lit(1)).cast("int").alias("parts")))


def star_rows(stars: DataFrame, stages: Stages, weight: int) -> DataFrame:
    """The first set of a list with the others, in parts if these are many; the first one asks."""
    parts = parts_of(["c"], stars, stages, weight)
    cut = stars.join(parts, "c").withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")))
    where = F.struct("c", "part").alias("where")
    members = cut.select(where, "n", "sid", F.col("sid").alias("label"), F.lit(False).alias("query"))
    centres = cut.select(where, F.col("cn").alias("n"), F.col("c").alias("sid"), F.col("c").alias("label"), F.lit(True).alias("query")).distinct()
    return members.unionByName(centres)


def open_rows(live: DataFrame, labels: DataFrame, weight: int, stages: Stages) -> DataFrame:
    """Sets of the lists that still hold several components; lists with the same sets count once. Lists with one first set hold much the same sets and meet together, if that is not too much for
    a task. A list too long for a task is cut into parts, and each two of them meet."""
    now = live.select(F.struct("token", "band").alias("list"), "sid", "n", F.col("c.sid").alias("c")).join(labels.select(F.col("node").alias("sid"), "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    same = F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("h")
    open_ = now.groupBy("list").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"), same, F.sum("n").alias("w")).filter("lo <> hi")
    open_ = open_.groupBy("m", "h").agg(F.min("list").alias("list"), F.first("w").alias("w"))
    parts = F.greatest(F.ceil(F.col("w") / weight), F.lit(1)).cast("int")
    left = stages.put(now.join(open_.select("list", parts.alias("parts")), "list"))
    light = stages.put(left.select("c", "sid", "n").distinct().groupBy("c").agg(F.sum("n").alias("w")).filter(F.col("w") <= weight).select("c", F.lit(True).alias("light")))
    own = left.join(light, "c", "left").withColumn("x", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    met = own.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    apart = F.col("light").isNull()
    where = F.struct(F.when(apart, F.col("list")).alias("list"), F.when(~apart, F.col("c")).alias("c"), F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).alias("where")
    return met.select(where, "n", "sid", "label", F.lit(True).alias("query"))

"""A Merkle manifest of a table: a tree for each group over its rows in order, and a tree over the groups' roots.

Forests form a monoid. A fragment is a set of unresolved nodes keyed by tree, level and index; the sum of two fragments is their union, in
which every run of siblings that is now complete has become its parent, again and again. How many siblings a run has is known
beforehand, as the number of leaves of each tree is. The sum doesn't depend on order or grouping, so fragments of sorted partitions,
each a few nodes on its two edges, are added up in a tree of merges. A complete tree's root becomes a leaf of the tree over the groups.

Merges write the nodes that they resolve. What a partition needs from outside for its rows' proofs are the runs on the way
from its unresolved nodes to the root, and it finds those among them. Neither nodes nor fragments pass through the driver: there is one row for each partition there,
with its edges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, blocks_for, id_hash

#: Leaves of a partition, and fragments that one task merges, about.
PART_ROWS, FAN_IN = 1 << 17, 256
#: The tree over the groups' roots; trees of groups are numbered from 0 in order.
TOP = -1

Key = tuple[int, int, int]  # tree, level, index


def digest(parts: list[bytes]) -> bytes:
    """sha256 of digests, as hex text, one after the other."""
    return hashlib.sha256("".join(x.hex() for x in parts).encode()).digest()


class Forest:
    """Adds up fragments. sizes: leaves of each tree that is met."""

    def __init__(self, arity: int, sizes: dict[int, int]):
        self.arity, self.sizes, self.levels = arity, sizes, {}
        self.open: dict[Key, bytes] = {}
        self.resolved: dict[Key, bytes] = {}

    def size(self, tree: int, level: int) -> int:
        known = self.levels.setdefault(tree, [self.sizes[tree]])
        while len(known) <= level:
            known.append(-(-known[-1] // self.arity))
        return known[level]

    def run(self, key: Key) -> tuple[Key, range]:
        """The parent of a node and the indices of the parent's children. A group's root has the top tree's leaf as its parent."""
        tree, level, i = key
        if self.size(tree, level) == 1:
            return (TOP, 0, tree), range(i, i + 1)
        p = i // self.arity
        return (tree, level + 1, p), range(p * self.arity, min(p * self.arity + self.arity, self.size(tree, level)))

    def is_root(self, key: Key) -> bool:
        return key[0] == TOP and self.size(TOP, key[1]) == 1

    def path(self, key: Key) -> Iterator[tuple[Key, Key, range]]:
        """(node, parent, run) from a node to the root; steps from a group's root to the top tree's leaf aren't shown, as both are one node."""
        while not self.is_root(key):
            parent, run = self.run(key)
            if parent[0] == key[0]:
                yield key, parent, run
            key = parent

    def add(self, key: Key, value: bytes) -> None:
        """Adds a node, and each parent that is complete by it."""
        while True:
            self.open[key] = value
            if self.is_root(key):
                return
            parent, run = self.run(key)
            if parent[0] != key[0]:  # one node by another name
                del self.open[key]
                key = parent
                continue
            tree, level, _ = key
            found = [self.open.get((tree, level, i)) for i in run]
            if None in found:
                return
            for i in run:
                self.resolved[tree, level, i] = self.open.pop((tree, level, i))
            key, value = parent, digest(found)


def encoded(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(encoded, values)), 256))


def other_leaf(fields: tuple[str, ...], tampered: dict[str, Column]) -> Column:
    """The digest of a row with other values; null where none is other."""
    changed = F.lit(False)
    for f, c in tampered.items():
        changed = changed | ~F.col(f).eqNullSafe(c)
    return F.when(changed, leaf([tampered.get(f, F.col(f)) for f in fields]))


NODE = "part long, tree long, level int, i long, size long, digest binary, kind string"


def node_table(rows: list[tuple]) -> pa.Table:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string())
    names = ["part", "tree", "level", "i", "size", "digest", "kind"]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, types, strict=True)], names)


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None, arity: int = 2, part_rows: int = PART_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified for each row of `docs` (`key` long, `fields`).

    leaf: digest of the row's fields. subroot: root of the tree over the leaves of the row's group, by key, null first; root: of the tree over the
    subroots, by group, null first. proof_sha256: digest of the siblings on the way to the root, from the bottom and from left to right.
    tampered: fields with other values for the check; folded_root is what the (tampered) leaf and the siblings give, verified whether it is the root.
    Rows that are equal in key and group stand in the order of their leaves, and equal rows are leaves of their own. A single leaf is its subroot, a
    single subroot the root. Null keys and groups are values like others. Long texts are digested by Spark and don't move. Other columns are ignored. An empty table gives no rows.
    """
    spark, stages = docs.sparkSession, Stages(docs.sparkSession, "merkle")
    sent = docs.select(F.col(key).cast("long").alias("key_"), F.col(group).cast("string").alias("group_"), leaf([F.col(f) for f in fields]).alias("leaf"), other_leaf(fields, tampered or {}).alias("other"))
    hashed = stages.put(sent)
    n = hashed.count()
    parts = blocks_for(n, part_rows)
    parts = max(parts, min(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks_for(n, 2000)))
    order = [F.col("group_").asc_nulls_first(), F.col("key_").asc_nulls_first(), "leaf", "tie"]
    # The tie deals out rows that are equal; their leaves are equal too, so it changes nothing else.
    ranged = hashed.withColumn("tie", F.rand(13)).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the partition, the group's number in it and the place in both."""
        part, g, at, last = TaskContext.get().partitionId(), -1, 0, object()
        for batch in batches:
            gs, ats = [], []
            for name in batch.column("group_").to_pylist():
                if name != last:
                    last, g, at = name, g + 1, 0
                gs.append(g)
                ats.append(at)
                at += 1
            yield pa.record_batch([*(batch.column(c) for c in ("key_", "group_", "leaf", "other")), pa.array([part] * len(gs), pa.int64()), pa.array(gs, pa.int64()), pa.array(ats, pa.int64())], ["key_", "group_", "leaf", "other", "part", "g", "at"])

    leaves = stages.put(ranged.mapInArrow(number, "key_ long, group_ string, leaf binary, other binary, part long, g long, at long"))
    stages.drop(hashed)
    stages.free()
    edges, n_groups = _edges(leaves)
    rows = leaves.drop("group_").join(F.broadcast(edges), "part") if n else leaves.drop("group_").withColumns({c: F.lit(0).cast("long") for c in ("rank", "first_at", "first_size", "last_size", "last_g")})

    def places(table: pa.Table) -> tuple[list[Key], dict[int, int], list[int]]:
        """Leaf keys of a partition's rows, sizes of their trees, and the rows in order."""
        g, at = table.column("g").to_pylist(), table.column("at").to_pylist()
        rank, first_at, first_size, last_size, last_g = (table.column(c)[0].as_py() for c in ("rank", "first_at", "first_size", "last_size", "last_g"))
        sizes: dict[int, int] = {TOP: n_groups}
        for x in g:
            sizes[rank + x] = sizes.get(rank + x, 0) + 1
        sizes[rank + last_g] = last_size
        sizes[rank] = first_size
        keys = [(rank + x, 0, y + (first_at if x == 0 else 0)) for x, y in zip(g, at, strict=True)]
        return keys, sizes, sorted(range(len(keys)), key=keys.__getitem__)

    def fragment(table: pa.Table) -> pa.Table:
        keys, sizes, in_order = places(table)
        part, forest = table.column("part")[0].as_py(), Forest(arity, sizes)
        values = table.column("leaf").to_pylist()
        for i in in_order:
            forest.add(keys[i], values[i])
        # Runs that are still open on the way from an unresolved node to the root, named by the parent.
        asked = {parent: None for k in forest.open for _, parent, _ in forest.path(k)}
        out = [(part, *k, sizes[k[0]], v, "open") for k, v in forest.open.items()]
        return node_table(out + [(part, *k, sizes[k[0]], None, "asked") for k in asked])

    nodes = stages.put(rows.groupBy("part").applyInArrow(fragment, NODE))
    open_, resolved = nodes.filter("kind = 'open'"), []
    width = parts = max(parts, (leaves.agg(F.max("part")).first()[0] or 0) + 1)

    def merge(table: pa.Table) -> pa.Table:
        cols = [table.column(c).to_pylist() for c in ("part", "tree", "level", "i", "size", "digest")]
        forest = Forest(arity, {TOP: n_groups, **dict(zip(cols[1], cols[4], strict=True))})
        for _, t, lv, i, _, v in zip(*cols, strict=True):
            forest.add((t, lv, i), v)
        part = cols[0][0] // fan_in
        return node_table([(part, *k, forest.sizes[k[0]], v, kind) for kind, d in (("open", forest.open), ("resolved", forest.resolved)) for k, v in d.items()])

    while True:  # a tree of merges over neighbouring fragments
        step = stages.put(open_.groupBy((F.col("part") / fan_in).cast("long").alias("to")).applyInArrow(merge, NODE))
        open_ = step.filter("kind = 'open'")
        resolved.append(step.filter("kind = 'resolved'"))
        width = blocks_for(width, fan_in)
        if width == 1:
            break
    left = open_.select("tree", "digest").take(2)
    if n and (len(left) != 1 or left[0]["tree"] != TOP):
        raise RuntimeError("the fragments do not add up to one tree")
    root = bytes(left[0]["digest"]) if n else b""

    done = resolved[0]
    for more in resolved[1:]:
        done = done.unionByName(more)
    done = done.select("tree", (F.col("level") + 1).alias("level"), (F.col("i") / arity).cast("long").alias("p"), F.col("i").alias("child"), "digest")
    asked = nodes.filter("kind = 'asked'").select("part", "tree", "level", F.col("i").alias("p"))
    # A group's root is the top tree's leaf, so a row of it finds its subroot there.
    given = stages.put(asked.join(done, ["tree", "level", "p"]).select("part", "tree", (F.col("level") - 1).cast("int").alias("level"), F.col("child").alias("i"), "digest"))
    stages.free()

    def prove(table: pa.Table, outside: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _proofs([], [])
        keys, sizes, in_order = places(table)
        forest = Forest(arity, sizes)
        values, others = table.column("leaf").to_pylist(), table.column("other").to_pylist()
        for i in in_order:
            forest.add(keys[i], values[i])
        known = forest.resolved | forest.open
        for t, lv, i, v in zip(*(outside.column(c).to_pylist() for c in ("tree", "level", "i", "digest")), strict=True):
            known[t, lv, i] = v
        out = []
        for i, k in enumerate(keys):
            other = others[i]
            proof, fold, subroot = [], values[i] if other is None else other, None
            for node, _, run in forest.path(k):
                if subroot is None and node[0] == TOP:
                    subroot = known[node]
                around = [known[node[0], node[1], j] for j in run if j != node[2]]
                proof += around
                around.insert(node[2] - run[0], fold)
                fold = digest(around)
            out.append((values[i].hex(), (subroot or root).hex(), root.hex(), digest(proof).hex(), fold.hex(), fold == root))
        return _proofs(table.column("key_").to_pylist(), out)

    out = rows.groupBy("part").cogroup(given.groupBy("part")).applyInArrow(prove, "key_ long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumnRenamed("key_", key)


def _proofs(keys: list, out: list[tuple]) -> pa.Table:
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    cols = list(zip(*out, strict=True)) if out else [()] * 6
    return pa.table([pa.array(keys, pa.int64()), *(pa.array(c, pa.string()) for c in cols[:5]), pa.array(cols[5], pa.bool_())], ["key_", *names, "verified"])


def _edges(leaves: DataFrame) -> tuple[DataFrame, int]:
    """A row for each partition: the number of its first group, where that group's rows begin, how many leaves its first and last group have in all, and the last group's number in it; and the number of groups.

    Partitions are as many as `manifest` says, so these rows are few.
    """
    ends = leaves.groupBy("part").agg(
        F.max("g").alias("last_g"), F.count_if(F.col("g") == 0).alias("n_first"), F.min_by(F.struct("group_"), "g").alias("first_group"), F.max_by(F.struct("group_"), "g").alias("last_group"), F.max(F.struct("g", "at"))["at"].alias("last_at")
    )
    found = sorted(ends.collect(), key=lambda r: r["part"])
    out, rank, before, runs = [], -1, None, {}
    for r in found:
        first, last = (r["first_group"]["group_"],), (r["last_group"]["group_"],)
        continues = before == first
        rank += 0 if continues else 1
        begun = runs.get(rank, 0) if continues else 0
        runs[rank] = begun + r["n_first"]
        out.append([r["part"], rank, begun, rank + r["last_g"], r["last_g"]])
        rank += r["last_g"]
        if r["last_g"]:
            runs[rank] = r["last_at"] + 1
        before = last
    rows = [(part, first, begun, runs[first], runs[end], last_g) for part, first, begun, end, last_g in out]
    edges = leaves.sparkSession.createDataFrame(rows, "part long, rank long, first_at long, first_size long, last_size long, last_g long")
    return edges, rank + 1


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return manifest(docs, tampered={"n_chars": F.when(id_hash(F.col("doc_id")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})


def _sql() -> str:
    enc = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    row = lambda n_chars: "sha256(" + " || ".join(map(enc, ("doc_id", "source", "lang", n_chars, "text"))) + ")"
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"
    return f"""
WITH RECURSIVE c AS (SELECT *, CASE WHEN {crc} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS bad_n FROM documents),
v AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, {row("n_chars")} AS leaf, {row("bad_n")} AS bad FROM c),
t(r, lv, i, n, h) AS (SELECT r, 0, i, n, leaf FROM v UNION ALL SELECT r, lv + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY r, lv, i // 2, n),
sub AS (SELECT r, h FROM t WHERE n = 1),
s(lv, i, n, h) AS (SELECT 0, r, (SELECT count(*) FROM sub), h FROM sub UNION ALL SELECT lv + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM s WHERE n > 1 GROUP BY lv, i // 2, n),
nodes AS (SELECT 0 AS top, r, lv, i, h FROM t WHERE n > 1 UNION ALL SELECT 1, NULL, lv, i, h FROM s WHERE n > 1),
ways AS (SELECT doc_id, 0 AS top, v.r, lv, v.i >> lv AS i FROM v JOIN (SELECT DISTINCT r, lv FROM t WHERE n > 1) x ON x.r = v.r UNION ALL SELECT doc_id, 1, NULL, lv, v.r >> lv FROM v, (SELECT DISTINCT lv FROM s WHERE n > 1) x),
steps AS MATERIALIZED (SELECT w.doc_id, row_number() OVER (PARTITION BY w.doc_id ORDER BY w.top, w.lv) AS k, CASE WHEN o.i < w.i THEN o.h ELSE '' END AS l, CASE WHEN o.i > w.i THEN o.h ELSE '' END AS g
    FROM ways w LEFT JOIN nodes o ON o.top = w.top AND o.r IS NOT DISTINCT FROM w.r AND o.lv = w.lv AND o.i = xor(w.i, 1)),
f(doc_id, k, h) AS (SELECT doc_id, 1, bad FROM v UNION ALL SELECT f.doc_id, f.k + 1, sha256(l || h || g) FROM f JOIN steps s ON s.doc_id = f.doc_id AND s.k = f.k),
ends AS (SELECT doc_id, max_by(h, k) AS folded FROM f GROUP BY doc_id),
proofs AS (SELECT doc_id, sha256(string_agg(l || g, '' ORDER BY k)) AS proof FROM steps GROUP BY doc_id),
root AS (SELECT h FROM s WHERE n = 1)
SELECT v.doc_id, v.leaf, sub.h AS subroot, root.h AS root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = root.h AS verified
FROM v JOIN sub ON sub.r = v.r JOIN root ON true JOIN ends ON ends.doc_id = v.doc_id LEFT JOIN proofs ON proofs.doc_id = v.doc_id
"""


#: Levels are a recursion of their own; each leaf's way is found, then folded once more.
SQL = _sql()

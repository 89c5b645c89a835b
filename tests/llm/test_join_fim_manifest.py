"""Overlap join, fill-in-middle and Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelake.llm import fill_in_middle, inverted, merkle, overlap_join
from citelake.llm.common import Stages
from citelake.llm import queries as llm

SCHEMA = "doc_id long, text string"
LONG = " ".join(f"w{i % 9973}x{i % 7}" for i in range(700_000))  # over 5 MB
# Nulls, empty and very long texts, white space, ties, repeated rows, rows without an id.
EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (4, "word"), (None, "word two three four five six"), (None, None), (None, None), (5, "é " * 3000), (6, LONG), (7, LONG + " end"), (8, "A b\nA b\nc"), (9, "a\n\n<P>\n")]


@pytest.fixture(scope="module")
def edge(spark):
    # Extra columns whose names the operators use themselves.
    return spark.createDataFrame(EDGE, SCHEMA).withColumns({c: F.lit(1) for c in ("key_", "sid", "n", "token", "set", "label", "slice", "group_", "leaf", "part", "output", "form", "tie")})


# ---- 11 overlap join


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    label = list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    for _ in rows:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[label[i]] = min(d, ids.get(label[i], d))
    return Counter((d, len(sets[i]), ids.get(label[i])) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("heap", (0, 256))
@pytest.mark.parametrize("seed", range(20))
def test_divide_skip_counts_lists(monkeypatch, seed, heap):
    monkeypatch.setattr(inverted, "HEAP", heap)
    r = random.Random(seed)
    sets = [np.array(sorted(r.sample(range(60), r.randint(1, 50 if r.random() < 0.3 else 8))), np.uint64) for _ in range(r.randint(2, 30))]
    lists = inverted.Lists(sets, np.arange(len(sets)))
    for q, own in enumerate(sets):
        t = r.randint(1, 6)
        want = {i: len(set(own) & set(s)) for i, s in enumerate(sets) if len(set(own) & set(s)) >= t}
        shared = len([x for x in own if sum(x in s for s in sets) > 1])  # its own lists, without those that it is alone in
        if shared < t:
            want.pop(q, None)
        else:
            want[q] = shared
        assert lists.divide_skip(lists.of(q), t) == {i: n for i, n in want.items() if n >= t}
        found, n = lists.counts(lists.of(q))
        assert {i: c for i, c in zip(found.tolist(), n.tolist(), strict=True) if i != q} == {i: len(set(own) & set(s)) for i, s in enumerate(sets) if i != q and set(own) & set(s)}


@pytest.mark.parametrize("percent", (60, 80, 85))
def test_prefixes_never_rule_out_a_similar_pair(spark, percent):
    r = np.random.default_rng(percent)
    seen, sizes = 0, np.arange(1, 400)
    core = dict(zip(sizes.tolist(), (x[0] for x in spark.range(1, 400).select(inverted.core_size(F.col("id"), percent)).collect()), strict=True))
    assert all(core[n] == n - -(-2 * percent * n // (100 + percent)) + 1 for n in core)
    for _ in range(600):
        n = int(r.integers(1, 60))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        drop = r.random(len(a)) > r.random() * 0.3
        b = np.unique(np.concatenate([a[drop], r.integers(0, 2**63, int(r.integers(0, n // 4 + 1))).astype(np.uint64)]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both):
            continue
        seen += 1
        hot = np.sort((np.concatenate([a, b]) >> np.uint64(8)).astype(np.int64)[r.random(len(a) + len(b)) < 0.3])
        p, q = inverted.prefix(a, percent, hot), inverted.prefix(b, percent, hot)
        common = np.intersect1d(p, q)
        assert len(common) and inverted.may_reach(p, len(a), q, len(b), len(common), percent)
        small, n_small = (p, len(a)) if len(a) <= len(b) else (q, len(b))
        assert np.isin(common, small[: core[n_small]]).any()
        assert both >= inverted.least_overlap(max(len(a), len(b)), percent)
    assert seen > 100


@pytest.mark.parametrize("seed", range(6))
def test_many_prefixes_are_judged_as_one_is(seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, 90).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(90) > 0.5 * r.random()], r.integers(0, 2**63, int(r.integers(1, 40))).astype(np.uint64)])) for _ in range(30)]
    prefixes, size = [inverted.prefix(s, 85) for s in sets], np.array([len(s) for s in sets])
    reach = inverted.Reach(prefixes, size, 85)
    others = np.arange(1, 30)
    both = np.array([len(np.intersect1d(prefixes[0], prefixes[i])) for i in others])
    want = [inverted.may_reach(prefixes[0], len(sets[0]), prefixes[i], len(sets[i]), b, 85) for i, b in zip(others, both, strict=True)]
    assert reach.of(0, others, both).tolist() == want


def test_spare_shingles_take_the_place_of_hot_ones():
    r = np.random.default_rng(5)
    told = 0
    for _ in range(300):
        a = np.unique(r.integers(0, 2**63, int(r.integers(1, 120))).astype(np.uint64))
        hot = np.sort((a >> np.uint64(8)).astype(np.int64)[r.random(len(a)) < 0.4 * r.random()])
        got = inverted.reordered(inverted.prefix(a, 85, spare=inverted.spare_size(len(a), 85)), len(a), 85, hot)
        told += got is not None
        assert got is None or got.tolist() == inverted.prefix(a, 85, hot).tolist()
    assert told > 200


def test_sets_that_many_tasks_left_meet_once(spark):
    # Five tasks left the same three sets (1 with 2, 2 with 3); one task left 8 and 9, which are too large to meet but as they did there.
    rows = [(t, s, 10, s, True, 1 if s < 3 else 2) for t in range(5) for s in (1, 2, 3)] + [(t, 2, 10, 2, True, 2) for t in range(5)] + [(t, s, 100, s, True, 8) for t in (1, 2) for s in (8, 9)]
    left = spark.createDataFrame(rows, "task long, sid long, n long, label long, query boolean, met long")
    got = inverted.families(left, 50, Stages(spark, "families")).collect()
    assert sorted(x.sid for x in got) == [1, 2, 3, 8, 8, 9, 9]
    assert len({x["where"] for x in got if x.sid < 4}) == 1 and len({x["where"] for x in got if x.sid > 3}) == 2


def join_rows(seed=8):
    r = random.Random(seed)
    vocabulary, passage = [f"w{i}" for i in range(150)], [f"p{i}" for i in range(60)]
    rows = []
    for g in range(14):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, 150))]
        for _ in range(r.randint(1, 9)):
            rows.append((len(rows) * 3 % 97 + 100 * len(rows), " ".join(w if r.random() > 0.01 * (g % 4) else r.choice(vocabulary) for w in base)))
    # A passage that many texts share, which makes long lists.
    rows += [(20_000 + i, " ".join(passage + [r.choice(vocabulary) for _ in range(r.randint(1, 14))])) for i in range(40)]
    return rows + [(9000, None), (9001, ""), (9002, " \n"), (9003, "One two"), (9004, "one  TWO"), (9005, "two one"), (None, "One two")]


@pytest.mark.parametrize(("percent", "weight", "hot"), ((85, inverted.WEIGHT, 64), (85, 40, 5), (70, 40, 2)))
def test_overlap_join_against_brute_force(spark, percent, weight, hot):
    rows = join_rows()
    got = overlap_join.similar_sets(spark.createDataFrame(rows, SCHEMA), k=4, percent=percent, weight=weight, hot=hot).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute_components(rows, 4, percent)


def test_overlap_join_edges(spark, edge):
    got = overlap_join.similar_sets(edge, k=4, percent=85).collect()
    assert Counter((x.doc_id, x.component_id) for x in got) == Counter((i, 6 if i == 7 else i) for i, _ in EDGE)
    assert overlap_join.similar_sets(edge.limit(0)).count() == 0


# ---- 12 fill-in-middle


def brute_fim(i, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(units), hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return i, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm_form = h4 % 100 < spm
    return i, n, "spm" if spm_form else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm_form else f"<P>{p}<S>{s}<M>{m}"


def fim_rows():
    r = random.Random(3)
    return EDGE + [(100 + i, "".join(r.choice(["a", "é", "\n", "\r\n", "<", "P>", "S>", "😀", " ", " ", "\x0b"]) for _ in range(r.randint(0, 60)))) for i in range(300)]


@pytest.mark.parametrize(("rate", "spm"), ((100, 50), (40, 0), (100, 100)))
def test_fill_in_middle_against_brute_force(spark, rate, spm):
    rows = fim_rows()
    out = fill_in_middle.fill_in_middle(spark.createDataFrame(rows, SCHEMA), rate=rate, spm_rate=spm)
    got = out.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in got) == Counter(brute_fim(i, t, rate=rate, spm=spm) for i, t in rows)
    assert Counter((x.doc_id, x.back) for x in got) == Counter((i, t or "") for i, t in rows)
    assert len({x.form for x in got}) == (3 if rate == 100 and spm == 50 else 2)


def test_units_of_words():
    p = fill_in_middle.code_points("ab  c\td")
    assert fill_in_middle.boundaries(p, "word").tolist() == [0, 2, 4, 5, 6, 7] and fill_in_middle.boundaries(fill_in_middle.code_points(""), "word").tolist() == [0]


def test_fill_in_middle_edges(spark, edge):
    assert fill_in_middle.fill_in_middle(edge).count() == len(EDGE) and fill_in_middle.fill_in_middle(edge.limit(0)).count() == 0
    with pytest.raises(ValueError, match="unit"):
        fill_in_middle.fill_in_middle(edge, unit="page")


# ---- 13 Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def way(levels, i, arity):
    for level in levels[:-1]:
        s = i // arity * arity
        yield level[s : s + arity], i - s
        i //= arity


def brute_manifest(rows, arity=2):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda row: H(*map(field, row))
    groups = {}
    for row in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, leaf(x))):
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([leaf(x) for x in groups[g]], arity) for g in names}
    top = tree([trees[g][-1][0] for g in names], arity)
    out = []
    for k, g in enumerate(names):
        for i, row in enumerate(groups[g]):
            changed = list(row)
            if zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 7 == 0 and row[3] is not None:
                changed[3] += 1
            proof, fold = "", leaf(changed)
            for run, at in [*way(trees[g], i, arity), *way(top, k, arity)]:
                proof += "".join(run[:at] + run[at + 1 :])
                fold = H(*run[:at], fold, *run[at + 1 :])
            out.append((row[0], leaf(row), trees[g][-1][0], top[-1][0], H(proof), fold, fold == top[-1][0]))
    return Counter(out)


FULL = "doc_id long, source string, lang string, n_chars long, text string"


def tampered():
    return {"n_chars": F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


@pytest.mark.parametrize(("n", "arity", "part_rows", "fan_in"), ((0, 2, 10, 2), (1, 2, 10, 2), (230, 2, 7, 2), (230, 3, 9, 4), (64, 2, 1 << 17, 256)))
def test_manifest_against_brute_force(spark, n, arity, part_rows, fan_in):
    r = random.Random(n + arity)
    langs = ["de", "en", None, "", "zz", "é", "fr"] + [f"l{i}" for i in range(20)]
    rows = [(i * 7 % 1009, r.choice(["a", None]), langs[int(abs(r.gauss(0, 5)))] if r.random() > 0.3 else "en", r.choice([None, i]), r.choice([None, "", "x" * i, "é\n"])) for i in range(n)]
    rows += rows[: n // 10] + [(None, None, None, None, None)] * (n > 2) * 3 + [(None, "s", "en", 4, "t")] * (n > 2)
    got = merkle.manifest(spark.createDataFrame(rows, FULL), tampered=tampered(), arity=arity, part_rows=part_rows, fan_in=fan_in).collect()
    found = Counter((x.doc_id, x.leaf, x.subroot, x.root, x.proof_sha256, x.folded_root, x.verified) for x in got)
    assert found == brute_manifest(rows, arity)
    assert n < 100 or {x.verified for x in got} == {True, False}


def test_forests_add_up_in_any_order():
    r = random.Random(5)
    sizes = {0: 5, 1: 1, 2: 8, merkle.TOP: 3}
    nodes = [((t, 0, i), bytes([t, i]) * 16) for t in (0, 1, 2) for i in range(sizes[t])]
    roots = set()
    for _ in range(30):
        r.shuffle(nodes)
        parts, cut = [], sorted(r.sample(range(len(nodes)), 3))
        for a, b in zip([0, *cut], [*cut, len(nodes)], strict=True):
            forest = merkle.Forest(2, sizes)
            for k, v in nodes[a:b]:
                forest.add(k, v)
            parts.append(forest.open)
        r.shuffle(parts)
        whole = merkle.Forest(2, sizes)
        for part in parts:
            for k, v in part.items():
                whole.add(k, v)
        (key, value), = whole.open.items()
        assert whole.is_root(key)
        roots.add(value)
    assert len(roots) == 1


def test_manifest_edges(spark, edge):
    d = edge.withColumns({"source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    got = merkle.manifest(d, tampered=tampered()).collect()
    assert Counter((x.doc_id, x.leaf, x.subroot, x.root, x.proof_sha256, x.folded_root, x.verified) for x in got) == brute_manifest([(i, None, None, None if t is None else len(t), t) for i, t in EDGE])
    assert merkle.manifest(d.limit(0)).count() == 0
    # Without other values every row is verified.
    assert all(x.verified for x in merkle.manifest(d).collect())


def test_queries_are_registered():
    assert {"op11_overlap_join", "op12_fill_in_middle", "op13_merkle"} <= set(llm.QUERIES) & set(llm.ORACLES)

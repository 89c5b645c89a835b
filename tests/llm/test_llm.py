import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelake.llm import components, decontamination, language_id, minhash, packing, ppm, quality_rules, sharding, suffix_dedup, token_counts, warc
from citelake.llm.common import Stages

SCHEMA = "doc_id long, text string"


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rng_text(r, n, letters="ab "):
    return "".join(r.choice(letters) for _ in range(n))


# Nulls, empty and long texts, white space, ties, repeated rows.
EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (4, "word"), (None, "word two three four five six"), (None, None), (5, "é " * 3000), (6, "x" * 5000), (7, "A b\nA b\nc"), (8, "a b a b a b a b a b a b a b a b a b a b a b a b")]


@pytest.fixture(scope="module")
def edge(spark):
    # Extra columns whose names the operators use themselves.
    return docs(spark, EDGE).withColumns({c: F.lit(1) for c in ("key_", "block", "n", "w", "text_", "shard", "set", "label", "train", "archive")})


# ---- 1 suffix dedup


def brute_lpf(d):
    return [max((k for j in range(i) for k in [next((k for k in range(len(d) - i) if d[i + k] != d[j + k]), len(d) - i)]), default=0) for i in range(len(d))]


@pytest.mark.parametrize("seed", range(8))
def test_longest_previous_factors(seed):
    d = rng_text(random.Random(seed), 60, "ab").encode()
    assert suffix_dedup.longest_previous_factors(d).tolist() == brute_lpf(d)
    assert suffix_dedup.longest_previous_factors(b"").tolist() == []


@pytest.mark.parametrize("seed", range(6))
def test_reaches_agrees_with_the_factors(seed):
    d = rng_text(random.Random(seed), 300, "ab").encode()
    sa = suffix_dedup.suffix_array(d)
    lcp = suffix_dedup.common_prefixes([d[i:] for i in sa.tolist()])
    lpf = suffix_dedup.longest_previous_factors(d)
    for m in (1, 3, 6, 9):
        new = lcp < m
        new[0] = True
        got = np.zeros(len(d), bool)
        got[sa] = suffix_dedup.reaches(sa, new)
        assert (got == (lpf >= m)).all()


def test_anchors_do_not_depend_on_parts(monkeypatch):
    data = rng_text(random.Random(2), 6000, "abcde ").encode()
    whole = suffix_dedup.anchors(data, 80)
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    for a, b in zip(whole, suffix_dedup.anchors(data, 80), strict=True):
        assert a.tolist() == b.tolist()


def brute_dedup(rows, m, first):
    seen, order = Counter(), sorted(range(len(rows)), key=lambda i: (-1 if rows[i][0] is None else rows[i][0],))
    data = [(t or "").encode() for _, t in rows]
    where = defaultdict(list)
    for i in order:
        for k in range(len(data[i]) - m + 1):
            s = data[i][k : k + m]
            seen[s] += 1
            where[s].append((i, k))
    out = []
    for i, d in enumerate(data):
        gone = bytearray(len(d))
        for k in range(len(d) - m + 1):
            s = d[k : k + m]
            if where[s][0] != (i, k) if first else seen[s] > 1:
                gone[k : k + m] = b"\1" * m
        out.append((rows[i][0], len(d), sum(gone), hashlib.sha256(bytes(x for x, g in zip(d, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("first", [False, True])
def test_suffix_dedup_against_brute_force(spark, first):
    r = random.Random(3)
    base = [rng_text(r, n, "abcdefg é") for n in (90, 200, 400)]
    rows = [(i, "".join(r.choice(base)[a : a + r.randint(50, 150)] if r.random() < 0.7 else rng_text(r, 40, "abcdefgh") for a in (r.randint(0, 100) for _ in range(6)))) for i in range(30)]
    rows += [(100, "ab" * 300), (101, None), (102, ""), (103, "z" * 70), (104, "z" * 63)]
    got = suffix_dedup.dedup(docs(spark, rows), 64, first).collect()
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.kept_sha256) for x in got), key=str) == brute_dedup(rows, 64, first)
    for x in got:
        x.kept_text is None or x.kept_text.encode()
    # Anchors with more contexts than a task takes.
    again = suffix_dedup.dedup(docs(spark, rows), 64, first, block_rows=2).collect()
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.kept_sha256) for x in again), key=str) == brute_dedup(rows, 64, first)


def test_repeated_rows_give_each_range_once(spark):
    same = docs(spark, [(1, "abcdefghij" * 9 + "".join(map(chr, range(33, 120))))]).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("x")
    found = suffix_dedup.spans(same, 64).collect()
    assert len(found) == 1 and len(found[0].starts) == len(set(zip(found[0].starts, found[0].ends, strict=True))) < 40
    assert {(x.n_bytes, x.n_removed) for x in suffix_dedup.dedup(same, 64, False).collect()} == {(177, 177)}


def test_suffix_dedup_edges(spark, edge):
    got = suffix_dedup.dedup(edge, 200, False).collect()
    assert len(got) == len(EDGE)
    assert suffix_dedup.dedup(edge.limit(0), 200).count() == 0
    by = {x.doc_id: x for x in got}
    assert by[5].n_removed == 9000 and by[6].n_removed == 5000 and by[4].n_removed == 0


# ---- 2 PPM


def test_ppm_against_trie(spark):
    rows = [(i, t) for i, t in enumerate(["abracadabra", "the cat sat", "the cat", "", None, "été\n", "the hat sat on the cat", "zzz"])] + [(20, "the cat"), (20, "the cat"), (None, "x")]
    train = F.col("doc_id") % 3 != 0
    got = ppm.score(docs(spark, rows), train).collect()
    trie, c = ppm.Trie(), Counter()
    for i, t in rows:
        if i is not None and i % 3:
            trie.train((t or "").encode())
            c.update((t or "").encode().lower().split() + [None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        w = b.lower().split() + [None]
        want[(i, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4), round(trie.score(b), 4))] += 1
    assert Counter((x.doc_id, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 4), round(x.score, 4)) for x in got) == want


def test_ppm_of_long_texts_in_pieces(spark):
    r = random.Random(12)
    text = lambda n: " ".join(rng_text(r, r.randint(1, 9), "abcé") for _ in range(n))
    rows = [(1, text(300)), (2, text(200)), (2, text(5)), (3, "x" * 500), (None, text(100)), (4, text(150)), (4, None)]
    rows += [rows[1]]
    got = ppm.score(docs(spark, rows), F.coalesce(F.col("doc_id") != 1, F.lit(True)), piece_bytes=64).collect()
    trie, c = ppm.Trie(), Counter()
    for i, t in rows:
        if i != 1:
            trie.train((t or "").encode())
            c.update((t or "").encode().lower().split() + [None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        w = (t or "").encode().lower().split() + [None]
        want[(i, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 3), round(trie.score((t or "").encode()), 3))] += 1
    assert Counter((x.doc_id, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 3), round(x.score, 3)) for x in got) == want


def test_pieces_hold_whole_words():
    data = ("word longer " * 20 + "z" * 90).encode()
    found = list(ppm.pieces(data, 30))
    assert b"".join(p for p, _, _ in found) == data and [x for _, _, x in found] == [False] * (len(found) - 1) + [True]
    assert sum((p.split() for p, _, _ in found), []) == data.split() and found[0][1] == b"" and found[1][1] == found[0][0][-6:]
    assert list(ppm.pieces(b"", 30)) == [(b"", b"", True)]


def test_ppm_is_a_distribution():
    t = ppm.Trie(2)
    t.train(b"abcabd")
    for context in [(97, 98), (98, 99), (1, 2), (257, 257)]:
        assert math.isclose(sum(10 ** t.cost(context, s) for s in range(ppm.SYMBOLS)), 1, rel_tol=1e-9)
    adaptive = ppm.Trie(2)
    assert adaptive.score(b"abababababab", adaptive=True) > ppm.Trie(2).score(b"abababababab")


def test_ppm_edges(spark, edge):
    assert ppm.score(edge, F.lit(False)).count() == len(EDGE)
    assert ppm.score(edge.limit(0), F.lit(True)).count() == 0


# ---- 3 token counts


@pytest.fixture(scope="module")
def vocabulary():
    p = pytest.importorskip("public_tokenizers")
    return p.path("byte_bpe_50k.json")


def test_token_counts(spark, edge, vocabulary, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    cache = str(tmp_path / "cache")
    got = token_counts.count_tokens(edge, vocabulary, cache).collect()
    want = Counter((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in EDGE)
    assert Counter((x.doc_id, x.n_bytes, x.n_tokens) for x in got) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({x or "" for _, x in EDGE})  # one for each different text
    token_counts.count_tokens(edge.union(edge.limit(3)), vocabulary, cache).count()
    assert spark.read.parquet(cache).count() == stored  # all found again
    assert token_counts.count_tokens(edge.limit(0), vocabulary, cache).count() == 0


def test_other_tokenizers_count_whole_texts(spark, tmp_path):
    p = pytest.importorskip("public_tokenizers")
    import pathlib

    for path in [x for x in sorted(pathlib.Path(p.path("byte_bpe_50k.json")).parent.iterdir()) if x.suffix in (".json", ".model")]:
        c = token_counts.PieceCounter(str(path))
        for text in ["", "one  two three", " x é\n日本", "a b"]:
            assert c.count(text) == c.library([text])[0], path


def test_pieces_count_as_the_library(vocabulary):
    c, r = token_counts.PieceCounter(vocabulary), random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\xa0", "　", "\x1c", "\x85", "'s", "the", "<|endoftext|>", "12", "é", "日本", "!!", "😀"]
    for _ in range(500):
        s = "".join(r.choices(parts, k=r.randint(0, 14)))
        assert c.count(s) == len(c.tokenizer.encode(s, add_special_tokens=False).ids), s


# ---- 4 sharding


def test_sharding(spark):
    r = random.Random(2)
    rows = [(i, rng_text(r, r.randint(0, 400))) for i in range(1500)] + [(2000 + i, "the same text") for i in range(700)] + [(None, None), (None, "")]
    got = sharding.shard(docs(spark, rows), 10).collect()
    assert len(got) == len(rows)
    sizes, slots, places = Counter(), defaultdict(list), defaultdict(set)
    text = {i: t for i, t in rows if i is not None}
    for x in got:
        sizes[x.shard] += x["size"]
        slots[x.shard].append(x.slot)
        if x.doc_id is not None:
            assert x["size"] == len(text[x.doc_id].encode()) + 16 and x.text_crc32 == zlib.crc32(text[x.doc_id].encode())
            places[text[x.doc_id]].add(x.shard)
    assert max(sizes.values()) - min(sizes.values()) < 450
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(p) == 1 for t, p in places.items() if t != "the same text" and t != "")


def test_placing_against_brute_force(monkeypatch):
    r = np.random.default_rng(4)
    items = np.column_stack([r.lognormal(0, 1, 200), r.lognormal(0, 1, 200), r.integers(1, 3, 200)])
    items /= items.sum(axis=0)
    capacity = np.full((7, 3), 1 / 7)
    monkeypatch.setattr(sharding, "EXCHANGES", 0)
    got, left = sharding.place(items, capacity), capacity.tolist()
    for i in sorted(range(200), key=lambda i: (-max(items[i]), i)):
        dots = [sum(w * x * c for w, x, c in zip(sharding.WEIGHTS, items[i], row, strict=True)) for row in left]
        assert dots[got[i]] == pytest.approx(max(dots))
        left[got[i]] = [c - x for c, x in zip(left[got[i]], items[i], strict=True)]
    monkeypatch.setattr(sharding, "EXCHANGES", 8)
    again = sharding.place(items, capacity)
    sums = lambda out: np.array([items[out == k].sum(axis=0) for k in range(7)])
    assert np.ptp(sums(again)[:, 0]) < 0.3 * np.ptp(sums(got)[:, 0]) and (abs(sums(again)[:, 2] - sums(got)[:, 2]) < 1e-9).all()
    assert sharding.place(np.zeros((0, 3)), capacity).tolist() == []


def test_measures_are_balanced_jointly(spark):
    r = random.Random(5)
    rows = [(i, " ".join("x" * r.choice([1, 2, 9, 30]) for _ in range(int(r.lognormvariate(4, 1))))) for i in range(4000)]
    tokens, got = {i: len(t.split()) for i, t in rows}, sharding.shard(docs(spark, rows), 20).collect()
    total = np.zeros((20, 3))
    for x in got:
        total[x.shard] += x["size"], tokens[x.doc_id], 1
    spread = np.ptp(total, axis=0) / total.mean(axis=0)
    assert spread[0] < 0.01 and spread[1] < 0.05 and spread[2] < 0.05


def test_sharding_edges(spark, edge):
    got = sharding.shard(edge).collect()
    assert Counter((x.doc_id, x["size"], x.text_crc32) for x in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in EDGE)
    slots = defaultdict(list)
    for x in got:
        slots[x.shard].append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len({x.shard for x in got if x.doc_id == 4}) == 1
    assert sharding.shard(edge.limit(0)).count() == 0


# ---- 5 WARC


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u\r\nX: y", None), (4, "u", ""), (5, "u", "z" * 100_000), (None, "u", "<p>é</p>"), (6, "u", "b"), (6, "u", "b")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit(1)).withColumn("payload", F.lit(1))
    folder = f"file://{tmp_path}/warc"
    warc.write_warc(p, folder)
    got = warc.read_warc(spark, folder).collect()
    assert len(got) == len(rows)
    by = {x.page_id: x for x in got}
    assert by[2].record_type == "revisit" and by[2].refers_to == 1 and by[2].payload is None and by[2].payload_bytes == len("<p>é</p>".encode())
    assert by[1].record_type == "response" and bytes(by[1].payload).decode() == "<p>é</p>"
    assert by[4].refers_to == 3 and bytes(by[5].payload) == b"z" * 100_000 and by[None].record_type == "revisit" and by[None].refers_to == 1 and by[6].record_type == "response"
    assert all(x.payload_digest == warc.digest((h or "").encode()) for (i, _, h) in rows for x in got if x.page_id == i)


def test_warc_query_edges(spark, tmp_path):
    schema = "page_id long, url string, html string"
    for n, rows in enumerate([[], [(1, "u", "same"), (None, "u", "same"), (2, "u", "same"), (None, "u", "own"), (None, "u", "own")]]):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{n}/pages.parquet")
        got = sorted(((x.page_id, x.record_type, x.refers_to) for x in warc.op5_warc(spark, f"{tmp_path}/{n}").collect()), key=str)
        assert got == [[], sorted([(1, "response", None), (None, "revisit", 1), (2, "revisit", 1), (None, "response", None), (None, "response", None)], key=str)][n]


def test_warc_archive_has_a_dictionary_frame():
    records = [warc.record(i, "u", (f"<html><body>common words of every page {i}" * 20).encode(), None) for i in range(400)]
    data = warc.write_archive(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18" and int.from_bytes(data[4:8], "little") > 1000
    assert [b for _, b in warc.read_archive(data)] == [r.partition(b"\r\n\r\n")[2][:-4] for r in records]


# ---- 6 language


def test_automaton_phrases_against_brute_force():
    r = random.Random(5)
    model = rng_text(r, 300, "abc ")
    a = language_id.SuffixAutomaton(model)
    for _ in range(50):
        t, n, i = rng_text(r, 40, "abcd "), 0, 0
        while i < len(t):
            k = 1
            while i + k < len(t) and t[i : i + k + 1] in model:
                k += 1
            i, n = i + (k if t[i] in model else 1), n + 1
        assert a.phrases(t) == n
        assert language_id.parse([t], [language_id.Table(a)]).tolist() == [[n]]


def test_whole_texts_are_parsed_as_one(monkeypatch):
    r = random.Random(15)
    models = [language_id.SuffixAutomaton(rng_text(r, n, letters)) for n, letters in ((600, "abc "), (900, "ab "), (50, "xyz"), (5000, "a"))]
    texts = [rng_text(r, n, "abcd ") for n in (5000, 1, 511, 512, 513, 1200, 40)] + ["a" * 3000, "q" * 2000, rng_text(r, 700, "xa"), ""]
    want = [[m.phrases(t) for m in models] for t in texts]
    tables = [language_id.Table(m) for m in models]
    assert language_id.parse(texts, tables).tolist() == want
    monkeypatch.setattr(language_id, "STEP_ROWS", 3)  # texts that go on in further steps
    monkeypatch.setattr(language_id, "PIECE", 64)
    assert language_id.parse(texts, tables).tolist() == want


def test_languages(spark, edge):
    r = random.Random(6)
    make = lambda parts: " ".join("".join(r.choices(parts, k=3)) for _ in range(60))
    rows = [(i, make(["the", "ing", "er"]), "en") for i in range(40)] + [(100 + i, make(["und", "sch", "keit"]), "de") for i in range(20)] + [(200, "!!! 123", "de"), (201, None, "en"), (202, "x y", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    got = {x.doc_id: x for x in language_id.identify(d, d.filter("doc_id % 2 = 0")).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:60])
    assert got[200].lang_pred == got[201].lang_pred == "und" and all(0 <= x.score <= 1 for x in got.values())
    assert {x.lang_pred for x in language_id.identify(edge, d.limit(0)).collect()} == {"und"}
    assert language_id.identify(edge.limit(0), d).count() == 0


def test_every_language_is_learned(spark):
    own = lambda k: chr(0x4E00 + 2 * k) + chr(0x4E01 + 2 * k)
    rows = [(10 * k + i, own(k) * 8, f"l{k:02d}") for k in range(70) for i in range(2 if k < 64 else 1)]
    # Copies of one row, which a rule by the row's hash takes all or none of.
    rows += [(1000, own(80) * 8, "copies")] * 999
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x.lang_pred for x in language_id.identify(d.distinct(), d).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_the_size_of_a_table_follows_the_text_and_not_its_alphabet():
    r = random.Random(16)
    for letters in range(0x4E00, 0x4E00 + 3000), range(0xAC00, 0xAC00 + 2000), range(0x3041, 0x3097), range(97, 123):
        text = "".join(chr(letters[min(int(r.paretovariate(0.5)) - 1, len(letters) - 1)]) for _ in range(language_id.MODEL_CHARS))
        a = language_id.SuffixAutomaton(text)
        table = language_id.Table(a)
        assert table.bytes < 4_000_000  # 64 languages: under 256 MB
        for s in r.sample(range(len(a.next)), 200):
            for c, code in ((c, i + 1) for i, c in enumerate(map(chr, table.chars[:: max(1, len(table.chars) // 40)]))):
                code = int(np.searchsorted(table.chars, ord(c))) + 1
                place = table.base[s] + code
                assert (table.target[place] if table.owner[place] == s else 0) == a.next[s].get(c, 0)


def test_predictions_against_brute_force(spark):
    r = random.Random(17)
    letters = {"aa": "abcde ", "bb": "abcfg ", "cc": "abcde ", "dd": "xyz "}
    rows = [(i, rng_text(r, r.randrange(1, 60), letters[lang]), lang) for i in range(60) for lang in [r.choice(list(letters))]] + [(100, "q", None), (101, "", "aa"), (102, None, None), (103, "7 !", "bb"), (104, "ÀÉ x", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = language_id.sample(d.filter("doc_id < 40"))
    assert set(texts) == set(letters)

    def phrases(t, model):
        n, i = 0, 0
        while i < len(t):
            k = 1
            while i + k < len(t) and t[i : i + k + 1] in model:
                k += 1
            i, n = i + k, n + 1
        return n

    want = {}
    for i, text, _ in rows:
        t = language_id.normalise(text or "")
        inverse = {lang: 1 / phrases(t, texts[lang]) for lang in sorted(texts)} if t else {"und": 0.0}
        best = max(inverse, key=lambda x: (inverse[x], [-ord(c) for c in x]))  # ties: the first in alphabetical order
        want[i] = (best, round(inverse[best] / (sum(inverse.values()) or 1), 12))
    got = {x.doc_id: (x.lang_pred, round(x.score, 12)) for x in language_id.identify(d, d.filter("doc_id < 40")).collect()}
    assert got == want


def test_copies_crowd_out_no_document(spark):
    rows = [(1, "ab " * 9, "x")] * 3000 + [(i, f"{chr(97 + i % 20)}{chr(98 + i % 7)} " * 50, "x") for i in range(2, 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.sample(d) == language_id.sample(d.distinct())


# ---- 7 quality rules


def test_quality_edges(spark, edge):
    got = quality_rules.quality(edge).collect()
    assert len(got) == len(EDGE)
    by = {x.doc_id: x for x in got}
    assert by[1].n_words == by[3].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[7].n_dup_lines == 1 and by[8].n_words == 24 and by[8].n_repeat_words == 24 and by[8].base_failed
    assert quality_rules.quality(edge.limit(0)).count() == 0


def test_passing_agrees_with_the_verdict(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(["word", "other", "#", "THING", "a", "b\nb", "long" * 9]) + str(r.randint(0, 9 if i % 2 else 999)) for _ in range(r.randint(5, 80)))) for i in range(200)]
    d = docs(spark, rows).withColumn("windows_", F.lit(0))
    assert sorted(x.doc_id for x in quality_rules.passing(d).collect()) == sorted(x.doc_id for x in quality_rules.quality(d).filter("kept").collect())
    for rule, cost, rejected in quality_rules.estimate(d):
        assert cost > 0 and 0 <= rejected <= 1


# ---- 8 decontamination


def test_decontamination(spark, edge):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    near = item.replace("twenty", "twentieth")
    far = " ".join(w if i % 4 else "other" for i, w in enumerate(item.split()))
    bench = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, "")], "item_id long, text string")
    rows = [(1, f"before {item.upper()} after"), (2, f"x y {near} z"), (3, far), (4, "a short  one b"), (5, None), (6, ""), (7, item), (7, item)]
    got = {(x.doc_id, x.item_id): x for x in decontamination.matches(docs(spark, rows).withColumn("start", F.lit(1)), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 2), (7, 1)}
    assert got[1, 1].start == 1 and got[1, 1].similarity == 1 and got[1, 1].distance == 0 and 0.75 < got[2, 1].similarity < 1
    assert decontamination.matches(edge, bench.limit(0)).count() == 0 and decontamination.matches(edge.limit(0), bench).count() == 0


def test_decontamination_of_texts_shorter_than_the_item(spark):
    w = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(w)), (2, "a b c")], "item_id long, text string")
    rows = [(1, " ".join(w[:38])), (2, " ".join(w[:-1])), (3, " ".join(w[2:])), (4, " ".join(w[:15])), (5, " ".join(w[:4])), (6, "a b")]
    got = {(x.doc_id, x.item_id): (x.start, x.similarity) for x in decontamination.matches(docs(spark, rows), bench).collect()}
    assert got == {(1, 1): (0, 34 / 36), (2, 1): (0, 35 / 36), (3, 1): (0, 34 / 36)}


def test_decontamination_against_brute_force(spark):
    r = random.Random(8)
    shingles = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))
    # Items with repeated words too; copies with parts in another order, words changed, put in and left out, within other words; texts of items' words at random.
    items = {i: r.choices([f"w{i}x{k}" for k in range(9 if i % 4 == 0 else 500)], k=n) for i, n in enumerate([60, 60, 50, 40, 30, 20, 12, 6, 5, 4, 3])}
    # Items that share half of their words with others.
    items |= {20 + i: items[0][:20] + [f"v{i}x{k}" for k in range(18 + i)] for i in range(4)}
    noise = lambda n: r.choices("abcdefgh", k=n)
    texts = []
    for i, w in items.items():
        h = len(w) // 2
        texts += [w[h:] + w[:h], noise(7) + w[h:] + w[:h] + noise(90), w[-5:] + w[:-5], w + noise(3) + w[h:] + w[:h], w[: -(len(w) // 8) - 1], w[1:], noise(2) + w[2:], r.sample(w, len(w)), noise(50)]
        for _ in range(4):
            c = list(w)
            for _ in range(r.randint(1, 3)):
                k = r.randrange(len(c))
                c[k : k + r.randint(0, 2)] = noise(r.randint(0, 2))
            texts.append(noise(r.randint(0, 20)) + c + noise(r.randint(0, 20)))
    texts += [items[0][30:] + items[1][:30] + items[0][:30] + items[1][30:], items[7] * 30]
    want = {}
    for d, t in enumerate(texts):
        for i, w in items.items():
            k, best = min(5, len(w)), (0, 0)
            x = shingles(w, k)
            for s in range(max(1, len(t) - len(w) + 1)):
                y = shingles(t[s : s + len(w)], k)
                both = (x & y).total()
                best = max(best, (both / (x.total() + y.total() - both), -s))
            if best[0] >= 0.8:
                want[d, i] = (-best[1], best[0])
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.start, x.similarity) for x in decontamination.matches(docs(spark, [(d, " ".join(t)) for d, t in enumerate(texts)]), bench).collect()}
    assert got == want and {(0, 0), (1, 0), (13, 1)} <= set(got) and len(want) > 40


def test_bit_blocks_cover_the_fingerprint(spark):
    row = spark.createDataFrame([(-1,)], "x long").select(*decontamination.bit_blocks(F.col("x"))).first()
    assert len(row) == decontamination.RADIUS + 1 and sum(bin(v).count("1") for v in row) == 64


# ---- 9 packing


def test_packing_finds_the_tightest_compatible_bin(spark):
    r = random.Random(9)
    rows = [(i, " ".join(f"w{i}" for _ in range(r.randint(0, 60))), f"s{r.randint(0, 5)}" if i % 7 else None) for i in range(150)] + [(500, "same text", "a"), (501, "Same  text", "b"), (502, "w " * 130, "c"), (503, None, None), (None, "x", "d")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(d, 50).collect()
    info = {i: ((t or "").split(), s) for i, t, s in rows}
    bins = defaultdict(list)
    for x in got:
        bins[x.bin].append(x)
    for inside in bins.values():
        assert sum(x.n_tokens for x in inside) <= 50
        src = [info[x.doc_id][1] for x in inside if info[x.doc_id][1] is not None]
        assert len(src) == len(set(src)) and not {500, 501} <= {x.doc_id for x in inside}
        at = 0
        for x in sorted(inside, key=lambda x: (x.offset, x.n_tokens)):
            assert x.offset == at
            at += x.n_tokens
    for i, (w, _) in info.items():
        assert sum(x.n_tokens for x in got if x.doc_id == i) == len(w)
    # The same by a search over all bins.
    open_ = []
    items = sorted((x for x in got if x.n_tokens < 50), key=lambda x: (-x.n_tokens, x.doc_id is None, x.doc_id or 0))
    b = packing.Bins(50)
    for x in items:
        words, source = info[x.doc_id]
        cluster = " ".join(words).lower()
        fit = [(left, k) for k, (left, s, c) in enumerate(open_) if left >= max(1, x.n_tokens) and source not in s and cluster not in c]
        k, _ = b.put(x.n_tokens, b.bit("source", source), b.bit("cluster", cluster))
        if fit:
            left, want = min(fit)
            assert k == want
            open_[k] = (left - x.n_tokens, open_[k][1] | ({source} - {None}), open_[k][2] | {cluster})
        else:
            assert k == len(open_)
            open_.append((50 - x.n_tokens, {source} - {None}, {cluster}))


def test_packing_deals_equal_rows_to_different_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_DOCS", 50)
    same = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two").alias("text"), F.lit(None).cast("string").alias("source"))
    got = packing.pack(same).collect()
    assert len(got) == 400 and len({x.bin.split("-")[0] for x in got}) > 4 and max(Counter(x.bin.split("-")[0] for x in got).values()) < 120


def test_packing_edges(spark, edge):
    assert packing.pack(edge.withColumn("source", F.lit(None).cast("string"))).filter("piece = 0").count() == len(EDGE)
    assert packing.pack(edge.withColumn("source", F.lit("s")).limit(0)).count() == 0


# ---- 10 MinHash


def test_components(spark):
    r = random.Random(4)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long"), Stages(spark, "t")).collect())
    group = {x: x for ab in links for x in ab}
    for _ in group:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: group[x] for x in touched}


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(200)]
    rows = []
    for g in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, 120))]
        for _ in range(r.randint(1, 9)):
            rows.append((len(rows) * 3 % 97 + 100 * len(rows), " ".join(w if r.random() > 0.02 * (g % 3) else r.choice(vocabulary) for w in base)))
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "One two"), (9004, "one  TWO"), (9005, "two one")]
    got = {x.doc_id: x for x in minhash.near_duplicates(docs(spark, rows), k=4).collect()}
    # Bands over the block size.
    assert {i: x.component_id for i, x in got.items()} == {x.doc_id: x.component_id for x in minhash.near_duplicates(docs(spark, rows), k=4, block=2).collect()}

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets, label = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert {i: (x.n_shingles, x.component_id, x.kept) for i, x in got.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_near_duplicates_edges(spark, edge):
    got = minhash.near_duplicates(edge).collect()
    assert len(got) == len(EDGE) and all(x.kept for x in got)
    assert minhash.near_duplicates(edge.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:900], r.integers(0, 2**63, 100).astype(np.uint64)]))
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - j) < 0.12


# ---- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    clean = [(i, text(120)) for i in range(20)]
    passage, leak = text(60), text(30)
    rows = clean + [(100, clean[0][1]), (101, clean[1][1] + " end"), (102, text(60) + " " + passage + " " + text(60)), (103, text(60) + " " + passage + " " + text(60)), (104, text(80) + " " + leak + " " + text(20)), (105, "### !!! $$$ " * 20), (106, None)]
    d = spark.createDataFrame([(i, t, "en", f"src{i % 5}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, stage = d, {}
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        stage[k] = kept
        if k < 4:
            assert kept.columns == d.columns
    ids = [{x.doc_id for x in stage[k].collect()} for k in range(5)]
    assert ids[0] == {i for i, _ in rows} - {105, 106} and ids[1] == ids[0] - {100, 101} and ids[2] == ids[1] and ids[3] == ids[2] - {104} and ids[4] == ids[3]
    texts = {x.doc_id: x.text for x in stage[2].collect()}
    assert passage in texts[102] and passage not in texts[103] and all(texts[i] == t for i, t in clean)
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids[4]


def test_pipeline_of_edge_rows_and_empty_tables(spark, edge, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    r = random.Random(13)
    long = " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(300))
    rows = [(i, t, None, None, None) for i, t in EDGE] + [(None, long, None, None, None), (None, long, None, None, None), (9, long, "en", "s", 1), (9, long, "en", "s", 1)]
    for name, own in (("edge", rows), ("empty", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(own, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, None), (2, "")] if own else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert {x.doc_id for x in got} == ({9} if own else set())

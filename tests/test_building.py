"""Imports in order, tables by version, the error boundary and the index build."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citelake.operators import boundary, build, encode, importing
from citelake.operators import groups as grouping
from citelake.operators.groups import grouped_by, groups
from citelake.plans import building
from citelake.sources.versions import Conflict, Store

REG = "doc_id long, content_hash string, status string, title string, source_url string, publisher string, raw_path string"
LINES = "line_number long, content_hash string, title string, source_url string, publisher string, raw_path string"
PARSED = "content_hash string, parsed boolean, indexed boolean, parents int, children int, error string"


def run_import(spark, registry, lines, parsed):
    out, after = importing.import_batch(spark.createDataFrame(lines, LINES), spark.createDataFrame(registry, REG), spark.createDataFrame(parsed, PARSED), F.col("line_number") + 1000, ("source_url", "publisher"))
    return {x.line_number: x for x in sorted(out.collect(), key=lambda x: x.line_number)}, {x.doc_id: x for x in after.collect()}


def test_groups(spark):
    r = random.Random(4)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)] + [(5, 5), (70, 70)]
    r.shuffle(links)
    got = dict(groups(spark.createDataFrame(links, "a long, b long")).collect())
    want = {x: x for ab in links for x in ab}
    for _ in want:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_only_what_joins_goes_through_rounds(spark, monkeypatch):
    r, asked = random.Random(6), []
    # Up to 300 nodes with one b or none, some with several; a and b don't meet.
    links = [(a, 1000 + r.randrange(80) if r.random() > 0.1 else None, r.random() > 0.8) for a in range(300)] + [(r.randrange(300), 1000 + r.randrange(80), False) for _ in range(40)] + [(301, None, True), (301, None, False)]
    monkeypatch.setattr(grouping, "groups", lambda e: asked.append(e.count()) or groups(e))
    got = {x.node: (x.group, x.new) for x in grouped_by(spark.createDataFrame(links, "a long, b long, new boolean")).collect()}
    want = {x: x for a, b, _ in links for x in (a, b) if x is not None}
    for _ in want:
        for a, b, _ in links:
            if b is not None:
                want[a] = want[b] = min(want[a], want[b])
    key = lambda of: {frozenset(a for a in got if of(a) == g) for g in map(of, got)}
    assert key(lambda a: got[a][0]) == key(want.get) and {a: n for a, (_, n) in got.items()} == {a: any(n for x, _, n in links if x == a) for a in got}
    assert len(asked) == 1 and asked[0] <= 80
    assert grouped_by(spark.createDataFrame([(1, 1001, True), (2, 1001, False), (3, None, True)], "a long, b long, new boolean")).count() == 3 and len(asked) == 1


def test_import_rules(spark):
    fine = lambda h: (h, True, True, 1, 2, None)
    # A title that changes retires nobody, and the path stays.
    out, after = run_import(spark, [(1, "a", "indexed", "t", "u", "p", "/1"), (2, "b", "indexed", "t", "u", "p", "/2")], [(1, "a", "new", "u", "p", "/elsewhere")], [fine("a")])
    assert out[1].action == "UPDATE_META" and {i: (x.status, x.raw_path, x.title) for i, x in after.items()} == {1: ("indexed", "/1", "new"), 2: ("indexed", "/2", "t")}
    # A copy of a row that failed is tried again, under the same id; one of a row that went well is skipped, or changes its metadata.
    out, after = run_import(spark, [], [(1, "x", "t", "u", "p", "/1"), (2, "x", "t", "u", "p", "/2")], [("x", True, False, 0, 0, "RuntimeError: no")])
    assert [(x.action, x.doc_id, x.status, x.ok, x.detail) for x in out.values()] == [(None, 1001, "failed", False, "RuntimeError: no")] * 2 and len(after) == 1
    out, after = run_import(spark, [], [(1, "x", "t", "u", "p", "/1"), (2, "x", "t", "u", "p", "/2"), (3, "x", "other", "u", "p", "/3")], [fine("x")])
    assert [(x.action, x.doc_id) for x in out.values()] == [("NEW", 1001), ("SKIP", 1001), ("UPDATE_META", 1001)] and after[1001].title == "other" and after[1001].raw_path == "/1" and after[1001].indexed_by == 1
    # Two contents of a URL take turns.
    out, after = run_import(spark, [], [(i, h, "t", "u", "p", "/") for i, h in enumerate("abab", 1)], [fine("a"), fine("b")])
    assert [x.action for x in out.values()] == ["NEW", "SUPERSEDE_AND_NEW", "REINDEX", "REINDEX"] and {i: x.status for i, x in after.items()} == {1001: "superseded", 1002: "indexed"}
    # No hash: an outcome and nothing else. A parser that broke leaves its record begun.
    out, after = run_import(spark, [(1, None, "indexed", "t", "u", "p", "/1")], [(1, None, "t", "u", "p", "/"), (2, "c", "t", "u", "p", "/"), (3, "d", "t", "u", "p", "/")], [("c", False, False, 0, 0, "ValueError: bad"), fine("d")])
    assert [(x.action, x.status, x.ok) for x in out.values()] == [(None, "failed", False), (None, "pending", False), ("SUPERSEDE_AND_NEW", "indexed", True)]
    assert {i: x.status for i, x in after.items()} == {1: "superseded", 1002: "pending", 1003: "indexed"}
    assert run_import(spark, [], [], []) == ({}, {})


def sequential(registry, lines, parsed):
    """The same one line after the other, by scans over the whole registry."""
    recs = [dict(zip(REG.replace(" string", "").replace(" long", "").split(", "), r, strict=True)) for r in registry]
    fate, out = {p[0]: p for p in parsed}, {}
    for n, h, title, url, pub, path in sorted(lines, key=lambda x: x[0]):
        if h is None:
            out[n] = (None, None, "failed", False)
            continue
        same = sorted((r for r in recs if r["content_hash"] == h), key=lambda r: r["doc_id"])
        lost = url is None or pub is None
        meta = {"title": title, "source_url": url, "publisher": pub}
        if same and same[0]["status"] == "indexed":
            r = same[0]
            if all(r[k] == v for k, v in meta.items()):
                out[n] = ("SKIP", r["doc_id"], "indexed", True)
                continue
            r.update(meta)
            if lost:
                r["status"] = "pending"
            out[n] = ("UPDATE_META", r["doc_id"], r["status"], True)
            continue
        if same:
            r, action = same[0], "REINDEX"
            r.update(meta)
        else:
            action = "SUPERSEDE_AND_NEW" if url is not None and any(x["status"] == "indexed" and x["source_url"] == url for x in recs) else "NEW"
            recs.append(r := {"doc_id": n + 1000, "content_hash": h, "raw_path": path, **meta})
        _, ok, indexed, _, _, error = fate.get(h, (h, False, False, 0, 0, None))
        if lost:
            r["status"] = "pending"
        elif not ok:
            r["status"] = "pending" if error else "needs_manual"
            action = None if error else action
        elif not indexed:
            r["status"], action = "failed", None
        else:
            r["status"] = "indexed"
            for x in recs:
                if x is not r and x["status"] == "indexed" and x["source_url"] == url:
                    x["status"] = "superseded"
        out[n] = (action, r["doc_id"], r["status"], r["status"] == "indexed" or lost)
    return out, {r["doc_id"]: (r["content_hash"], r["status"], r["title"], r["source_url"], r["publisher"], r["raw_path"]) for r in recs}


@pytest.mark.parametrize("seed", range(3))
def test_import_as_one_line_after_the_other(spark, seed):
    r = random.Random(seed)
    pick = lambda x, n, none=0.1: None if r.random() < none else f"{x}{r.randint(0, n)}"
    registry = [(i, f"h{i}" if r.random() > 0.1 else None, r.choice(["indexed", "indexed", "pending", "superseded"]), pick("t", 1), pick("u", 25), pick("p", 1), f"/{i}") for i in range(40)]
    lines = [(n, pick("h", 70, 0.03), pick("t", 1), pick("u", 25), pick("p", 1, 0.15), f"/n{n}") for n in range(300)]
    parsed = [(f"h{i}", i % 5 > 0, i % 7 > 0, 1, 1, "ValueError: x" if i % 10 == 0 or i % 7 == 0 and i % 5 else None) for i in range(60)]
    out, after = run_import(spark, registry, lines, parsed)
    want, records = sequential(registry, lines, parsed)
    assert {n: (x.action, x.doc_id, x.status, x.ok) for n, x in out.items()} == want
    assert {i: (x.content_hash, x.status, x.title, x.source_url, x.publisher, x.raw_path) for i, x in after.items()} == records


# ---- versions


TABLES = {"a": ("id long, v string", "id"), "b": ("id long, w array<double>", "id")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions_change_all_tables_at_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", TABLES, 4)
    assert store.current() == 0 and store.read("a").count() == 0
    first = spark.createDataFrame([(i, f"v{i}") for i in range(20)], TABLES["a"][0])
    assert store.commit(store.stage({"a": (first, None), "b": (spark.createDataFrame([(1, [1.0])], TABLES["b"][0]), None)})) == 1
    held = store.read("a", 1)
    # A key's rows are replaced, also by fewer; keys go; the rest stays.
    new = spark.createDataFrame([(3, "x"), (3, "y"), (50, "z")], TABLES["a"][0])
    gone = spark.createDataFrame([(4,), (50,), (99,)], "id long")
    assert store.commit(store.stage({"a": (new, gone)})) == 2
    assert rows(store.read("a")) == sorted([(i, f"v{i}") for i in range(20) if i not in (3, 4)] + [(3, "x"), (3, "y"), (50, "z")], key=str)
    assert rows(held) == rows(first) and rows(store.read("b")) == [(1, [1.0])]
    assert rows(store.lookup("a", spark.createDataFrame([(3,), (77,)], "id long"))) == [(3, "x"), (3, "y")]
    assert store.vacuum(1) >= 0 and rows(store.read("b")) == [(1, [1.0])] and store.read("a").count() == 21


def test_a_write_that_dies_changes_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", TABLES, 4)
    store.commit(store.stage({"a": (spark.createDataFrame([(1, "old")], TABLES["a"][0]), None), "b": (spark.createDataFrame([(1, [0.5])], TABLES["b"][0]), None)}))
    a = spark.createDataFrame([(1, "new")], TABLES["a"][0])
    broken = spark.createDataFrame([(1, [1.0])], TABLES["b"][0]).withColumn("w", F.when(F.raise_error(F.lit("killed")).isNull(), F.col("w")))
    with pytest.raises(Exception, match="killed"):  # between the two tables
        store.stage({"a": (a, None), "b": (broken, None)})
    staged = store.stage({"a": (a, None)})  # whole, but never committed
    assert store.current() == 1 and rows(store.read("a")) == [(1, "old")] and rows(store.read("b")) == [(1, [0.5])]
    assert store.vacuum() == 2  # what both left behind
    other = store.stage({"b": (spark.createDataFrame([(2, [2.0])], TABLES["b"][0]), None)})
    store.commit(other)
    with pytest.raises(Conflict):
        store.commit(staged)
    assert rows(store.read("a")) == [(1, "old")] and store.read("b").count() == 2


# ---- the error boundary


def test_errors_stay_with_their_rows(spark):
    d = spark.createDataFrame([(i, "bad" if i % 7 == 0 else f"t{i}") for i in range(50)] + [(None, None)], "id long, text string")

    def call(part):
        texts = part.column("text").to_pylist()
        if "bad" in texts:
            raise KeyError("bad text")
        return [[None if t is None else len(t) for t in texts]]

    got = boundary.guarded(d, call, {"n": "long"}, batch=16).collect()
    assert Counter((x.id, x.n, x.error) for x in got) == Counter([(i, None, "KeyError: 'bad text'") if i % 7 == 0 else (i, len(f"t{i}"), None) for i in range(50)] + [(None, None, None)])
    short = boundary.guarded(d, lambda p: [[1]] if p.num_rows == 1 else [[]], {"n": "long"}).collect()
    assert all(x.n == 1 and x.error is None for x in short)  # too few values for a batch, not for a row
    never = boundary.guarded(d, lambda p: [[]], {"n": "long"}).collect()
    assert all(x.error == "ValueError: 1 rows, but 0 values" for x in never)
    with pytest.raises(ValueError, match="column"):
        boundary.guarded(d.withColumn("error", F.lit(1)), call, {"n": "long"})
    assert boundary.guarded(d.limit(0), call, {"n": "long"}).count() == 0


# ---- the index build


def pages():
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    html = lambda i: f"<h1>P {i}</h1>" + "".join(f"<p>{words(i + k, 25)}</p>" for k in range(i % 12 + 1))
    out = [(i, f"https://a.com/{i // 2}", html(i)) for i in range(1, 60)]
    out[29] = (30, "https://a.com/15", out[28][2])  # equal contents
    return [*out, (61, "https://a.com/61", None), (62, "https://a.com/62", "no blocks"), (63, None, "<p>x</p>")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame(pages(), "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    target, one, two = building.build_index(spark, folder)
    return folder, target, one.collect(), two.collect()


def test_index_build_keeps_failures_to_their_rows(spark, index):
    folder, target, one, two = index
    by = {x.line_number: x for x in one}
    assert sorted(by) == [i for i, *_ in pages() if i % 3]
    assert by[17].detail.startswith("UnicodeDecodeError") and by[17].status == "pending" and by[17].action is None
    assert by[19].detail == "ValueError: a control character" and by[23].detail == "RuntimeError: a replacement character" and by[23].status == "failed"
    assert by[61].status == "needs_manual" and by[62].detail == "no parser could read it" and by[26].status == by[13].status == "pending" and by[26].ok
    assert {x.line_number for x in one if x.ok} == {i for i in by if i % 17 and i % 19 and i % 23 and i not in (61, 62)}
    assert len(two) == len(pages())
    records = {x.doc_id: x for x in target.read("registry").collect()}
    assert Counter(x.content_hash for x in records.values()).most_common(1)[0][1] == 1  # one record for a content
    active = {i for i, x in records.items() if x.status == "indexed"}
    urls = Counter(records[i].source_url for i in active)  # a record that moves to a URL retires nobody
    assert {u for u, n in urls.items() if n > 1} <= {"https://a.com/15"}
    # Vectors: those of indexed records, one for each child, with the record's filters.
    chunks, vectors = target.read("chunks").collect(), target.read("vectors").collect()
    assert {v.doc_id for v in vectors} == active and all(v.publisher == records[v.doc_id].publisher and len(v.dense) == building.DIM for v in vectors)
    assert {v.chunk_id for v in vectors} == {c.chunk_id for c in chunks if c.level == "child" and c.doc_id in active}
    assert len({c.chunk_id for c in chunks}) == len(chunks) and {c.parent_id for c in chunks if c.level == "child"} == {c.chunk_id for c in chunks if c.level == "parent"}
    # Superseded documents keep their chunks, so that versions can be traced.
    assert {i for i, x in records.items() if x.status == "superseded"} <= {c.doc_id for c in chunks}


def test_index_build_makes_the_chunks_of_a_direct_run(spark, index):
    from citelake.operators import chunk, html

    _, target, _, _ = index
    text = {c.chunk_id: c.text for c in target.read("chunks").collect()}
    hashes = {x.content_hash: x.doc_id for x in target.read("registry").filter("status = 'indexed'").collect()}
    _, contents = building.page_files(spark, index[0])
    for x in contents.filter(F.col("content_hash").isin(sorted(hashes))).collect():
        found = html.parse(bytes(x.content).decode())[1]
        rows = [(1, n, k, lv, t, len(t.split(" "))) for n, (k, lv, t) in enumerate(found)]
        want = chunk.chunks(spark.createDataFrame(rows, "doc_id long, ord long, type string, level int, text string, tok long"), *building.BOUNDS)
        if x.content_hash in sorted(hashes)[:3]:
            assert {c.chunk_id.replace("1_", f"{hashes[x.content_hash]}_", 1): c.text for c in want.collect()}.items() <= text.items()


def test_second_import_of_the_same_lines_changes_nothing(spark, index):
    folder, target, _, _ = index
    lines, contents = building.page_files(spark, folder)
    before = [rows(target.read(t)) for t in ("registry", "chunks")]
    again = lines.withColumn("publisher", F.when(F.col("line_number") % 4 == 0, "eu_commission").otherwise(F.col("publisher"))).filter("line_number % 17 > 0")
    single = again.join(again.groupBy("source_url").count().filter("count = 1").select("source_url"), "source_url", "left_semi")
    calls = spark.sparkContext.accumulator(0)

    def parser(content):
        calls.add(1)
        return building.page_parser(content)

    out = build.index_files(target, single, contents, parser, building.strict_words, building.strict_encoder, building.DIM, F.col("line_number") + 5000, bounds=building.BOUNDS)
    assert {x.action for x in out.filter("ok and status = 'indexed'").collect()} == {"SKIP"} and [rows(target.read(t)) for t in ("registry", "chunks")] == before
    assert calls.value < single.count()  # only what is not indexed


def test_a_build_that_dies_leaves_the_index(spark, index):
    folder, target, _, _ = index
    lines, contents = building.page_files(spark, folder)
    before = target.current(), rows(target.read("registry")), target.read("vectors").count()

    class Stop(Exception):
        pass

    def commit(staged):
        raise Stop

    own = build.store(spark, target.root, building.REGISTRY)
    own.commit = commit
    fresh = contents.withColumn("content", F.concat("content", F.lit(b"<p>more</p>"))).withColumn("content_hash", F.concat("content_hash", F.lit("+")))
    with pytest.raises(Stop):
        build.index_files(own, lines.withColumn("content_hash", F.concat("content_hash", F.lit("+"))), fresh, building.page_parser, building.strict_words, building.strict_encoder, building.DIM, F.col("line_number") + 9000, bounds=building.BOUNDS)
    assert before == (target.current(), rows(target.read("registry")), target.read("vectors").count())


def test_encoders_that_give_too_few_vectors_are_errors(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    short = build.encoded(d, lambda texts: (encode.hashed(4)(texts)[0][:-1], []), 4).collect()
    assert all(x.error.startswith("ValueError: 1 texts, but 0 dense") and x.dense is None for x in short)
    assert all(x.error.startswith("ValueError: the encoder has 4") for x in build.encoded(d, encode.hashed(4), 5).collect())


# ---- the build at size


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_that_lie_together_are_cut_without_a_shuffle(spark):
    from citelake.operators import chunk

    r = random.Random(9)
    docs = [(d, [(r.choice(["heading", "paragraph"]), " ".join("w" * r.randint(1, 5) for _ in range(r.randint(1, 30)))) for _ in range(r.randint(0, 40))]) for d in range(30)]
    lists = spark.createDataFrame(docs, "doc_id long, found array<struct<type:string,text:string>>").repartition(3)
    blocks = lists.select("doc_id", F.posexplode("found").alias("ord", "b")).select("doc_id", F.col("ord").cast("long").alias("ord"), "b.*", F.size(F.split("b.text", " ")).cast("long").alias("tok"))
    broken = blocks.withColumn("error", F.when((F.col("doc_id") % 7 == 3) & F.col("ord").isin(2, 5), F.concat(F.lit("e"), "ord")))
    got = chunk.cut(broken, 100, 200, 30)
    assert plan(got.filter("level is not null")).count("Exchange") == plan(lists).count("Exchange") == 1
    want = chunk.chunks(blocks.withColumn("level", F.lit(0)), 100, 200, 30)
    bad = {d for d, found in docs if d % 7 == 3 and len(found) > 2}
    assert Counter((x.doc_id, x.level, x.chunk_index, x.parent_id, x.text, x.start, x.end) for x in want.collect() if x.doc_id not in bad) == Counter((x.doc_id, x.level, x.chunk_index, None if x.parent is None else f"{x.doc_id}_p{x.parent:04d}", x.text, x.start, x.end) for x in got.collect() if x.error is None)
    assert sorted((x.doc_id, x.level, x.error) for x in got.filter("error is not null").collect()) == sorted((d, None, "e2") for d in bad)
    assert chunk.cut(broken.limit(0)).count() == 0


def test_old_and_new_rows_of_a_store_meet_in_one_shuffle(spark, tmp_path):
    schema = TABLES["a"][0]
    store = Store(spark, f"file://{tmp_path}", TABLES, 4)
    old = [(i % 40, f"v{i}") for i in range(200)] + [(None, "n")]
    spark.createDataFrame(old, schema).write.parquet(f"{tmp_path}/old")
    new, keys = [(3, "x"), (3, "y"), (90, "z")], [(3,), (4,), (90,), (91,)]
    got = store.merged(spark.read.parquet(f"{tmp_path}/old"), spark.createDataFrame(new, schema), spark.createDataFrame(keys, "id long"), ["id", "v"], "id")
    assert plan(got).count("Exchange") == 1
    assert rows(got.select("id", "v")) == sorted([x for x in old if x[0] not in (3, 4)] + new, key=str)
    store.commit(store.stage({"a": (spark.createDataFrame(old, schema), None)}))
    store.commit(store.stage({"a": (spark.createDataFrame(new, schema), None, spark.createDataFrame(keys, "id long"))}))  # more keys than rows
    assert rows(store.read("a")) == rows(got.select("id", "v"))


def test_a_parser_sees_each_content_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def parser(content):
        calls.add(1)
        if content == b"5":
            raise ValueError("five")
        return [("paragraph", 0, content.decode())]

    contents = spark.createDataFrame([(f"h{i}", str(i).encode()) for i in range(40)], "content_hash string, content binary").coalesce(1)
    got = {x.content_hash: x for x in build.parsed(contents, parser).collect()}
    assert calls.value == 40  # not once more for each halving of a batch with an error
    assert got["h5"].error == "ValueError: five" and got["h5"].found is None and all(x.error is None and x.found[0].text == h[1:] for h, x in got.items() if h != "h5")


def test_the_build_collects_no_table_that_grows(spark, tmp_path, monkeypatch):
    from citelake.operators import groups as grouping

    plans = []
    for module in (build, importing, grouping):
        def kept(df, name, f=module.written):
            plans.append(plan(df))
            return f(df, name)

        monkeypatch.setattr(module, "written", kept)
    spark.createDataFrame(pages()[:12], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    target, _, two = building.build_index(spark, str(tmp_path))
    assert two.count() == 12 and target.read("registry").count() > 0
    assert len(plans) > 20 and not [p for p in plans if "BroadcastExchange" in p]

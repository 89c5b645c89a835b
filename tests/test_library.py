import datetime
import random
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelake.functions import text as T
from citelake.operators import calibrate, chunk, cite, decide, encode, html, importing, index, pdfgeom, quality, requests, retrieve
from citelake.plans import answers
from citelake.sources import tables
from citelake.streaming import state


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("value", "want"), [("2021-7-1", datetime.date(2021, 7, 1)), ("2021/07/01", None), ("07-01-2021", None), ("去年", None), ("2021-13-01", None), (None, None)])
def test_days(spark, value, want):
    assert one(spark, value, T.parse_day) == want


def test_white_space_is_unicode(spark):
    assert one(spark, "　a\xa0 b\n", T.collapse) == "a b"
    assert one(spark, "\xa0　", T.clean) is None


def test_garbage(spark):
    assert one(spark, "a�\x00", T.garbage_ratio) == 0.75
    assert one(spark, "", T.garbage_ratio) == 1.0


def test_citation_numbers_keep_first_appearance(spark):
    assert one(spark, "［3］ [2] [3] [1,2] [99999999999999999999]", T.cited_numbers) == [3, 2]


def test_hosts(spark):
    assert one(spark, "https://WWW.Example.com:8080/a", T.host) == "example.com"
    assert one(spark, "not a url", T.host) is None


def test_decisions(spark):
    cols = "doc_id long, content_hash string, status string, title string, source_url string"
    reg = spark.createDataFrame([(1, "a", "indexed", "t", "u"), (2, "b", "pending", "t", "v"), (3, "c", "indexed", None, "w")], cols)
    new = spark.createDataFrame([(1, "a", "t", "u"), (2, "a", "t2", "u"), (3, "b", "t", "v"), (4, "z", "t", "w"), (5, "y", "t", None), (6, "c", None, "w"), (7, "x", "t", "v")], "line_number long, content_hash string, title string, source_url string")
    got = {r.line_number: r.action for r in decide.decide(new, reg).collect()}
    assert got == {1: "SKIP", 2: "UPDATE_META", 3: "REINDEX", 4: "SUPERSEDE_AND_NEW", 5: "NEW", 6: "SKIP", 7: "NEW"}


def blocks(spark, toks, headings=()):
    return spark.createDataFrame([(1, i, "heading" if i in headings else "paragraph", 0, "x" * (i + 1), n) for i, n in enumerate(toks)], "doc_id long, ord long, type string, level int, text string, tok long")


@pytest.mark.parametrize(("toks", "headings", "want"), [([10, 10, 10], (), [0, 0, 0]), ([30, 30, 1], (2,), [0, 0, 1]), ([31, 5, 5], (1,), [0, 1, 1]), ([29, 5], (1,), [0, 0]), ([100, 1], (), [0, 1])])
def test_parents(spark, toks, headings, want):
    rows = chunk.split_parents(blocks(spark, toks, headings), 30, 60).orderBy("ord").collect()
    assert [r.parent for r in rows] == want


def test_tokenizers_are_functions(spark):
    found = chunk.chunks(blocks(spark, [10, 10]), 30, 60, 10, chunk.counter(lambda texts: [len(x) for x in texts])).collect()
    assert sorted((r.level, r.text, r.token_count) for r in found) == [("child", "x", 1), ("child", "xx", 2), ("parent", "x\nxx", 4)]


def test_scores_of_cases_and_single_turns(spark):
    cases = spark.createDataFrame([(1, "answer", 0.1), (2, "refuse", 0.2)], "qid long, expected_behavior string, score double")
    assert sorted(map(tuple, calibrate.scored(cases, spark.createDataFrame([(1, 0.7)], "qid long, dense_top_score double")).collect())) == [(1, "answer", 0.7), (2, "refuse", None)]
    assert state.single_turns(spark.createDataFrame([(1, None), (2, "s")], "id long, session_id string")).count() == 1


def test_parent_bounds(spark):
    with pytest.raises(ValueError):
        chunk.split_parents(blocks(spark, [1]), 3, 2)


def test_chunks_are_slices(spark):
    c = chunk.chunks(blocks(spark, [10, 25, 7, 40, 3, 12, 50], (3,)), 30, 60, 10)
    assert chunk.violations(c).count() == 0
    bad = c.withColumn("text", F.when(F.col("level") == "child", "?").otherwise(F.col("text")))
    assert chunk.violations(bad).count() > 0
    parents = {r.chunk_id: r.text for r in c.filter("level = 'parent'").collect()}
    for p, t in parents.items():
        parts = c.filter((F.col("level") == "child") & (F.col("parent_id") == p)).orderBy("start").collect()
        assert "\n".join(r.text for r in parts) == t


def test_quality_lists_every_failure(spark):
    b = spark.createDataFrame([(1, "paragraph", "short"), (1, "paragraph", "short"), (1, "heading", "h")], "doc_id long, type string, text string")
    r = quality.assess(b).first()
    assert r.failures == ["chars", "fragments", "duplicates"] and r.total_chars == 13 and not r.passed


def test_fold_keeps_all_children_and_breaks_ties(spark):
    h = spark.createDataFrame([(0, 2, 1, 9, 0.5), (0, 1, 1, 9, 0.5), (0, 3, 1, 9, 0.9), (0, 4, 2, 9, 0.9)], "qid long, chunk_id long, parent_id long, doc_id long, score double")
    rows = retrieve.top_parents(h).orderBy("rk").collect()
    assert [r.parent_id for r in rows] == [1, 2] and [c.chunk_id for c in rows[0].children] == [3, 1, 2]


def test_dense_topk_filters_before_the_limit(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "DE"), (2, [0.9, 0.1], "FR"), (3, [0.0, 0.0], "FR")], "chunk_id long, dense array<double>, country string")
    q = spark.createDataFrame([(7, [1.0, 0.0], "FR"), (8, [1.0, 0.0], None)], "qid long, dense array<double>, country string")
    assert [(r.qid, r.chunk_id) for r in retrieve.dense_topk(q, v, 1).orderBy("qid").collect()] == [(7, 2), (8, 1)]
    assert retrieve.dense_topk(q, v, 0).count() == 0
    assert retrieve.dense_topk(q.limit(0), v).count() == 0


def test_gate(spark):
    assert one(spark, None, lambda c: retrieve.gate(c, 0.5), "double") is False
    assert one(spark, 0.5, lambda c: retrieve.gate(c, 0.5), "double") is True
    with pytest.raises(ValueError):
        retrieve.gate(F.lit(1.0), None)
    with pytest.raises(ValueError):
        retrieve.checked_filter({"country": "DE' or 1"})
    with pytest.raises(ValueError):
        retrieve.checked_filter({"country": "DE\n"})


def test_answers(spark):
    a = spark.createDataFrame([(1, "x [2] [0] [7]", 5), (2, "none", 5), (3, "[1]", 0)], "qid long, text string, n_materials long")
    r = {x.qid: x for x in cite.degrade(cite.check(a)).collect()}
    assert r[1].valid == [2] and r[1].invalid == [0, 7] and not r[1].degraded and r[1].notes == [cite.REMOVED % "0、7"]
    assert r[2].degraded and r[2].final_text == cite.NO_EVIDENCE and r[2].raw_text == "none" and r[3].degraded and r[3].raw_text == ""
    # Replaced answers say nothing of their citations; the note on dates comes first.
    a = spark.createDataFrame([(1, "x [1] [9]", 5), (2, "[9]", 5), (3, "[9]", 0)], "qid long, text string, n_materials long")
    r = {x.qid: x.notes for x in cite.degrade(cite.check(a), F.lit(True)).collect()}
    assert r == {1: [cite.UNDATED, cite.REMOVED % "9"], 2: [cite.UNDATED], 3: []}


def test_context_of_questions_without_materials(spark):
    m = spark.createDataFrame([(1, 1, "body", "T", None, "", "policy", datetime.date(2021, 7, 1), None)], "qid long, position int, text string, title string, publisher string, country string, doc_type string, effective_date date, source_url string")
    got = dict(cite.context(m, spark.createDataFrame([(1,), (2,)], "qid long")).collect())
    assert got[2] == cite.NO_MATERIAL and got[1] == "[1] T\n    发布机构：未标注  适用国家：未标注  文档类型：policy  生效日期：2021-07-01\n    出处：未登记\n    ---\nbody"


def test_context_needs_every_chunk_and_document(spark):
    chunks = spark.createDataFrame([("p1", "parent one", 2, None, None), ("c1", "one", 1, 7, 10), ("c2", "parent", 1, 0, 6)], "chunk_id string, text string, token_count long, start long, end long")
    docs = spark.createDataFrame([("d", "T")], "doc_id string, title string")
    hit = lambda parent, doc, *kids: spark.createDataFrame([(1, 1, parent, doc, 0.5, [(k, 0.1) for k in kids])], "qid long, rk int, parent_id string, doc_id string, score double, children array<struct<chunk_id:string,score:double>>")
    row = retrieve.load_context(hit("p1", "d", "c1", "c2"), chunks, docs).first()
    assert row.text == "parent one" and row.title == "T" and [(x.chunk_id, x.text, x.start) for x in row.matched_children] == [("c1", "one", 7), ("c2", "parent", 0)]
    for lost in (("p9", "d", "c1"), ("p1", "d9", "c1"), ("p1", "d", "c9")):
        with pytest.raises(Exception, match="no (parent|doc|chunk)_id .+: the index was cut short"):
            retrieve.load_context(hit(*lost), chunks, docs).collect()


def test_a_text_moves_twice_to_its_hit(spark):
    chunks = chunk.chunks(blocks(spark, [10, 25, 7, 40, 3, 12, 50], (3,)), 30, 60, 10)
    rows = {x.chunk_id: x for x in chunks.collect()}
    mine = {p: sorted(k for k, x in rows.items() if x.parent_id == p) for p, x in rows.items() if x.level == "parent"}
    parents = sorted(mine)
    asked = [(q, r + 1, p, 7, float(q), [(k, q / 10) for k in (mine[p][::-1] if q % 2 else mine[p])]) for q in range(5) for r, p in enumerate(parents[q % 2 :])] + [(9, 1, parents[0], 7, 0.5, []), (9, 2, parents[1], 7, 0.5, None)]
    hits = spark.createDataFrame(asked[::-1], "qid long, rk int, parent_id string, doc_id long, score double, children array<struct<chunk_id:string,score:double>>")
    out = retrieve.load_context(hits, chunks, spark.createDataFrame([(7, "T", "u")], "doc_id long, title string, url string"))
    want = [(q, p, r, d, s, rows[p].text, rows[p].token_count, [(k, x, rows[k].text, rows[k].start, rows[k].end) for k, x in kids] if kids else None, "T", "u") for q, r, p, d, s, kids in asked]
    got = [(*x[:7], [tuple(m) for m in x.matched_children] if x.matched_children is not None else None, *x[8:]) for x in out.collect()]
    assert got == want and out.columns == ["qid", "parent_id", "rk", "doc_id", "score", "text", "token_count", "matched_children", "title", "url"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Aggregate") == 1
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Aggregate" not in plan and "Window" not in plan


def test_chunks_of_many_documents_over_small_batches(spark):
    r = random.Random(2)
    rows = [(d, n, r.choice(["heading", "paragraph"]), "".join(r.choice("ab ") for _ in range(r.randrange(1, 9))), r.randrange(1, 40)) for d in (None, *range(9)) for n in range(r.randrange(1, 30))]
    want = []
    for d in (None, *range(9)):
        parents = []
        for _, _, kind, text, tok in (x for x in rows if x[0] == d):
            total = sum(t for _, t in parents[-1]) if parents else 200
            if total >= 200 or (total >= 100 and kind == "heading"):
                parents.append([])
            parents[-1].append((text, tok))
        n = 0
        for p, own in enumerate(parents):
            want.append((d, "parent", p, "\n".join(t for t, _ in own), None))
            kids = []
            for i, (_, tok) in enumerate(own):
                if not kids or sum(own[j][1] for j in kids[-1]) >= 30:
                    kids.append([])
                kids[-1].append(i)
            for k in kids:
                want.append((d, "child", n, "\n".join(own[i][0] for i in k), sum(len(own[i][0]) + 1 for i in range(k[0]))))
                n += 1
    r.shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (3, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = chunk.chunks(spark.createDataFrame(rows, "doc_id long, ord long, type string, text string, tok long"), 100, 200, 30).collect()
            assert sorted(map(str, ((x.doc_id, x.level, x.chunk_index, x.text, x.start) for x in got))) == sorted(map(str, want))
            assert all(x.end == x.start + len(x.text) for x in got if x.level == "child")
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_encoder_counts_and_dimensions(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", None, "", "a b"])], "id long, text string")
    got = encode.encode(rows, encode.hashed(8), 8, batch=2).orderBy("id").collect()
    assert len(got) == 4 and got[0].dense == got[3].dense and abs(sum(x * x for x in got[0].dense) - 1) < 1e-6 and got[1].sparse == {} and sorted(got[0].sparse.values()) == [1.0, 1.0]
    with pytest.raises(Exception, match="8 dimensions, not 9"):
        encode.encode(rows, encode.hashed(8), 9).collect()
    with pytest.raises(Exception, match="texts, but"):
        encode.encode(rows, lambda texts: (np.zeros((len(texts), 8)), []), 8).collect()
    assert encode.csr_maps(np.array([0, 2, 2]), np.array([5, 7]), np.array([1.0, 0.0])) == [{5: 1.0}, {}]


def test_request_validation(spark):
    bodies = ['{"question": "q"}', '{"question": ""}', "[]", "no json", '{"question": 5}', '{"question": "q", "x": 1}', '{"question": "q", "session_id": "%s"}' % ("s" * 129), None, '{"question": "%s"}' % ("é" * 2000)]
    got = [r.error for r in requests.validate(spark.createDataFrame(list(enumerate(bodies)), "id long, body string")).orderBy("id").collect()]
    assert got == [None, "question is missing", "not an object", "not an object", "question is not a string", "unknown key x", "session_id has more than 128 characters", "not an object", None]
    assert one(spark, "ok_1-", requests.trace_id) == "ok_1-" and one(spark, "a\n", requests.trace_id) != "a\n" and len(one(spark, None, requests.trace_id)) == 36


def test_tables_are_made_once_and_drift_is_seen(spark):
    spark.sql("drop table if exists made_table")
    assert index.create(spark, {"made_table": "a int, b string comment 'old'"}) == ["made_table"] and index.create(spark, {"made_table": "a int"}) == []
    want = spark.createDataFrame([], "a long, b string, c date")
    assert index.drift(spark.table("made_table"), want) == [("c", "missing"), ("a", "type"), ("b", "comment")]
    spark.sql("drop table made_table")
    spark.sql("drop table if exists made_vectors")
    assert index.create_vectors(spark, "made_vectors") and not index.create_vectors(spark, "made_vectors")
    spark.sql("drop table made_vectors")


def test_drifted_tables_are_aligned(spark):
    spark.sql("drop table if exists aligned_table")
    index.create(spark, {"aligned_table": "a int, b string comment 'old', x int"})
    spark.sql("insert into aligned_table values (1, 'b', 2)")
    want = {"aligned_table": "a long, b string comment 'it\\'s new', c date comment 'day', d array<double>", "no_such_table": "a int"}
    assert sorted(index.align(spark, want)) == [("aligned_table", "a", "type"), ("aligned_table", "b", "comment"), ("aligned_table", "c", "added"), ("aligned_table", "d", "added"), ("aligned_table", "x", "extra")]
    t = spark.table("aligned_table")
    assert {f.name: f.metadata.get("comment", "") for f in t.schema} == {"a": "", "b": "it's new", "x": "", "c": "day", "d": ""} and [tuple(r) for r in t.collect()] == [(1, "b", 2, None, None)]
    assert sorted(index.align(spark, want)) == [("aligned_table", "a", "type"), ("aligned_table", "x", "extra")]
    spark.sql("drop table aligned_table")


def test_import_keeps_failures_to_their_rows(spark):
    reg = spark.createDataFrame([(1, "a", "indexed", "u1", "p"), (2, "b", "pending", "u2", "p"), (3, "c", "indexed", "u3", "p")], "doc_id long, content_hash string, status string, source_url string, publisher string")
    new = spark.createDataFrame([(1, "a", "u1", None), (2, "b", "u2", "p"), (3, "x", "u1", "p"), (4, "y", "u4", "p"), (5, "z", "u5", "p"), (6, "w", None, "p"), (7, "x", "u1", "p"), (8, "c", "u3", "p")], "line_number long, content_hash string, source_url string, publisher string")
    parsed = spark.createDataFrame([("b", True, True, 1, 2), ("x", True, True, 3, 4), ("y", False, False, 0, 0), ("z", True, False, 1, 1), ("w", True, True, 1, 1)], "content_hash string, parsed boolean, indexed boolean, parents int, children int")
    out, after = importing.import_batch(new, reg, parsed, F.col("line_number") + 100, ("source_url", "publisher"))
    got = {r.line_number: (r.action, r.doc_id, r.status, r.ok, r.parents) for r in out.collect()}
    assert got == {
        1: ("UPDATE_META", 1, "pending", True, 0), 2: ("REINDEX", 2, "indexed", True, 1), 3: ("NEW", 103, "indexed", True, 3), 4: ("NEW", 104, "needs_manual", False, 0),
        5: (None, 105, "failed", False, 0), 6: ("NEW", 106, "pending", True, 0), 7: ("SKIP", 103, "indexed", True, 0), 8: ("SKIP", 3, "indexed", True, 0),
    }
    assert {r.doc_id: r.status for r in after.collect()} == {1: "pending", 2: "indexed", 3: "indexed", 103: "indexed", 104: "needs_manual", 105: "failed", 106: "pending"}
    vectors = spark.createDataFrame([(1, "v"), (103, "v")], "doc_id long, chunk_id string")
    assert [r.doc_id for r in importing.stale_vectors(vectors, after).collect()] == [103]


def test_html_files(spark):
    page = "<h1>T</h1><div id='help'><p>one</p></div>".encode() + b"<p>\xff</p>"
    files = spark.createDataFrame([(1, "https://a.com/x", page), (2, "https://b.com", page), (3, None, page), (4, "https://c.com", page)], "page_id long, url string, content binary")
    found, outcomes = html.parse_files(files, spark.createDataFrame([("a.com", "help"), ("c.com", "none")], "host string, selector string"))
    assert {r.page_id: r.error for r in outcomes.collect()} == {1: None, 2: "no selector for its host", 3: "no source_url", 4: "nothing in the container"}
    assert [(r.page_id, r.title, r.text) for r in found.collect()] == [(1, "T", "one")]


def test_refused_questions_never_reach_the_model(spark):
    q = spark.createDataFrame([(1, "p", 0.9, 1), (2, "p", 0.1, 1), (3, "p", None, 1)], "qid long, prompt string, dense_top_score double, n_materials long")
    got = {r.qid: r.outcome for r in cite.answer(q, 0.5, lambda p: F.concat(p, F.lit(" [1]"))).collect()}
    assert got == {1: "normal", 2: "refused", 3: "refused"}


def test_sweep_against_brute_force(spark):
    data = [("answer" if i % 3 else "refuse", None if i % 11 == 0 else (i * 37 % 50) / 50) for i in range(120)]
    got = [(r.threshold, r.blocked, r.missed) for r in calibrate.sweep(spark.createDataFrame(data, "expected_behavior string, score double"), 30).collect()]
    flat = [(k, -1.0 if s is None else s) for k, s in data]
    want = [(t, sum(k == "refuse" and s < t for k, s in flat), sum(k == "answer" and s < t for k, s in flat)) for t in {s for _, s in flat}]
    assert got == sorted((x for x in want if x[2] <= 30), key=lambda x: (-x[1], -x[0]))


def test_html():
    title, found = html.parse("<title>T</title><h1> A  b </h1><article><p>one<script>no</script> two<p>three<ul><li>x<p>y</p></li></ul><table><tr><td>1</td><td>2</td></tr></table></article><p>out</p>", "article")
    assert title == "A b" and [(b[0], b[2]) for b in found] == [("paragraph", "one two"), ("paragraph", "three"), ("list_item", "xy"), ("table", "1 2")]


@pytest.mark.parametrize(("data", "want"), [(b"%PDF-1.7 <", "pdf"), (b"\xef\xbb\xbf \n<!DOCTYPE html>", "html"), (b"plain", None), (b"\xff\xfe<a>", "html"), (b"plain text, a < b", None)])
def test_sniff(spark, data, want):
    assert one(spark, bytearray(data), html.sniff, "binary") == want


def test_routing(spark):
    a = spark.createDataFrame([(1, 1, "simple", False), (1, 2, "simple", True), (2, 1, "hard", False), (2, 2, "hard", True), (3, 1, "hard", True)], "doc_id long, tier int, difficulty string, passed boolean")
    assert {r.doc_id: r.tier for r in html.route(a).collect()} == {1: None, 2: 2, 3: 1}


def test_pdf_geometry(spark):
    lines = spark.createDataFrame([(1, 0, 1, 18.0, 10.0, "Head"), (1, 1, 1, 12.0, 30.0, "a"), (1, 2, 1, 12.0, 43.0, "b"), (1, 3, 1, 12.0, 80.0, "c"), (1, 4, 2, 12.0, 20.0, "d")], "doc_id long, seq long, page long, size double, top double, text string")
    assert [(r.type, r.text) for r in pdfgeom.build_blocks(lines).orderBy("ord").collect()] == [("heading", "Head"), ("paragraph", "a b"), ("paragraph", "c"), ("paragraph", "d")]
    words = spark.createDataFrame([(1, 1, 10.0, 5.0, "b"), (1, 1, 10.9, 1.0, "a"), (1, 1, 11.5, 0.0, "c")], "doc_id long, page long, top double, x0 double, text string")
    assert [r.text for r in pdfgeom.words_to_lines(words).orderBy("line").collect()] == ["b a", "c"]  # a row reads by top, then x


def test_cache_hits_do_not_renew(spark):
    r = spark.createDataFrame([("k", i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)) for i, s in enumerate([0, 300, 599, 600, 1100, 3000])], "key string, id long, ts timestamp_ntz")
    assert [x.hit for x in state.cache_hits(r, "key", "ts", "id").orderBy("id").collect()] == [False, True, True, False, True, False]


def test_sources(spark, tmp_path):
    p = tmp_path / "m.csv"
    head = "﻿title,file_name,country,platform,effective_date,extra,source_url,publisher,doc_type"
    p.write_text(head + "\nT,a.html,EU,amazon,2021-7-1,1,u,amazon,policy\n,,,,,,,,\nT,a.html,PL,amazon,,,,,\nT,b/c,EU,amazon,,,,,\nT,d,UK,amazon,,,,,\nT,e,NL,amazon,2021/07/01,,,,\nT,f,EU,ebay,,,,,\nT,g,EU,amazon,,,,me,\nT,h,EU,amazon,,,,,faq\n", encoding="utf-8")
    rows = {r.line_number: r.error for r in tables.manifest(tables.csv(spark, str(p), tables.MANIFEST_REQUIRED)).collect()}
    assert rows[2] is None and "line 2 is repeated in line 4" in rows[4] and "path" in rows[5] and "DE, ES" in rows[6] and "bad date" in rows[7] and 3 not in rows
    assert "platform ebay" in rows[8] and "publisher me" in rows[9] and "doc_type faq" in rows[10]
    assert tables.MANIFEST_REQUIRED == tuple(c for c in tables.MANIFEST if c != "notes")
    with pytest.raises(ValueError, match="missing columns"):
        tables.csv(spark, str(p), ("nothing",))
    good = "intro\n=== F-01 ===\n--- 问题 ---\none\ntwo\n```\n-- 译文\n=== note ===\n--- 原文 ---\nen\n--- 出处 ---\ns"
    f = spark.createDataFrame([("p", good), ("q", "--- 译文 ---\nx\n" + good + "\n" + good), ("r", good.replace("en", "译"))], "path string, value string")
    got = tables.faq(f).orderBy("path", "entry_id", F.col("error").isNotNull()).collect()
    assert [(r.path, r.entry_id, r.error) for r in got] == [("p", "F-01", None), ("q", None, "a field stands outside any entry"), ("q", "F-01", None), ("q", "F-01", "the entry is there twice"), ("r", "F-01", "answer_en has no Latin letter")]
    assert (got[0].question_zh, got[0].answer_zh, got[0].answer_en, got[0].source) == ("one\ntwo", "=== note ===", "en", "s")
    tables.write_faq(tables.faq(f.filter("path = 'p'")), str(tmp_path / "faq"))
    assert [r.asDict() for r in spark.read.json(str(tmp_path / "faq")).collect()] == [{"entry_id": "F-01", "question_zh": "one\ntwo", "answer_zh": "=== note ===", "answer_en": "en", "source": "s"}]
    with pytest.raises(ValueError, match="twice"):
        tables.write_faq(tables.faq(f), str(tmp_path / "bad"))
    (tmp_path / "c.csv").write_text("question,expected_behavior,category,expected_sources,notes\nq,answer,fact,a; b;,n\n,refuse,x,,n\nq,maybe,x,,n\nq,refuse,,,n\n")
    rows = tables.eval_cases(tables.csv(spark, str(tmp_path / "c.csv"), tables.CASES[:3])).orderBy("line_number").collect()
    assert [r.error for r in rows] == [None, "question is missing", "expected_behavior maybe is not one of answer, refuse", "category is missing"] and rows[0].expected_sources == ["a", "b"]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "x.html").write_bytes(b" <html>")
    row = tables.raw_files(spark, str(tmp_path / "raw")).first()
    assert (row.file_name, row.format, row.content_hash) == ("x.html", "html", hashlib.sha256(b" <html>").hexdigest())


def test_answers_view_keeps_whole_texts(spark, tmp_path):
    from citelake import fixtures

    text = "x" * 100 + " [3] end"
    spark.createDataFrame([(1, 1, "assistant", text), (1, 2, "user", text)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r.text for r in fixtures.view(spark, str(tmp_path), "answers").collect()] == [text + " [1]"]
    assert [r.number for r in answers.citation_numbers(spark, str(tmp_path)).collect()] == [3, 1]
    assert "substring" not in fixtures.SPARK["answers"] + fixtures.DUCK["answers"]


def test_manifest_violations_are_registered(spark, tmp_path):
    import __spark_entry__

    rows = [(1, "a", "de", "s"), (13, "b", "de", "s"), (2, "c", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.line_number: r.error for r in __spark_entry__.queries()["manifest_violations"](spark, str(tmp_path)).collect()}
    assert got == {2: "country EN is not one of DE, ES, EU, FR, IT, NL, PL"} and "manifest_violations" in __spark_entry__.oracle_sql()


def test_every_page_has_a_title_row(spark, tmp_path):
    rows = [(1, "u", "<h1>A &amp;  b</h1><p>no article</p>"), (2, "u", None), (3, "u", "<article><p>x</p><p>y</p></article>"), (4, "u", "<h1>T</h1><article><p>x</p></article>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(map(tuple, answers.html_title(spark, str(tmp_path)).collect())) == [(1, "A & b"), (2, None), (3, None), (4, "T")]


def test_a_reference_that_a_title_is_cut_in_stays(spark, tmp_path):
    import duckdb

    pages = ["<title>t</title><h1>a&amp;&amp; b&amp</h1><article><p>x &amp</p></article>", "<h1>c&lt;&amp;lt;</h1>", "<h1>d &am</h1>", "<h1>e & f&gt</h1>", "<h1>&eacute g</h1>"]
    rows = list(enumerate(pages))
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    sql = answers.ORACLES["html_title"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, answers.html_title(spark, str(tmp_path)).collect())) == sorted(duckdb.sql(sql).fetchall())
    assert html.parse(pages[0], "article") == ("a&& b&amp", [("paragraph", 0, "x &")])


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())

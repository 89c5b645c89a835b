"""Words and table boxes of pages."""

import random

from citelake.operators import pdfgeom

WORD = "doc_id long, page long, x0 double, x1 double, top double, bottom double, size double, text string"
TABLE = "doc_id long, page long, n int, left double, upper double, right double, lower double, cells array<array<string>>"


def test_a_sweep_finds_what_each_box_holds(spark):
    r = random.Random(4)
    words = [(r.randrange(3), r.randrange(2), float(x), x + 2.0, float(y), y + 2.0, 9.0, f"w{i}") for i in range(600) for x, y in [(r.randrange(60), r.randrange(60))]]
    words += [(0, 0, None, 3.0, 5.0, 7.0, 9.0, "nowhere"), (None, 0, 1.0, 3.0, 5.0, 7.0, 9.0, "nobody"), words[0]]
    boxes = [(r.randrange(3), r.randrange(2), i, float(x), float(y), float(x + r.randrange(9)), float(y + r.randrange(20)), []) for i in range(30) for x, y in [(r.randrange(50), r.randrange(50))]] + [(None, 0, 1, 0.0, 0.0, 99.0, 99.0, []), (1, 0, 1, None, 0.0, 99.0, 99.0, [])]
    inside = lambda w, b: None not in (w[0], w[2], *b[:7]) and w[:2] == b[:2] and b[3] <= (w[2] + w[3]) / 2 <= b[5] and b[4] <= (w[4] + w[5]) / 2 <= b[6]
    got = pdfgeom.outside_tables(spark.createDataFrame(words, WORD), spark.createDataFrame(boxes, TABLE))
    assert got.columns == [c.split()[0] for c in WORD.split(", ")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(w) for w in words if not any(inside(w, b) for b in boxes))
    assert pdfgeom.outside_tables(spark.createDataFrame(words, WORD), spark.createDataFrame([], TABLE)).count() == len(words)


def test_tables_follow_the_text_of_their_page(spark):
    at = lambda page, top, x, size, text, doc=1: (doc, page, float(x), x + 10.0, float(top), top + 10.0, size, text)
    words = [at(1, 10, 0, 20.0, "Title"), at(1, 40, 30, 10.0, "right"), at(1, 40.5, 0, 10.0, "left"), at(1, 52, 0, 10.0, "goes on"), at(1, 100, 0, 10.0, "cell"), at(1, 200, 0, 10.0, "new"), at(1, 300, 0, 10.0, " ")]
    words += [at(2, 10, 0, 14.0, "Part"), at(2, 30, 0, 10.0, "end"), at(1, 100, 0, 10.0, "only a cell", doc=2)]
    box = lambda n, cells, doc=1: (doc, 1, n, 0.0, 90.0, 50.0, 120.0, cells)
    tables = spark.createDataFrame([box(2, [["b", None]]), box(1, [[" a ", "c"], ["", " "], ["d", "e"]]), box(3, [["", None]]), box(1, [["x"]], doc=2)], TABLE)
    words = spark.createDataFrame(words, WORD)
    got = [tuple(x) for x in pdfgeom.page_blocks(words, tables).orderBy("doc_id", "ord").collect()]
    assert got == [
        (1, 0, 1, "heading", 1, "Title"), (1, 1, 1, "paragraph", 0, "right left goes on"), (1, 2, 1, "paragraph", 0, "new"), (1, 3, 1, "table", 0, "a | c\nd | e"), (1, 4, 1, "table", 0, "b | "),
        (1, 5, 2, "heading", 1, "Part"), (1, 6, 2, "paragraph", 0, "end"),
    ]
    assert [x.doc_id for x in pdfgeom.without_lines(words, tables, words.select("doc_id").distinct()).collect()] == [2]


def test_rows_over_several_batches_and_odd_heights(spark):
    r = random.Random(5)
    heights = [None, float("nan"), 1.0, 1.5, 2.0, 2.1, 3.05, 80.1, 81.1, 81.2, float("inf"), 5e8]
    words = [(None if d == 3 else d, r.randrange(2), float(x), x + 2.0, h if h is None else h + r.choice([0, 0, 0.4]), 1e9, r.choice([None, 9.0, 12.0]), r.choice([None, " ", f"w{i}", "a  b"])) for i in range(900) for d, x, h in [(r.randrange(4), r.randrange(60), r.choice(heights))]]
    rank = lambda v: (0, 0) if v is None else (2, 0) if v != v else (1, v)
    want, pages = [], {}
    for w in words:
        pages.setdefault(w[:2], []).append(w)
    for key, of in pages.items():
        rows, anchor = [], None
        for w in sorted(of, key=lambda w: (rank(w[4]), rank(w[2]), w[7] is not None, w[7] or "")):
            if anchor is None or abs(w[4] - anchor) > 1:
                rows.append([])
                anchor = w[4]
            rows[-1].append(w)
        texts = [" ".join(" ".join(w[7] for w in x if w[7] is not None).split()) for x in rows]
        want += [(*key, n, text, max((w[6] for w in x if w[6] is not None), default=None), x[0][4]) for n, (x, text) in enumerate(zip(rows, texts, strict=True)) if text]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            frame = spark.createDataFrame(words, WORD)
            none = spark.createDataFrame([(0, 0, 1, -9.0, -9.0, -8.0, -8.0, [])], TABLE)
            for got in (pdfgeom.words_to_lines(frame), pdfgeom.words_to_lines(frame, none)):
                assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_words_pass_one_shuffle(spark):
    words, tables = spark.createDataFrame([], WORD), spark.createDataFrame([], TABLE)
    plan = pdfgeom.words_to_lines(words, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Aggregate" not in plan


def test_words_of_a_band_travel_as_one_row(spark):
    line = lambda top, texts, x=0.0: [(1, 1, x + 30.0 * i, x + 30.0 * i + 20, top, top + 8, 9.0, t) for i, t in enumerate(texts)]
    words = [*line(10.0, ["a", "b\x1fc", "", "d"]), *line(70.0, [f"w{i}" for i in range(500)]), *line(70.0, ["between", None], 15.0), *line(70.0, ["same", "same"], 15.0)]
    frame = spark.createDataFrame(words, WORD).coalesce(1)
    rows = pdfgeom.passing(frame, spark.createDataFrame([(1, 1, 1, -9.0, -9.0, -8.0, -8.0, [])], TABLE))
    assert rows.count() == 3  # two bands and a box
    want = [(0, "a b\x1fc d"), (1, " ".join(["w0", "between", "same", "w1", "same", *(f"w{i}" for i in range(2, 500))]))]
    for size in (1, 100, 10_000):
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert [(x.line, x.text) for x in pdfgeom.words_to_lines(frame).orderBy("line").collect()] == want
            assert sorted(map(str, map(tuple, pdfgeom.outside_tables(frame, spark.createDataFrame([], TABLE)).collect()))) == sorted(map(str, words))
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_lines_of_a_document_meet_once(spark):
    words, tables = spark.createDataFrame([], WORD), spark.createDataFrame([], TABLE)
    plan = pdfgeom.page_blocks(words, tables)._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Repartition") == 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        words = spark.range(4).selectExpr("id doc_id", "1L page", "0D x0", "9D x1", "id * 1D top", "9D bottom", "9D size", "'x' text")
        boxes = spark.range(4).selectExpr("id doc_id", "1L page", "1 n", "50D left", "0D upper", "60D right", "9D lower", "array(array('c')) cells")
        found = pdfgeom.page_blocks(words, boxes)
        lines = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert lines.count("Exchange hashpartitioning") == 2 and "Join" not in lines  # words by page, lines by document
    assert [tuple(x) for x in found.filter("doc_id = 2").orderBy("ord").collect()] == [(2, 0, 1, "paragraph", 0, "x"), (2, 1, 1, "table", 0, "c")]


def test_spans_in_any_order_are_joined_before_they_are_grouped(spark):
    r = random.Random(8)
    odd = [None, float("nan"), 1.0, 2.5, -3.0]
    rows = [(d, p, q, n, r.choice(odd), r.choice(odd), r.choice([None, "", " ", "a", "ß\U0001f600", "b c"])) for d in (1, None) for p in (1, 2) for q in range(12) for n in range(r.randrange(1, 9))]
    rows += [(1, 1, 3, 2, 9.0, 9.0, "again"), (1, 1, 4, None, 9.0, 9.0, "none"), (1, 1, 5, 40, 9.0, 9.0, "gap")]
    schema = "doc_id long, page long, seq long, span int, size double, top double, text string"
    top = lambda v: (v != v, v)
    want = {}
    for x in rows:
        want.setdefault(x[:3], []).append(x)
    pick = lambda of, f: f([v for v in of if v is not None], key=top, default=None)
    full = {k: (pick([x[4] for x in of], max), pick([x[5] for x in of], min), "".join(x[6] or "" for x in sorted(of, key=lambda x: (x[3] is not None, x[3] or 0, x[6] is not None, x[6] or "")))) for k, of in want.items()}
    full = {k: v for k, v in full.items() if v[2].strip(" ")}
    for order in ("sorted", "mixed"):
        if order == "mixed":
            r.shuffle(rows)
        df = spark.createDataFrame(rows, schema).coalesce(2)
        got = {(x.doc_id, x.page, x.seq): (x["size"], x.top, x.text) for x in pdfgeom.span_lines(df).collect()}
        assert {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in full.items()}
    long_ = spark.range(0, 2000, 1, 1).selectExpr("1L doc_id", "1L page", "id div 500 seq", "cast(id % 500 as int) span", "1D size", "1D top", "'x' text")
    pieces = long_.mapInArrow(pdfgeom.span_pieces, "doc_id long, page long, seq long, size double, top double, first int, ends array<int>, text string")
    assert pieces.count() == 4 and {len(x.text) for x in pdfgeom.span_lines(long_).collect()} == {500}

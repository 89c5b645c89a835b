"""PDF geometry: from text lines and words with positions to headings, paragraphs and table-free lines."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse

# Fixed values in points: a gap below the first is one line, up to the second one paragraph; words of one row; the footer's share of the height.
SAME_LINE, PARAGRAPH, ROW, FOOTER = 1.0, 20.0, 1.0, 0.9
PAGE, BOX = ["doc_id", "page"], ["left", "upper", "right", "lower"]
KEYS, DRAWN = [*PAGE, "band_"], ["x0", "x1", "top", "bottom", "size"]
# Words of a page that travel together are of one band of this height; words that are taken out of their bundles at once, if one band has no more.
BAND, SLICE = 64.0, 1 << 16
# Stands between the texts of a bundle.
BETWEEN = "\x1f"
# What null is among packed doubles: a NaN that no arithmetic makes; any other NaN is packed as NAN.
NULL, NAN = np.uint64(0x7FF8000000000001), np.uint64(0x7FF8000000000000)
# Fixed value: what a page number reads like.
PAGE_NUMBER = r"^\d+\s*/\s*\d+$"


def drop_page_numbers(lines: DataFrame, height: Column | float) -> DataFrame:
    """Lines low on the page that read like 3 / 7 go."""
    return lines.filter(~((F.col("top") >= F.lit(FOOTER) * height) & F.trim("text").rlike(PAGE_NUMBER)))


def span_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, page, seq, size, top, first, ends, text) of spans as they come: those of one line that follow each other by number become one row, with the place where each one's text ends."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, span = [batch.column(c) for c in ("doc_id", "page", "seq")], batch.column("span")
        there, number = span.is_valid().to_numpy(zero_copy_only=False), pc.cast(span, pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        cut = np.zeros(batch.num_rows, bool)
        cut[changes(keys)] = True
        cut[1:] |= (np.diff(number) != 1) | ~there[1:] | ~there[:-1]
        at = np.flatnonzero(cut)
        offsets, text = pa.array(np.append(at, batch.num_rows), pa.int32()), batch.column("text").fill_null("")
        upto = np.cumsum(pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
        before = np.append(0, upto)[at]
        ends = pa.ListArray.from_arrays(offsets, pa.array(upto - np.repeat(before, np.diff(np.append(at, batch.num_rows))), pa.int32()))
        out = {c: k.take(pa.array(at)) for c, k in zip(("doc_id", "page", "seq"), keys, strict=True)}
        for c, least in (("size", False), ("top", True)):  # NaN is larger than all
            known = batch.column(c).is_valid().to_numpy(zero_copy_only=False)
            v = numbers(batch.column(c))
            most = np.fmin.reduceat(np.where(known, v, np.nan), at) if least else np.maximum.reduceat(np.where(known, v, -np.inf), at)
            out[c] = pa.array(most, mask=~np.logical_or.reduceat(known, at), from_pandas=False).cast(batch.column(c).type)
        yield pa.record_batch(out | {"first": span.take(pa.array(at)), "ends": ends, "text": pc.binary_join(pa.ListArray.from_arrays(offsets, text), "")})


def span_lines(spans: DataFrame) -> DataFrame:
    """(doc_id, page, seq, size, top, text) of text spans (doc_id, page, seq, span, size, top, text): a line's spans are joined without a separator, its size is that of its largest span, blank lines go. span: whole numbers.

    Spans that come in order are put together before they are grouped, so a line is a row or a few and not one for each span. Pieces of a line whose numbers overlap are taken apart again.
    """
    kinds, names = dict(spans.dtypes), ["doc_id", "page", "seq", "size", "top"]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in names), f"first {kinds['span']}, ends array<int>, text string"])
    pieces = spans.select(*names, "span", "text").mapInArrow(span_pieces, schema)
    p = F.array_sort(F.collect_list(F.struct("first", "text", "ends")))
    lines = pieces.groupBy("doc_id", "page", "seq").agg(F.max("size").alias("size"), F.min("top").alias("top"), p.alias("p"))
    part = lambda x, e, i: F.struct((x["first"] + i).alias("span"), F.substring(x["text"], F.when(i > 0, F.get(x["ends"], i - 1)).otherwise(0) + 1, e - F.when(i > 0, F.get(x["ends"], i - 1)).otherwise(0)).alias("text"))
    apart = F.array_sort(F.flatten(F.transform("p", lambda x: F.transform(x["ends"], lambda e, i: part(x, e, i)))))
    overlap = F.exists(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.coalesce(F.get("p", i)["first"] < F.get("p", i - 1)["first"] + F.size(F.get("p", i - 1)["ends"]), F.lit(True)))
    text = F.when((F.size("p") > 1) & overlap, F.array_join(F.transform(apart, lambda x: x["text"]), "")).otherwise(F.array_join(F.transform("p", lambda x: x["text"]), ""))
    return lines.select("doc_id", "page", "seq", "size", "top", text.alias("text")).filter(F.trim("text") != "")


def body_size(lines: DataFrame) -> DataFrame:
    """(doc_id, body): the most frequent size rounded to one decimal, half to even; the smallest of equally frequent ones."""
    return lines.groupBy("doc_id").agg(F.mode(F.bround("size", 1), True).alias("body"))


def heading_levels(lines: DataFrame) -> DataFrame:
    """(doc_id, size, level): sizes over the body's, the largest is level 1."""
    sizes = lines.select("doc_id", F.bround("size", 1).alias("size")).distinct().join(body_size(lines), "doc_id").filter("size > body")
    return sizes.select("doc_id", "size", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size"))).cast("long").alias("level"))


def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord, type, level, text): lines with a level stand alone, other lines join while on one page and close enough, with a space between their texts. rows: keys, seq, page, level, top, text."""
    w = Window.partitionBy(*keys).orderBy("seq")
    heading, before = F.col("level").isNotNull(), F.lag("seq").over(w)
    gap = F.col("top") - F.lag("top").over(w)
    goes_on = (F.lag("page").over(w) == F.col("page")) & (gap <= PARAGRAPH)
    cut = before.isNull() | heading | F.coalesce(F.lag("level").over(w).isNotNull(), F.lit(False)) | ~goes_on
    rows = rows.withColumn("ord", F.sum(cut.cast("long")).over(w) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")
    out = rows.groupBy(*keys, "ord").agg(text.alias("text"), F.coalesce(F.max("level"), F.lit(0)).cast("long").alias("level"))
    return out.select(*keys, "ord", F.when(F.col("level") > 0, "heading").otherwise("paragraph").alias("type"), "level", "text")


def build_blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, ord, type, level, text): heading lines stand alone, other lines join while on one page and close enough. lines: doc_id, seq, page, size, top, text."""
    return merged(lines.withColumn("size", F.bround("size", 1)).join(heading_levels(lines), ["doc_id", "size"], "left"), ["doc_id"]).withColumn("text", collapse(F.col("text")))


def changes(columns: list[pa.Array]) -> np.ndarray:
    """Places of a batch, 0 among them, where one of the columns is not what it was in the row before; null is a value."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        null = c.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= pc.not_equal(c[1:], c[:-1]).fill_null(False).to_numpy(zero_copy_only=False) | (null[1:] != null[:-1])
    return np.flatnonzero(new)


def paged(batch: pa.RecordBatch) -> tuple[list[tuple[int, int]], tuple, tuple]:
    """[start, end) of each page in a batch, and the first and the last page's key."""
    ids = [batch.column(c) for c in PAGE]
    cuts = [*changes(ids).tolist(), batch.num_rows]
    key = lambda i: tuple(c[i].as_py() for c in ids)
    return list(zip(cuts[:-1], cuts[1:], strict=True)), key(0), key(batch.num_rows - 1)


def numbers(column: pa.Array) -> np.ndarray:
    """As doubles; null is NaN."""
    return pc.cast(column, pa.float64()).to_numpy(zero_copy_only=False)


def planes(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the first byte of each packed double is, and how far apart its bytes are, in runs that begin at `starts`; the last start is the end."""
    n = np.diff(starts)
    return np.arange(starts[-1]) + 7 * np.repeat(starts[:-1], n), np.repeat(n, n)


def packed(values: pa.Array, starts: np.ndarray) -> pa.Array:
    """Runs of doubles as binary, all first bytes of a run before all second ones: what coordinates have in common lies together, where a shuffle compresses it."""
    v = numbers(values)
    bits = np.where(np.isnan(v), NAN, v.view(np.uint64))
    bits[values.is_null().to_numpy(zero_copy_only=False)] = NULL
    out, (place, step) = np.empty(8 * len(v), np.uint8), planes(starts)
    for k, byte in enumerate(bits.view(np.uint8).reshape(-1, 8).T):
        out[place + k * step] = byte
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((8 * starts).astype(np.int32)), pa.py_buffer(out)])


def unpacked(runs: pa.Array) -> pa.Array:
    """The doubles of `packed` runs."""
    ends = np.frombuffer(runs.buffers()[1], np.int32)[runs.offset : runs.offset + len(runs) + 1].astype(np.int64)
    data, (place, step) = np.frombuffer(runs.buffers()[2], np.uint8)[ends[0] : ends[-1]], planes((ends - ends[0]) // 8)
    bits = np.stack([data[place + k * step] for k in range(8)], 1).reshape(-1).view(np.uint64)
    return pa.array(bits.view(np.float64), mask=bits == NULL)


def sizes(bundles: pa.RecordBatch) -> np.ndarray:
    """How many words each bundle has."""
    x0 = bundles.column("x0")
    return (pc.binary_length(x0).to_numpy(zero_copy_only=False) // 8 if pa.types.is_binary(x0.type) else pc.list_value_length(x0).to_numpy(zero_copy_only=False)).astype(np.int64)


def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a batch that are of one page and band become one row, and their other columns lists; doubles of DRAWN are packed, texts are one string, or a list in texts_ where one is null or holds the separator."""
    for batch in batches:
        if not batch.num_rows:
            continue
        band = pa.array(np.floor(numbers(batch.column("top")) / BAND), mask=batch.column("top").is_null().to_numpy(zero_copy_only=False))
        rows = pa.table([*(batch.column(c) for c in PAGE), band, pa.array(np.arange(batch.num_rows))], [*KEYS, "i_"]).group_by(KEYS, use_threads=False).aggregate([("i_", "list")])
        places = rows.column("i__list").combine_chunks()
        lists = {c: rows.column(c).combine_chunks() if c in KEYS else pa.ListArray.from_arrays(places.offsets, batch.column(c).take(places.values)) for c in [*batch.schema.names, "band_"]}
        starts = places.offsets.to_numpy()
        lists |= {c: packed(lists[c].values, starts.astype(np.int64)) for c in DRAWN if c in lists and pa.types.is_float64(batch.column(c).type)}
        if "text" in lists:
            texts = lists["text"].values
            odd = np.logical_or.reduceat(pc.match_substring(texts, BETWEEN).fill_null(True).to_numpy(zero_copy_only=False), starts[:-1])
            counts = np.diff(starts)
            upto = np.append(0, np.cumsum(np.where(odd, counts, 0))).astype(np.int32)
            lists |= {"text": pc.if_else(pa.array(odd), None, pc.binary_join(lists["text"], BETWEEN)), "texts_": pa.ListArray.from_arrays(pa.array(upto), texts.filter(pa.array(np.repeat(odd, counts))))}
        yield pa.record_batch(lists)


def bands(bundles: pa.RecordBatch) -> np.ndarray:
    """Places where a page, its boxes or a band begin; null and NaN are bands."""
    band = numbers(bundles.column("band_"))
    none = np.isnan(band)
    more = [bundles.column("box_").is_null()] if "box_" in bundles.schema.names else []
    return changes([*(bundles.column(c) for c in PAGE), *more, bundles.column("band_").is_null(), pa.array(none), pa.array(np.where(none, 0, band))])


def texts_of(bundles: pa.RecordBatch, counts: np.ndarray) -> pa.Array:
    """The texts of all words of `bundled` rows."""
    whole = bundles.column("text").is_valid().to_numpy(zero_copy_only=False)
    texts = pc.split_pattern(bundles.column("text"), BETWEEN).flatten()
    if whole.all():
        return texts
    first = np.where(whole, np.cumsum(np.where(whole, counts, 0)), len(texts) + np.cumsum(np.where(whole, 0, counts))) - counts
    return pa.concat_arrays([texts, bundles.column("texts_").flatten()]).take(pa.array(np.arange(counts.sum()) + np.repeat(first - np.cumsum(counts) + counts, counts)))


def opened(bundles: pa.RecordBatch) -> pa.RecordBatch:
    """The words of bundles that come by page and band, by top, x0 and text within a band."""
    counts = sizes(bundles)
    at, group = np.repeat(np.arange(len(counts)), counts), np.zeros(len(counts), np.int64)
    group[bands(bundles)[1:]] = 1
    whole, flat = [*PAGE, "box_"], {}
    names = [c for c in bundles.schema.names if c not in ("texts_", "band_")]
    for c in names:
        if c not in whole:
            flat[c] = texts_of(bundles, counts) if c == "text" else unpacked(bundles.column(c)) if c in DRAWN and pa.types.is_binary(bundles.column(c).type) else bundles.column(c).flatten()
    by = []
    for c in ("x0", "top"):  # null is smallest, NaN largest
        v = numbers(flat[c])
        by += [np.where(np.isnan(v), 0, v), np.isnan(v), flat[c].is_valid().to_numpy(zero_copy_only=False)]
    by.append(np.cumsum(group)[at])
    order = np.lexsort(by)
    alike = np.ones(max(len(order) - 1, 0), bool)
    for v in by:
        alike &= v[order][1:] == v[order][:-1]
    if alike.any() and "text" in flat:
        edge = np.diff(np.concatenate(([0], alike.astype(np.int8), [0])))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + 1).tolist(), strict=True):
            own = flat["text"].take(pa.array(order[a:b])).to_pylist()
            order[a:b] = order[a:b][sorted(range(b - a), key=lambda i: (own[i] is not None, own[i] or ""))]  # noqa: B023
    words, of = pa.array(order), pa.array(at[order])
    return pa.record_batch({c: bundles.column(c).take(of) if c in whole else flat[c].take(words) for c in names})


def loosened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of `passing` bundles by page, top, x0 and text; boxes pass as they are. Bundles of one band are held until they are all there."""
    held = []

    def closed() -> Iterator[pa.RecordBatch]:
        if held:
            yield opened(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = bands(batch).tolist()
        if held and len(bands(pa.Table.from_batches([held[0].slice(0, 1), batch.slice(0, 1)]).combine_chunks().to_batches()[0])) == 1:
            held.append(batch.slice(0, cuts[1] if len(cuts) > 1 else batch.num_rows))
            cuts = cuts[1:]
        if not cuts:
            continue
        yield from closed()
        upto = np.append(0, np.cumsum(sizes(batch)))[cuts]
        a = 0
        while a < len(cuts) - 1:
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + SLICE, "right")) - 1)
            yield opened(batch.slice(cuts[a], cuts[b] - cuts[a]))
            a = b
        held = [batch.slice(cuts[-1])]
    yield from closed()


def passing(words: DataFrame, tables: DataFrame | None) -> DataFrame:
    """Bundles of words with a null box_, and before each page's words its boxes; pages pass as streams in order of bands.

    A bundle has the words of one page and band that come in one Arrow batch: it is the bundles that are shuffled and sorted, not the words. `loosened` takes them apart.
    """
    kinds = {c: t if c in [*PAGE, "text"] else "binary" if c in DRAWN and t == "double" else f"array<{t}>" for c, t in words.dtypes} | {"band_": "double"} | ({"texts_": "array<string>"} if "text" in words.columns else {})
    rows = words.mapInArrow(bundled, ", ".join(f"`{c}` {t}" for c, t in kinds.items()))
    if tables is None:
        return rows.repartition(*PAGE).sortWithinPartitions(*KEYS)
    some = tables.dropna(subset=[*PAGE, *BOX]).select(*(F.col(c).try_cast(words.schema[c].dataType).alias(c) for c in PAGE), F.struct(*(F.col(c).cast("double").alias(c) for c in BOX)).alias("box_"))
    some = some.dropna(subset=PAGE).select("*", *((F.lit(NULL.tobytes()) if t == "binary" else F.array(F.lit(None)).cast(t)).alias(c) for c, t in kinds.items() if c not in [*KEYS, "text"]))
    rows = rows.withColumn("box_", F.lit(None).cast(some.schema["box_"].dataType)).unionByName(some, allowMissingColumns=True)
    return rows.repartition(*PAGE).sortWithinPartitions(*PAGE, F.col("box_").isNotNull().desc(), "band_")


def outside(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Of `loosened` rows the words outside their page's boxes, with the columns `names`. The boxes of one page are held; each looks up the words at its height."""
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        box = batch.column("box_")
        keep = box.is_null().to_numpy(zero_copy_only=False).copy()
        mine = np.flatnonzero(~keep).tolist()
        if mine or held:
            (pages, first, end), found, at = paged(batch), box.take(pa.array(mine, pa.int64())).to_pylist(), 0
            x, y = (numbers(batch.column("x0")) + numbers(batch.column("x1"))) / 2, (numbers(batch.column("top")) + numbers(batch.column("bottom"))) / 2
            for a, b in pages:
                if a or first != last:
                    held = []
                while at < len(mine) and mine[at] < b:
                    held.append(found[at])
                    at += 1
                if held:
                    o = a + np.argsort(y[a:b], kind="stable")
                    high = y[o]
                    for h in held:
                        these = o[np.searchsorted(high, h["upper"]) : np.searchsorted(high, h["lower"], "right")]
                        keep[these[(x[these] >= h["left"]) & (x[these] <= h["right"])]] = False
            last = end
        batch = batch.select(names)
        yield batch if keep.all() else batch.filter(pa.array(keep))


def row_starts(top: np.ndarray, blank: int, anchor: float | None) -> tuple[list[int], float | None]:
    """Where rows begin among a page's sorted heights, of which the first `blank` are null and stand alone, and the first height of the last row; `anchor` is that of a row that is open before."""
    starts, at, high = list(range(blank)), blank, top.tolist()
    end = len(high) - int(np.isnan(top[blank:]).sum())  # NaN sorts last and begins no row where there is one
    while at < len(high):
        if anchor is None or abs(high[at] - anchor) > ROW:
            starts.append(at)
            anchor = high[at]
        at = bisect.bisect_left(high, True, at + 1, end, key=lambda v: v - anchor > ROW) if at + 1 < end else max(at + 1, end)
        at = len(high) if at >= end else at
    return starts, anchor


def joined_rows(words: pa.RecordBatch, begins: list[int], lines: list[int], more: list[str]) -> pa.RecordBatch:
    """One row for each row of words, from the places where they begin."""
    text, at = words.column("text"), np.array(begins)
    upto = np.append(0, np.cumsum(text.is_valid().to_numpy(zero_copy_only=False)))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto[[*begins, len(text)]], pa.int32()), text.drop_null()), " ")
    out = {"doc_id": words.column("doc_id").take(pa.array(at)), "page": words.column("page").take(pa.array(at)), "line": pa.array(lines, pa.int64()), "text": texts}
    for c in more:
        size = words.column(c)
        there = size.is_valid().to_numpy(zero_copy_only=False)
        most = np.maximum.reduceat(np.where(there, numbers(size), -np.inf), at)
        out |= {c: pa.array(most, mask=~np.logical_or.reduceat(there, at)).cast(size.type), "top": words.column("top").take(pa.array(at))}
    return pa.record_batch(out)


def rows_of_words(batches: Iterator[pa.RecordBatch], more: list[str]) -> Iterator[pa.RecordBatch]:
    """(doc_id, page, line, text and, if `more` has size, size and top) of words that pass by page, top and x. The open row is held."""
    last, line, anchor, held = None, -1, None, []

    def closed() -> Iterator[pa.RecordBatch]:
        if held:
            yield joined_rows(pa.Table.from_batches(held).combine_chunks().to_batches()[0], [0], [line], more)

    for batch in batches:
        if not batch.num_rows:
            continue
        pages, first, end = paged(batch)
        top, known = numbers(batch.column("top")), batch.column("top").is_valid().to_numpy(zero_copy_only=False)
        begins, lines, now = [], [], line
        for a, b in pages:
            if a or first != last:
                now, anchor = -1, None
            found, anchor = row_starts(top[a:b], int((~known[a:b]).sum()), anchor)
            begins += [a + i for i in found]
            lines += range(now + 1, now + 1 + len(found))
            now += len(found)
        last = end
        if not begins:
            held.append(batch)
            continue
        if begins[0]:
            held.append(batch.slice(0, begins[0]))
        yield from closed()
        if len(begins) > 1:
            yield joined_rows(batch.slice(begins[0], begins[-1] - begins[0]), [i - begins[0] for i in begins[:-1]], lines[:-1], more)
        held, line = [batch.slice(begins[-1])], lines[-1]
    yield from closed()


def words_to_lines(words: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, line, text): words sorted by top and x; a word joins a row within 1 pt of the row's first word, and a row reads in that order. Blank rows go.

    Where words have a size, also size (the largest of the row's) and top (the smallest). tables: of the words only those outside the boxes, as in `outside_tables`; both in one pass. Rows are put together where their words pass, in bundles of one band.
    """
    kinds, plain = dict(words.dtypes), tables is None
    more = [c for c in ("size",) if c in kinds]
    own = [*PAGE, "text", *more, "top"]
    rows = passing(words.select(*PAGE, "top", "x0", "text", *more, *([] if plain else ["x1", "bottom"])), tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = loosened(batches)
        return rows_of_words((b.select(own) for b in loose) if plain else outside(loose, own), more)

    schema = f"doc_id {kinds['doc_id']}, page {kinds['page']}, line long, text string" + "".join(f", {c} {kinds[c]}, top {kinds['top']}" for c in more)
    return rows.mapInArrow(run, schema).withColumn("text", collapse(F.col("text"))).filter("text <> ''")


def outside_tables(words: DataFrame, tables: DataFrame) -> DataFrame:
    """Words (x0, x1, top, bottom) whose centre lies in no table box (left, upper, right, lower) of their page; words without a place are in none.

    A page's boxes pass before its words, in one stream, and a box meets only the words at its height: time grows with words, boxes and the words beside boxes, not with the product of words and boxes.
    """
    names = words.columns
    rows = passing(words, tables)
    return rows.mapInArrow(lambda batches: outside(loosened(batches), names), ", ".join(f"`{c}` {t}" for c, t in words.dtypes))


def page_blocks(words: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, ord, page, type, level, text): of words (doc_id, page, x0, x1, top, bottom, size, text) and tables (doc_id, page, n, left, upper, right, lower, cells: array<array<string>>).

    Each page's headings and paragraphs come first, of the words outside its tables, then its tables in the order of n; blocks are numbered through the document. The body's size is that of the whole document, heading
    levels are those of the page. Tables without text give no block. A document without a line outside tables gives none: see `without_lines`.
    Lines and tables meet by document, in one shuffle: sizes, levels, blocks and their numbers are windows and groups over it.
    """
    lines = words_to_lines(words, tables).select("doc_id", "page", F.lit(0).alias("kind"), F.col("line").alias("seq"), F.bround("size", 1).alias("size"), "top", "text")
    own = tables.filter("doc_id is not null").select("doc_id", "page", F.lit(1).alias("kind"), F.col("n").cast("long").alias("seq"), table_text(F.col("cells")).alias("text")).filter("text is not null")
    document, page = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "page")
    rows = lines.unionByName(own, allowMissingColumns=True).withColumns({"body": F.mode("size", True).over(document), "first": F.min("kind").over(document)}).filter("first = 0")
    larger = F.col("doc_id").isNotNull() & F.col("page").isNotNull() & (F.col("size") > F.col("body"))
    level = F.when(F.col("kind") == 1, 0).when(larger, F.dense_rank().over(page.orderBy(F.desc("size")))).cast("long")  # a table stands alone, as a heading does
    blocks = merged(rows.withColumn("level", level).drop("size", "body", "first"), ["doc_id", "page", "kind"])
    place = F.row_number().over(document.orderBy("page", "kind", "ord")).cast("long") - 1
    return blocks.select("doc_id", place.alias("ord"), "page", F.when(F.col("kind") == 1, "table").otherwise(F.col("type")).alias("type"), "level", "text")


def without_lines(words: DataFrame, tables: DataFrame, documents: DataFrame) -> DataFrame:
    """Of `documents` (doc_id) those without a line outside tables: an error of the document."""
    return documents.select("doc_id").join(outside_tables(words, tables).filter(collapse(F.col("text")) != "").select("doc_id"), "doc_id", "left_anti")


def table_text(rows: Column) -> Column:
    """array<array<string>> to lines of cells joined by bars; rows without text are dropped; null if none is left."""
    cells = F.transform(rows, lambda r: F.transform(r, lambda c: collapse(F.coalesce(c, F.lit("")))))
    kept = F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))
    return F.nullif(F.array_join(F.transform(kept, lambda r: F.array_join(r, " | ")), "\n"), F.lit(""))


def sampled_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, chars): mean characters of the first, middle and last of the pages (doc_id, page from 1, chars)."""
    n = pages.groupBy("doc_id").agg(F.max("page").alias("n"))
    p = pages.join(n, "doc_id")
    return p.filter((F.col("page") == 1) | (F.col("page") == F.floor(F.col("n") / 2) + 1) | (F.col("page") == F.col("n"))).groupBy("doc_id").agg(F.avg("chars").alias("chars"))

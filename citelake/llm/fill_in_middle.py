"""Fill-in-middle: texts cut at two boundaries of units and put together again with the middle last.

A text is decoded to an array of UTF-32 code points. Each code point has a class; units end where neighbouring classes differ. The
boundaries come out of one comparison of the array with itself, shifted, and two of them are chosen by rank.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
NEWLINE = 10


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def line_classes(points: np.ndarray) -> np.ndarray:
    """Lines: the number of line ends before each code point, so that a line end belongs to its line."""
    ends = points == NEWLINE
    return np.cumsum(ends, dtype=np.int64) - ends


def word_classes(points: np.ndarray) -> np.ndarray:
    """Words and what stands between them: whether each code point is ASCII white space."""
    return (points == 32) | ((points >= 9) & (points <= 13))


UNITS = {"line": line_classes, "word": word_classes}


def boundaries(points: np.ndarray, unit: str = "line") -> np.ndarray:
    """Where units may be cut: 0, each place between code points of different classes, and the end. A text of n units has n + 1."""
    if not len(points):
        return np.zeros(1, np.int64)
    kind = UNITS[unit](points)
    return np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(points)]])


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that depend on the seed and the id alone; no id counts as the empty text."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))


def transform(text: str, doc_id: int | None, seed: int, unit: str, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix_chars, middle_chars, output) of one text."""
    points = code_points(text)
    cuts = boundaries(points, unit)
    n = len(cuts) - 1
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not n or h3 % 100 >= rate or any(s in text for s in SENTINELS):
        return n, "plain", None, None, text
    a, b = (int(cuts[i]) for i in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = (x.tobytes().decode("utf-32-le") for x in (points[:a], points[a:b], points[b:]))
    p, s, m = SENTINELS
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 7, unit: str = "line", rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for each row of `docs` (doc_id, text).

    n: units of the text, lines with their ends or runs of words and white space. form: plain (output is the text), psm (prefix, suffix,
    middle) or spm (suffix, prefix, middle), each piece behind its sentinel. rate: per cent of texts that are transformed; spm_rate: per
    cent of these in spm form. Texts that are null or empty, or hold a sentinel, are plain. What a row becomes depends on its id, its text
    and the parameters alone: rows without an id are drawn as one, equal rows give equal results, and each row is kept. A text is
    held as one array, whatever its length. Other columns are ignored. An empty table gives no rows.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            out = [transform(t or "", i, seed, unit, rate, spm_rate) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, types, strict=True)]
            yield pa.record_batch([batch.column("doc_id"), *cols], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that `output` was made from. Pieces hold no sentinel, and none can arise where pieces meet, so each is found at its first place."""
    p, s, m = SENTINELS
    after = lambda mark: F.substring(output, F.locate(mark, output) + len(mark), F.length(output))
    upto = lambda part, mark: F.substring(part, F.lit(1), F.locate(mark, part) - 1)
    psm = F.concat(upto(after(p), s), after(m), upto(after(s), m))
    spm = F.concat(upto(after(p), m), after(m), upto(after(s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT *, length(t) - length(replace(t, chr(10), '')) + CASE WHEN t <> '' AND right(t, 1) <> chr(10) THEN 1 ELSE 0 END AS n, string_split(t, chr(10)) AS l FROM d),
r AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS h1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS h2, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM u),
c AS (SELECT *, CASE WHEN least(h1, h2) = n THEN length(t) ELSE coalesce(list_sum(list_transform(l[1:least(h1, h2)], lambda x: length(x) + 1)), 0) END AS a,
    CASE WHEN greatest(h1, h2) = n THEN length(t) ELSE coalesce(list_sum(list_transform(l[1:greatest(h1, h2)], lambda x: length(x) + 1)), 0) END AS b FROM r),
o AS (SELECT *, CASE WHEN plain THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form, t[1:a] AS p, t[a + 1:b] AS m, t[b + 1:] AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN NOT plain THEN a END AS BIGINT) AS prefix_chars, CAST(CASE WHEN NOT plain THEN b - a END AS BIGINT) AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""

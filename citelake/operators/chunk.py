"""Parent and child chunks with exact offsets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import child_id, parent_id
from .fold import folded

# Token bounds of a parent and the size from which a child closes.
LOWER, UPPER, CHILD = 1000, 2000, 300


def stepper(lower: int, upper: int, target: int) -> Callable[[tuple, tuple], tuple[tuple, tuple]]:
    """The step of `place`: from (parent, its tokens, child, its tokens, offset) and a block's (type, text, tok) to the next state and the block's (parent, child, start, end). It begins with five zeros."""
    if lower > upper:
        raise ValueError("lower bound over upper bound")

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        parent, total, child, tokens, at = state
        kind, text, tok = row
        if kind == "heading" and at and total >= lower:
            parent, total, child, tokens, at = parent + 1, 0, 0, 0, 0
        values = parent, child, at, at + len(text)
        total, tokens, at = total + tok, tokens + tok, at + len(text) + 1
        if tokens >= target:
            child, tokens = child + 1, 0
        return ((parent + 1, 0, 0, 0, 0) if total >= upper else (parent, total, child, tokens, at)), values

    return step


def place(blocks: DataFrame, lower: int = LOWER, upper: int = UPPER, target: int = CHILD) -> DataFrame:
    """Adds parent, from 0 in each document, child, from 0 in each parent, and the block's [start, end) in the parent text, whose blocks are joined by newlines, to `blocks` (doc_id, ord, type, level, text, tok).

    Before a heading an open parent of `lower` tokens or more closes; after a block one of `upper` tokens or more does, so the upper bound is soft. A child closes from `target` tokens on.
    A group's own history decides where it ends, so this is a fold in order, not a window.
    """
    return folded(blocks, ["doc_id"], ["ord"], ["type", "text", "tok"], (0, 0, 0, 0, 0), stepper(lower, upper, target), {"parent": "long", "child": "long", "start": "long", "end": "long"})


def split_parents(blocks: DataFrame, lower: int = LOWER, upper: int = UPPER) -> DataFrame:
    """Adds parent, as `place` does."""
    return place(blocks, lower, upper).drop("child", "start", "end")


def joined(text: str = "text", order: str = "ord") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")


def words(c: Column) -> Column:
    """Default tokenizer: parts between single spaces and line ends."""
    return F.size(F.split(c, "[ \n]")).cast("long")


def counter(count: Callable[[list[str]], list[int]]) -> Callable[[Column], Column]:
    """A tokenizer for `chunks` from a function that counts the tokens of a list of texts, called with an Arrow batch at a time."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(count(texts.tolist()))

    return run


def chunks(blocks: DataFrame, lower: int = LOWER, upper: int = UPPER, target: int = CHILD, tokens=words) -> DataFrame:
    """chunk_id, doc_id, parent_id, level, chunk_index, text, token_count, start, end. Tokens are counted again on the joined text; children are numbered on across a document's parents.

    Blocks (doc_id, ord, type, text, tok) pass once and in order, in one shuffle, and a chunk leaves where it closes: a task holds one open parent.
    """
    step, begin = stepper(lower, upper, target), (0, 0, 0, 0, 0)
    kind, reads = dict(blocks.dtypes)["doc_id"], ["doc_id", "type", "text", "tok"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at, n, texts, own, found = begin, None, 0, [], [], []  # at: document, parent and child that are open

        def close(parent: bool) -> None:
            nonlocal n
            if own:
                found.append((at[0], "child", at[1], n, "\n".join(x[0] for x in own), own[0][1], own[-1][2]))
                n += 1
                own.clear()
            if parent and texts:
                found.append((at[0], "parent", at[1], at[1], "\n".join(texts), None, None))
                texts.clear()

        def closed(keys: pa.DataType) -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else [()] * 7
            types = [keys, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            out = pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "level", "parent", "n", "text", "start", "end"])
            found.clear()
            return out

        keys = None
        for batch in batches:
            keys = batch.schema.field("doc_id").type
            for key, *row in zip(*(batch.column(c).to_pylist() for c in reads), strict=True):
                if at is None or key != at[0]:
                    close(True)
                    state, n = begin, 0
                state, (parent, child, a, b) = step(state, tuple(row))
                if (key, parent, child) != at:
                    close(at is not None and parent != at[1])
                at = key, parent, child
                texts.append(row[1])
                own.append((row[1], a, b))
            yield closed(keys)
        if at:
            close(True)
            yield closed(keys)

    c = blocks.select(*reads, "ord").repartition("doc_id").sortWithinPartitions("doc_id", "ord").mapInArrow(run, f"doc_id {kind}, level string, parent long, n long, text string, start long, end long")
    parent, child = F.col("level") == "parent", F.col("level") == "child"
    its = parent_id(F.col("doc_id"), F.col("parent"))
    return c.select(F.when(parent, its).otherwise(child_id(F.col("doc_id"), F.col("n"))).alias("chunk_id"), "doc_id", F.when(child, its).alias("parent_id"), "level", F.col("n").alias("chunk_index"), "text", tokens(F.col("text")).alias("token_count"), "start", "end")


def cut(blocks: DataFrame, lower: int = LOWER, upper: int = UPPER, target: int = CHILD) -> DataFrame:
    """doc_id, level, chunk_index, parent, text, start, end, error: the chunks that `chunks` makes, without their ids and counts, of `blocks` (doc_id, ord from 0, type, text, tok, error) whose documents already lie together and in order, as exploded lists do. Nothing is shuffled; a task holds one document.

    A document with an error has no chunks, but a row with the first error and no level. parent: the number of a child's parent.
    """
    step, start = stepper(lower, upper, target), (0, 0, 0, 0, 0)
    names, types = ["level", "chunk_index", "parent", "text", "start", "end", "error"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def made(rows: list[tuple]) -> list[tuple]:
        wrong = next((e for *_, e in rows if e is not None), None)
        if wrong is not None:
            return [(None, None, None, None, None, None, wrong)]
        state, parents, children = start, {}, {}
        for kind, text, tok, _ in rows:
            state, (parent, child, a, b) = step(state, (kind, text, tok))
            parents.setdefault(parent, []).append(text)
            children.setdefault((parent, child), []).append((text, a, b))
        return [("parent", p, None, "\n".join(texts), None, None, None) for p, texts in parents.items()] + [("child", n, p, "\n".join(x[0] for x in own), own[0][1], own[-1][2], None) for n, ((p, _), own) in enumerate(children.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, kind = None, [], None

        def table(docs: list[tuple]) -> pa.RecordBatch:
            found = [(key, *row) for key, own in docs for row in made(own)]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [()] * 8, [kind, *types], strict=True)], ["doc_id", *names])

        for batch in batches:
            kind, ended = batch.schema.field("doc_id").type, []
            for key, n, *row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ord", "type", "text", "tok", "error")), strict=True):
                if n == 0 and rows:
                    ended.append((last, rows))
                    rows = []
                last = key
                rows.append(tuple(row))
            yield table(ended)
        if rows:
            yield table([(last, rows)])

    return blocks.mapInArrow(run, f"doc_id {dict(blocks.dtypes)['doc_id']}, level string, chunk_index long, parent long, text string, start long, end long, error string")


def violations(all_chunks: DataFrame) -> DataFrame:
    """Chunks that break an invariant, with its name: a parent has no parent and no offsets; a child has both, end after start, and is that slice of its parent's text; tokens are positive."""
    p = all_chunks.filter("level = 'parent'").select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text"))
    c = all_chunks.join(p, "parent_id", "left")
    child = F.col("level") == "child"
    wrong = F.when(F.col("token_count") <= 0, "tokens").when(~child & (F.col("parent_id").isNotNull() | F.col("start").isNotNull() | F.col("end").isNotNull()), "parent fields").when(child & (F.col("parent_text").isNull() | F.col("start").isNull() | F.col("end").isNull()), "child fields")
    wrong = wrong.when(child & (F.col("end") <= F.col("start")), "order").when(child & (F.substring(F.col("parent_text"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")) != F.col("text")), "slice")
    return c.withColumn("violation", wrong).filter("violation is not null").select("chunk_id", "violation")

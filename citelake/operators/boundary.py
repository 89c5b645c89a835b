"""The error boundary: what a parser, tokenizer or encoder raises for a row stays with that row, as data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of a message that are kept.
MESSAGE = 200


def message(e: Exception) -> str:
    return f"{type(e).__name__}: {str(e)[:MESSAGE]}"


def guarded(rows: DataFrame, call: Callable[[pa.RecordBatch], list[list]], out: dict[str, str], batch: int = 64, reads: list[str] | None = None, keeps: list[str] | None = None, alone: bool = False) -> DataFrame:
    """`rows` (of their columns `keeps`, all unless given) with the columns `out` (name: type as DDL) and error, null where all is well.

    call: gets `batch` rows at most (of the columns `reads`, all unless given) and gives a list of values for each of `out`, one for each row. If it raises, or gives another number of
    values, its rows are halved and called again, so that only the rows that break alone get the error, and nulls; others get what they get without them. So a
    call must not depend on what else is in its batch. alone: rows are called one by one from the start, for a function that takes one at a time and gains nothing from others: halving would do their work again. Memory errors and the like end the task, as they are not the row's.
    """
    if set(rows.columns) & {*out, "error"}:
        raise ValueError("rows have a column that is to be added")
    names = rows.columns if keeps is None else keeps
    kinds_of = dict(rows.dtypes)
    types = [f"`{c}` {kinds_of[c]}" for c in names]
    schema = ", ".join([*types, *(f"{c} {t}" for c, t in out.items()), "error string"])

    def tried(part: pa.RecordBatch) -> tuple[list[list], list[str | None]]:
        n = part.num_rows
        try:
            values = [list(v) for v in call(part)]
            if len(values) != len(out) or any(len(v) != n for v in values):
                raise ValueError(f"{n} rows, but {', '.join(str(len(v)) for v in values)} values")
            return values, [None] * n
        except MemoryError:
            raise
        except Exception as e:
            if n == 1:
                return [[None] for _ in out], [message(e)]
            one, two = tried(part.slice(0, n // 2)), tried(part.slice(n // 2))
            return [a + b for a, b in zip(one[0], two[0], strict=True)], one[1] + two[1]

    def each(part: pa.RecordBatch) -> tuple[list[list], list[str | None]]:
        rows = [tried(part.slice(i, 1)) for i in range(part.num_rows)]
        return [[values[k][0] for values, _ in rows] for k in range(len(out))], [errors[0] for _, errors in rows]

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kinds = [to_arrow_type(f.dataType) for f in StructType.fromDDL(", ".join(f"{c} {t}" for c, t in out.items()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                values, errors = (each if alone else tried)(part.select(reads) if reads else part)
                yield pa.record_batch([*(part.column(c) for c in names), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True)), pa.array(errors, pa.string())], [*names, *out, "error"])

    return rows.mapInArrow(run, schema)

"""Ordered folds: what a row gets depends on the rows before it in ways that a window cannot say."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TYPES = {"long": pa.int64(), "boolean": pa.bool_()}


def folded(rows: DataFrame, keys: list[str], order: list[str], reads: list[str], start: tuple, step: Callable[[tuple, tuple], tuple[tuple, tuple]], out: dict[str, str]) -> DataFrame:
    """`rows` with the columns `out` (name: long or boolean): step takes the state and the row's `reads` and gives the new state and the values.

    Rows of a key pass through one task in order, as a stream: the state is all that is held, and time grows in proportion to the rows.
    """
    names = rows.columns
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), *(f"{c} {t}" for c, t in out.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, start
        for batch in batches:
            found = []
            for key, row in zip(zip(*(batch.column(c).to_pylist() for c in keys), strict=True), zip(*(batch.column(c).to_pylist() for c in reads), strict=True), strict=True):
                if key != last:
                    last, state = key, start
                state, values = step(state, row)
                found.append(values)
            more = [pa.array(v, TYPES[t]) for v, t in zip(zip(*found, strict=True) if found else [()] * len(out), out.values(), strict=True)]
            yield pa.record_batch([*batch.columns, *more], [*names, *out])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)

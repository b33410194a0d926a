"""Ordered passes over the rows of each key that carry a small state and nothing else.

Chains, breakers and budgets depend on every row before: a key's rows are brought to one
task, sorted there by Spark (which spills), and streamed through once, so that a key's
history is never an array. Keys run side by side; one key's rows follow one another by
the meaning of these logs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import itemgetter
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Step = Callable[[Any, tuple], "tuple[Any, tuple | None]"]


def carry(rows: DataFrame, key: str | list[str], order: list[str], step: Step, schema: str, start: Any = None, end: Callable[[Any, Any], tuple] | None = None) -> DataFrame:
    """What ``step(state, row) -> (state, out)`` gives for the rows of each key in order, None giving nothing.

    ``row`` has the columns of ``rows``; a key begins with ``start``. With ``end``, each
    key gives one more row, end(key, state). A key of several columns is a tuple.
    """
    keys = [key] if isinstance(key, str) else key
    of = itemgetter(*(rows.columns.index(k) for k in keys))
    shape = shape_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: Any = None
        state, seen = start, False
        for b in batches:
            out = []
            for row in zip(*map(values, b.columns), strict=True):
                own = of(row)
                if not seen or own != last:
                    if seen and end is not None:
                        out.append(end(last, state))
                    last, state, seen = own, start, True
                state, told = step(state, row)
                if told is not None:
                    out.append(told)
            yield _batch(out, shape)
        if seen and end is not None:
            yield _batch([end(last, state)], shape)

    return ordered(rows, keys, order).mapInArrow(run, schema)


def ordered(rows: DataFrame, keys: list[str], order: list[str], clustered: bool = False) -> DataFrame:
    """The rows of each key in one partition, side by side and in order; ``clustered`` ones are in one partition already."""
    return (rows if clustered else rows.repartition(*keys)).sortWithinPartitions(*keys, *order)


def shape_of(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def values(column: pa.Array) -> list:
    """``to_pylist``, many times faster for strings and for numbers without nulls."""
    plain = pa.types.is_string(column.type) or (column.null_count == 0 and (pa.types.is_integer(column.type) or pa.types.is_boolean(column.type)))
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def _batch(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in shape]
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

"""Sequential folds over the rows of a key, for recurrences that no window frame expresses."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """Great-circle distance of two points."""
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def folded(rows: DataFrame, key: str, order: str, step: Callable, out: str) -> DataFrame:
    """(key, order, out) for each row of (key, order, ...): ``step(state, row)`` gives the next state and the value; the first state is None.

    ``row`` has all columns but the key. Rows are dealt by key and sorted, and stream through in Arrow batches: a ride of
    any length is never held whole, and a value costs the same wherever it stands in its ride.
    """
    names, kinds = rows.columns, dict(rows.dtypes)
    name, kind = out.split(" ")
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[kind]
    at, place = names.index(key), names.index(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, None, False
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            values = []
            rest = [c for i, c in enumerate(columns) if i != at]
            for k, *row in zip(columns[at], *rest):
                if not begun or k != now:
                    now, state, begun = k, None, True
                state, value = step(state, row)
                values.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(at), batch.column(place), pa.array(values, arrow)], names=[key, order, name])

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {out}")

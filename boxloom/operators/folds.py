"""Greedy folds over groups of boxes, on arrays.

Spark deals out and sorts the rows by group and order; a task takes whole groups from its batches, and all groups of a batch
take their next step together, so that a step costs a few array operations and memory is linear in the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

CORNERS = ("x1", "y1", "x2", "y2")
ROWS = 20_000  # that are folded together
FINE = 4  # times as many tasks, where a task sorts more than once: sorts that fit into memory leave nothing on disk


def group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Places of the rows whose keys differ from the row before; nulls are equal."""
    new = np.ones(table.num_rows, dtype=bool)
    new[1:] = False
    for k in keys:
        c = table[k].combine_chunks()
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with their starts, from batches that are sorted by the keys."""
    held, size, carried = [], 0, 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= max(ROWS, 2 * carried):
            table = pa.Table.from_batches(held).combine_chunks()
            starts = group_starts(table, keys)
            if len(starts) > 1:
                yield table.slice(0, starts[-1]), starts[:-1]
            rest = table.slice(starts[-1])
            held, size, carried = rest.to_batches(), rest.num_rows, rest.num_rows
    if size:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, group_starts(table, keys)


def dealt(rows: DataFrame, *keys: Column | str, times: int = 1) -> DataFrame:
    """The rows by hash of the keys, in as many tasks as a shuffle has, or so many times as many: small rows may be much work."""
    return rows.repartition(times * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def folded(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], fold: Callable, schema: str) -> DataFrame:
    """``fold(table, starts)``, a table of the schema, of whole groups in order; ``rows`` are dealt by the keys."""

    def run(batches):
        for table, starts in whole_groups(batches, keys):
            yield from fold(table, starts).to_batches()

    return rows.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def doubles(table: pa.Table, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of numbers for each name, and which rows lack any of them."""
    columns = [table[n].combine_chunks() for n in names]
    lack = np.any([c.is_null().to_numpy(zero_copy_only=False) for c in columns], axis=0)
    return np.array([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]), lack


def nullable(table: pa.Table, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of numbers for each name, and a row that says which are missing."""
    return doubles(table, names)[0], np.array([table[n].combine_chunks().is_null().to_numpy(zero_copy_only=False) for n in names])


def area(b: np.ndarray) -> np.ndarray:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As in SQL NaN is the greatest number: the least of it and another is the other."""
    w = np.maximum(0.0, np.fmin(a[2], b[2]) - np.maximum(a[0], b[0]))
    h = np.maximum(0.0, np.fmin(a[3], b[3]) - np.maximum(a[1], b[1]))
    return w * h


def ratio(a: np.ndarray, b: np.ndarray, lack: np.ndarray) -> np.ndarray:
    """a / b; 0 where b is 0 or less, or something is missing; infinite for NaN, which passes every limit."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(b <= 0, 0.0, a / b)
    out = np.where(np.isnan(out), np.inf, out)
    return np.where(lack, 0.0, out)


def iou(a: np.ndarray, b: np.ndarray, lack: np.ndarray) -> np.ndarray:
    inter = intersection(a, b)
    return ratio(inter, area(a) + area(b) - inter, lack)


def overlap_ratio(a: np.ndarray, a_none: np.ndarray, b: np.ndarray, b_none: np.ndarray) -> np.ndarray:
    """Intersection over the smaller area. As in SQL the least and the greatest pass over what is missing."""

    def side(low: int, high: int) -> np.ndarray:
        start = np.maximum(np.where(a_none[low], -np.inf, a[low]), np.where(b_none[low], -np.inf, b[low]))
        none = (a_none[low] & b_none[low]) | (a_none[high] & b_none[high])
        return np.where(none, 0.0, np.maximum(0.0, np.fmin(a[high], b[high]) - start))

    lack = [x.any(axis=0) for x in (a_none, b_none)]
    least = np.fmin(*[np.where(none, np.nan, area(x)) for none, x in zip(lack, (a, b))])
    return ratio(side(0, 2) * side(1, 3), least, lack[0] & lack[1])


def numbered(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The size of each group; the group and the place there of each row."""
    sizes = np.diff(np.append(starts, n))
    group = np.repeat(np.arange(len(starts)), sizes)
    return sizes, group, np.arange(n) - starts[group]


def binary(bits: np.ndarray) -> pa.Array:
    """Rows of booleans as rows of bytes."""
    data = np.packbits(bits, axis=1)
    offsets = np.arange(len(data) + 1, dtype=np.int32) * np.int32(data.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def bits(column: pa.Array, n: int) -> np.ndarray:
    """What ``binary`` made of rows of n booleans."""
    width = -(-n // 8)
    data = np.frombuffer(column.buffers()[2], np.uint8, len(column) * width, column.offset * width) if len(column) else np.zeros(0, np.uint8)
    return np.unpackbits(data.reshape(len(column), width), axis=1, count=n).astype(bool)

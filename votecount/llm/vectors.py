"""Columns of vectors as matrices of whole numbers, and sums over all rows of a table.

A vector takes part if it is not null and all its components are finite numbers whose scaled floor
is exact in a double. Missing trailing components count as zero, so vectors of several lengths, and
empty ones, have a defined result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers below this are exact in a double.
EXACT = 1 << 53
#: Groups in which the sums of tasks meet before the driver adds those up.
GROUPS = 256


def floors(vector: Column, scale: int) -> Column:
    """floor(scale * component) of every component as longs; NULL if the vector takes no part."""
    wide = vector.cast("array<double>")
    inside = F.forall(wide, lambda x: F.coalesce(F.abs(x) * scale < EXACT, F.lit(False)))
    return F.when(vector.isNotNull() & inside, F.transform(wide, lambda x: F.floor(x * scale)))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of lists of longs as one matrix, short rows filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of whole numbers, exact: by doubles where those are exact, else by Python's numbers."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if largest < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a.astype(object) @ b.astype(object)


def gathered(
    df: DataFrame,
    part: Callable[[Iterator[pa.RecordBatch]], list[str]],
    merge: Callable[[list[str]], str],
) -> str | None:
    """One text that sums up all rows, by way of one text per task and then per group of tasks.

    ``part`` makes the texts of one task (none, if it has no rows) and ``merge`` makes one of many.
    Tasks meet in ``GROUPS`` groups and those in the driver, which so sees that many texts at most,
    each of a size that the rows do not decide.
    """

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        slot = context.partitionId() % GROUPS if context else 0
        if texts := part(batches):
            yield pa.RecordBatch.from_pydict({"slot": [slot] * len(texts), "part": texts}, _PART)

    def together(found: pa.Table) -> pa.Table:
        return pa.table({"part": [merge(found.column("part").to_pylist())]})

    parts = df.mapInArrow(tasks, "slot int, part string").groupBy("slot").applyInArrow(together, "part string")
    texts = [r.part for r in parts.collect()]
    return merge(texts) if texts else None


_PART = pa.schema([("slot", pa.int32()), ("part", pa.string())])

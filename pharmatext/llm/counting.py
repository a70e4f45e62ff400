"""Sums of fixed-size arrays of counters over all rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE = 1 << 12
_SCHEMA = "slice int, part int, counts binary"


def _add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = np.zeros(SLICE, dtype=np.int64)
    for raw in table.column("counts"):
        total += np.frombuffer(raw.as_buffer(), dtype=np.int64)
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def summed(rows: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], size: int) -> np.ndarray:
    """The sum over all tasks of the arrays (``size`` integers) that ``count`` makes of each task's rows.

    Arrays are cut into slices that are summed in two steps, so no task or driver sees more than one
    array and 64 partial sums of a slice. Tasks without rows may give None.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = count(batches)
        if total is None:
            return
        parts = np.resize(np.append(total, np.zeros(-len(total) % SLICE, dtype=np.int64)), (-(-len(total) // SLICE), SLICE))
        part = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays([
            pa.array(range(len(parts)), pa.int32()), pa.array([part] * len(parts), pa.int32()), pa.array([p.astype(np.int64).tobytes() for p in parts], pa.binary()),
        ], names=["slice", "part", "counts"])

    some = rows.mapInArrow(local, _SCHEMA).groupBy("slice", "part").applyInArrow(_add, _SCHEMA)
    out = np.zeros(-(-size // SLICE) * SLICE, dtype=np.int64)
    for r in some.groupBy("slice").applyInArrow(_add, _SCHEMA).collect():  # one array in all
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], dtype=np.int64)
    return out[:size]

"""Rows as matrices of fixed width, one binary value per row, for scans that repeat often.

Tasks read them from Arrow's buffers without an object per row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a task at least, and at most.
TASK_ROWS, MOST_ROWS = 20_000, 1_000_000


def matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """The rows of a binary column without nulls as a matrix."""
    offset = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    if not len(column) or data is None:
        return np.empty((len(column), width), dtype=kind)
    start = int(np.frombuffer(ends, offset, 1, column.offset * np.dtype(offset).itemsize)[0])
    return np.frombuffer(data, kind, len(column) * width, start).reshape(-1, width)


def packed(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a matrix."""
    data = np.ascontiguousarray(rows)
    ends = np.arange(len(data) + 1, dtype=np.int64) * (data.itemsize * data.shape[1])
    made = pa.Array.from_buffers(pa.large_binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return made.cast(pa.binary())


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def batch_of(columns: dict[str, np.ndarray | pa.Array], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, types[n]) for n, c in columns.items()], list(columns))


def spread(df: DataFrame, rows: int, key: str) -> DataFrame:
    """`df`, of so many rows, dealt by its key to as many tasks as can run, if it is worth it."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / MOST_ROWS))
    return df.repartition(max(1, min(tasks, math.ceil(rows / TASK_ROWS))), key)

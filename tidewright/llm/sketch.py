"""Sums of fixed-size count tables over all rows of a DataFrame.

Each task folds its rows into one table and emits it once, cut into blocks and compressed; blocks are then added up in
a tree of bounded groups. What moves is (tasks x table size), whatever the number of rows, and no group holds more than
``FAN`` blocks of one task each, up to ``FAN ** 3`` tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 64
SCHEMA = "name string, block int, part long, data binary"


def packed(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values, np.int64).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int64)


def emit(tables: dict[str, np.ndarray], block: int) -> Iterator[pa.RecordBatch]:
    """The tables of one task as rows, ``block`` values each; blocks of zeros are left out."""
    part = TaskContext.get().partitionId()
    for name, values in tables.items():
        for k in range(0, len(values), block):
            if (cut := values[k:k + block]).any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name], pa.string()), pa.array([k // block], pa.int32()), pa.array([part], pa.int64()), pa.array([packed(cut)], pa.binary())],
                    names=["name", "block", "part", "data"])


def _added(group: pd.DataFrame) -> pd.DataFrame:
    total = unpacked(group["data"].iloc[0]).copy()
    for data in group["data"].iloc[1:]:
        total += unpacked(data)
    head = group.iloc[:1].copy()
    head["data"] = [packed(total)]
    return head


def total(partials: DataFrame) -> DataFrame:
    """One row per (name, block): the sum over all tasks."""
    for _ in range(2):
        partials = partials.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("name", "block", "part").applyInPandas(_added, SCHEMA)
    return partials.groupBy("name", "block").applyInPandas(_added, SCHEMA)


def collected(partials: DataFrame, size: int, block: int) -> dict[str, np.ndarray]:
    """The summed tables on the driver; their sizes are fixed by the caller, not by the data."""
    out: dict[str, np.ndarray] = {}
    for name, at, _, data in total(partials).collect():
        values = unpacked(data)
        out.setdefault(name, np.zeros(size, np.int64))[at * block:at * block + len(values)] = values
    return out

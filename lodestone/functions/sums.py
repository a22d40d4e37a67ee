"""Sums of arrays over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 4096  # numbers in a row
SCHEMA = "block int, x array<double>"


def blocks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a task has summed, as rows of BLOCK numbers."""
    cuts = np.append(np.arange(0, len(total), BLOCK), len(total)).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts) - 1, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.asarray(total, np.float64)))], ["block", "x"])


def summed(parts: DataFrame, n: int) -> np.ndarray:
    """n sums from the blocks() of all tasks, added up block by block on the cluster; only the sums come to the driver."""

    def add(rows: pa.Table) -> pa.Table:
        x = rows.column("x").combine_chunks()
        total = x.flatten().to_numpy().reshape(len(x), -1).sum(axis=0)
        return pa.table([rows.column("block").slice(0, 1), pa.array([total], pa.list_(pa.float64()))], ["block", "x"])

    out = np.zeros(n)
    for r in parts.groupBy("block").applyInArrow(add, SCHEMA).collect():
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(r["x"])] = r["x"]
    return out

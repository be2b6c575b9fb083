"""Sums of small arrays over a table: what iterative fits take once an iteration.

Parameters travel as data, so every iteration runs the same plan; each task adds up its rows by matrix products and
gives one row, and an aggregate adds those up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column, width: int) -> np.ndarray:
    """An array column's rows, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def summed(df: DataFrame, size: int, of) -> np.ndarray:
    """Sum over all batches of ``of(batch)``, arrays of ``size`` numbers; zeros over no rows."""

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += of(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    out = np.zeros(size)
    # ``size`` rows, whatever the table's size
    for r in df.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out

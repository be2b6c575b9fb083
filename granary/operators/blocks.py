"""Matrices cut into dense blocks, and their products.

A block matrix is a table ``bi, bj, rows, cols, data`` of blocks of at most ``size`` x ``size`` cells, row by row.  A
product deals the blocks into groups of GROUP x GROUP x GROUP: a group gets its share of either matrix, multiplies by
matrix products and gives a partial sum for each of its places, so that no group grows with the matrices.  Counted in
blocks, of I x K and K x J, with ceilings left out: ``I K J / GROUP`` are shuffled of the left matrix, ``K J I / GROUP``
of the right one, and up to ``I J K / GROUP`` partial sums, fewer where a task meets several groups of one place.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatch
from ..lineage import materialise

#: Cells along a block's side, and blocks along a group's.
SIZE, GROUP = 128, 4
#: Blocks of one Arrow batch (some 128 KB each).
BATCH = 64
_BLOCK = "bi int, bj int, rows int, cols int, data array<double>"


@contextmanager
def _batches(spark):
    """Jobs run inside move few blocks at once between Spark and Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _run(df: DataFrame, run, schema: str) -> DataFrame:
    with _batches(df.sparkSession):
        return materialise(df.mapInArrow(run, schema))


def _cells(batch: pa.RecordBatch, i: int) -> np.ndarray:
    """The i-th block of a batch that has ``rows, cols, data``."""
    at, data = batch.schema.get_field_index, batch.column(batch.schema.get_field_index("data"))
    return np.asarray(data[i].values).reshape(batch.column(at("rows"))[i].as_py(), batch.column(at("cols"))[i].as_py())


@dataclass
class BlockMatrix:
    """``blocks`` of a matrix of ``rows`` x ``cols`` cells; blocks that are left out are zero."""

    blocks: DataFrame
    rows: int
    cols: int
    size: int = SIZE

    @property
    def shape(self) -> tuple[int, int]:
        return self.rows, self.cols

    def grid(self) -> tuple[int, int]:
        """How many blocks the matrix has down and across."""
        return -(-self.rows // self.size), -(-self.cols // self.size)

    def transpose(self) -> BlockMatrix:
        swapped = F.flatten(F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda j: F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.get("data", i * F.col("cols") + j))))
        blocks = self.blocks.withColumn("data", swapped).toDF("bj", "bi", "cols", "rows", "data")
        return BlockMatrix(blocks.select("bi", "bj", "rows", "cols", "data"), self.cols, self.rows, self.size)

    def coordinates(self) -> DataFrame:
        """``i, j, v`` of the cells of all blocks that are there."""
        cells = self.blocks.select("bi", "bj", "cols", F.posexplode("data").alias("p", "v"))
        return cells.select((F.col("bi").cast("long") * self.size + F.expr("p div cols")).alias("i"), (F.col("bj").cast("long") * self.size + F.expr("p % cols")).alias("j"), "v")

    def packed(self) -> DataFrame:
        """``row_id, features``: whole rows, zeros where a block is missing."""
        across = self.grid()[1]
        of = self.blocks.select(
            "bi", "bj", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.slice("data", i * F.col("cols") + 1, F.col("cols")))).alias("at", "part")
        )
        parts = of.groupBy((F.col("bi").cast("long") * self.size + F.col("at")).alias("row_id")).agg(F.map_from_entries(F.collect_list(F.struct("bj", "part"))).alias("m"))
        width = lambda b: F.least(F.lit(self.size), F.lit(self.cols) - b * self.size)
        whole = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda b: F.coalesce(F.element_at("m", b), F.array_repeat(F.lit(0.0), width(b)))))
        return parts.select("row_id", whole.alias("features"))

    def times(self, other: BlockMatrix) -> BlockMatrix:
        """The product; inner sizes that differ, or blocks of other sizes, are an error."""
        if self.cols != other.rows or self.size != other.size:
            raise DimensionMismatch(f"{self.shape} in blocks of {self.size} and {other.shape} in blocks of {other.size} don't go together")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-n // GROUP) - 1))))
        down, across = self.grid()[0], other.grid()[1]
        cell = lambda c: F.floor(F.col(c) / GROUP).cast("int")
        cols = ["gi", "gj", "gk", "side", "bi", "bj", "rows", "cols", "data"]
        left = self.blocks.withColumns({"gi": cell("bi"), "gk": cell("bj"), "side": F.lit(0)}).withColumn("gj", every(across)).select(*cols)
        right = other.blocks.withColumns({"gj": cell("bj"), "gk": cell("bi"), "side": F.lit(1)}).withColumn("gi", every(down)).select(*cols)
        groups = left.unionByName(right).repartition("gi", "gj", "gk").sortWithinPartitions("gi", "gj", "gk", "side")

        def multiply(batches):
            place, group, own, sums = None, None, {}, {}
            for b in batches:
                gi, gj, gk, side, bi, bj = (b.column(i).to_pylist() for i in range(6))
                for n in range(b.num_rows):
                    if (gi[n], gj[n]) != place:
                        yield from _blocks_of(sums)
                        place, sums = (gi[n], gj[n]), {}
                    if (gi[n], gj[n], gk[n]) != group:
                        group, own = (gi[n], gj[n], gk[n]), {}
                    x = _cells(b, n)
                    if side[n] == 0:
                        own.setdefault(bj[n], []).append((bi[n], x))
                        continue
                    for i, y in own.get(bi[n], ()):
                        key = i, bj[n]
                        sums[key] = sums[key] + y @ x if key in sums else y @ x
            yield from _blocks_of(sums)

        partial = _run(groups, multiply, _BLOCK)

        def add(batches):
            key, total = None, None
            for b in batches:
                for n, k in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                    if k == key:
                        total = total + _cells(b, n)
                    else:
                        if key:
                            yield from _blocks_of({key: total})
                        key, total = k, _cells(b, n)
            if key:
                yield from _blocks_of({key: total})

        total = _run(partial.repartition("bi", "bj").sortWithinPartitions("bi", "bj"), add, _BLOCK)
        return BlockMatrix(total, self.rows, other.cols, self.size)


def _blocks_of(sums: dict[tuple[int, int], np.ndarray]):
    """A batch of blocks by their places; none for none."""
    if sums:
        ints = [[k[0] for k in sums], [k[1] for k in sums], [x.shape[0] for x in sums.values()], [x.shape[1] for x in sums.values()]]
        data = pa.array([x.ravel() for x in sums.values()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in ints), data], names=["bi", "bj", "rows", "cols", "data"])


def from_packed(rows: DataFrame, size: int = SIZE) -> BlockMatrix:
    """From ``row_id, features`` with row_ids 0, 1, ... and vectors of one length; other row_ids, or lengths, are an error.

    A row is cut into slices first, so a block's group has at most ``size`` slices of ``size`` cells.  No rows give a
    matrix of 0 x 0.
    """
    rows = rows.select(F.col("row_id").cast("long").alias("row_id"), F.col("features").cast("array<double>").alias("features"))
    n, distinct, low, high, narrow, wide = rows.agg(F.count(F.lit(1)), F.count_distinct("row_id"), F.min("row_id"), F.max("row_id"), F.min(F.size("features")), F.max(F.size("features"))).first()
    if n and (distinct != n or low != 0 or high != n - 1 or narrow != wide or not narrow):
        raise DimensionMismatch("Rows must be numbered from 0 without gaps, and of one length")
    across = -(-(wide or 0) // size)
    parts = rows.withColumn("bj", F.explode(F.sequence(F.lit(0), F.lit(max(0, across - 1)))))
    parts = parts.select((F.col("row_id") % size).cast("int").alias("at"), F.expr(f"CAST(row_id div {size} AS INT)").alias("bi"), "bj", F.slice("features", F.col("bj") * size + 1, F.lit(size)).alias("part"))
    blocks = parts.groupBy("bi", "bj").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("p"))
    blocks = blocks.select("bi", "bj", F.size("p").alias("rows"), F.size(F.col("p")[0]["part"]).alias("cols"), F.flatten(F.transform("p", lambda x: x["part"])).alias("data"))
    return BlockMatrix(blocks, n, wide or 0, size)


def from_coordinates(cells: DataFrame, rows: int, cols: int, size: int = SIZE) -> BlockMatrix:
    """From ``i, j, v`` of the cells that are not zero, each place once; cells outside the shape are an error."""
    outside = cells.where((F.col("i") < 0) | (F.col("i") >= rows) | (F.col("j") < 0) | (F.col("j") >= cols))
    if not outside.isEmpty():
        raise DimensionMismatch(f"A cell lies outside {rows} x {cols}")
    side = lambda b, n: F.least(F.lit(size), F.lit(n) - F.col(b) * size).cast("int")
    placed = cells.select(F.expr(f"CAST(i div {size} AS INT)").alias("bi"), F.expr(f"CAST(j div {size} AS INT)").alias("bj"), (F.col("i") % size).alias("li"), (F.col("j") % size).alias("lj"), F.col("v").cast("double").alias("v"))
    placed = placed.withColumns({"rows": side("bi", rows), "cols": side("bj", cols)})
    entry = F.struct((F.col("li") * F.col("cols") + F.col("lj")).cast("int").alias("p"), "v")
    blocks = placed.groupBy("bi", "bj", "rows", "cols").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.col("rows") * F.col("cols") - 1), lambda p: F.coalesce(F.element_at("m", p), F.lit(0.0)))
    return BlockMatrix(blocks.select("bi", "bj", "rows", "cols", dense.alias("data")), rows, cols, size)

"""Connected components by local contraction, then alternating large-star and small-star steps (Kiveris et al., 2014)
until what is left fits one chunk of contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import materialise

#: Edges that a task contracts at once.
CHUNK = 100_000


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _forest(us: list[int], vs: list[int]) -> dict[int, int]:
    """Each node that isn't the smallest of its component, with the smallest."""
    up: dict[int, int] = {}

    def find(x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for u, v in zip(us, vs):
        a, b = find(u), find(v)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def contracted(edges: DataFrame) -> DataFrame:
    """Edges ``u > v`` that connect what the given ones do: some of a task's edges at a time become stars."""

    def run(batches):
        us, vs = [], []

        def stars():
            found = {x: r for x, r in _forest(us, vs).items() if x != r}
            us.clear()
            vs.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["u", "v"])

        for b in batches:
            us += b.column(0).to_pylist()
            vs += b.column(1).to_pylist()
            if len(us) >= CHUNK:
                yield stars()
        yield stars()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` (long) to ``(node, root)``: root is the smallest node that can be reached; a root itself has no row.

    Minima are partial aggregates, and they are joined to the edges as written tables, so that adaptive execution can
    split a hub's edges over tasks (or broadcast the minima); the number of rounds grows with the logarithm of the
    longest path that is left after contraction.  Every round is checkpointed.  Once CHUNK edges at most are left, they are
    contracted at once instead: a round is nineteen stages, whatever it holds.  Nodes without an edge are not returned.
    Loops, repeated edges and edges with a null end are ignored; no edges give no rows.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(contracted(edges).distinct())
    before = _signature(edges)
    while before[0] > CHUNK:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialise(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        pairs = large.join(least, "u")
        small = pairs.select("u", F.col("m").alias("v")).unionByName(
            pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        edges = materialise(small.where("u <> v").distinct())
        after = _signature(edges)
        if after == before:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        before = after
    return contracted(edges.coalesce(1)).select(F.col("u").alias("node"), F.col("v").alias("root"))

"""Hierarchical clustering by single linkage, up to a height, with cuts.

Single linkage merges along the edges of a minimum spanning forest of the points that are within ``height`` of each
other.  Points lie in a grid of cells of that width; a cell's points, in chunks of CHUNK, meet the chunks of the same
and of neighbouring cells.  A task keeps the minimum spanning forest of the pairs that its meetings give and no other pair:
an edge that is the largest of a circle in there is no edge of the whole forest either.  So what leaves a task grows
with its points, not with their square; the distances looked at are those of pairs of chunks within reach, which is
inherent in a height that spans many points.  Borůvka's rounds make the whole forest of these edges: every tree takes its
least edge to another, trees that are joined become one by connected components, and of the edges between two trees the
least stays; what is left once they are FEW takes no more rounds but one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameter, NotFitted
from ..lineage import materialise
from ..operators.blocks import _batches
from ..operators.components import _forest, connected_components
from .density import _moved, box, gridded, shifts, usable

#: Points of a cell that one task holds of either side.
CHUNK = 256


#: Edges that a task holds before it reduces them to their forest.
HELD = 500_000
#: Edges up to which one task makes the forest, or the clusters; more go through rounds of jobs.
FEW = 500_000


def least_forest(a: np.ndarray, b: np.ndarray, u: np.ndarray, v: np.ndarray, height: np.ndarray) -> np.ndarray:
    """The places of the edges of the minimum spanning forest over nodes a and b, by Borůvka's rounds; equal heights are
    ordered by u and v."""
    order = np.lexsort((v, u, height))
    nodes, ends = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    one, two = ends[: len(order)], ends[len(order) :]
    tree, taken, left = np.arange(len(nodes)), [], np.arange(len(order))
    while True:
        ta, tb = tree[one[left]], tree[two[left]]
        apart = ta != tb
        left, ta, tb = left[apart], ta[apart], tb[apart]
        if not len(left):
            return order[np.concatenate(taken)] if taken else order[:0]
        first = np.full((2, len(nodes)), len(order))
        first[0, ta[::-1]] = first[1, tb[::-1]] = left[::-1]  # of a tree's edges the least is set last
        first = first.min(axis=0)
        has = np.flatnonzero(first < len(order))
        taken.append(np.unique(first[has]))
        to = np.arange(len(nodes))
        to[has] = tree[one[first[has]]] + tree[two[first[has]]] - has
        to = np.where((to[to] == np.arange(len(nodes))) & (to > np.arange(len(nodes))), np.arange(len(nodes)), to)
        while not np.array_equal(further := to[to], to):
            to = further
        tree = to[tree]


def within(ids: np.ndarray, x: np.ndarray, ids2: np.ndarray, x2: np.ndarray, height: float, own: bool) -> tuple[np.ndarray, ...]:
    """Pairs ``u < v, length`` of one side's points with the other's (or with the same side's) up to the height."""
    d = np.zeros((len(ids), len(ids2)))
    for j in range(x.shape[1]):
        d += (x[:, j, None] - x2[None, :, j]) ** 2
    d = np.sqrt(d)
    near = d <= height
    i, j = np.nonzero(np.triu(near, 1) if own else near)
    return np.minimum(ids[i], ids2[j]), np.maximum(ids[i], ids2[j]), d[i, j]


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest ``u, v, height`` of edges ``u, v, height``; equal heights are ordered by u and v, so
    that it is the only one.

    Loops are ignored, repeated edges count once; no edges give no rows.
    """
    edges = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "height").distinct()
    open_, taken = materialise(edges.withColumns({"a": F.col("u"), "b": F.col("v")})), None
    while (count := open_.count()) > FEW:
        ends = open_.withColumn("tree", F.explode(F.array("a", "b")))
        best = ends.groupBy("tree").agg(F.min(F.struct("height", "u", "v", "a", "b")).alias("e"))
        best = materialise(best.select("e.*").distinct())
        taken = best if taken is None else taken.unionByName(best)
        roots = materialise(connected_components(best.select(F.col("a").alias("u"), F.col("b").alias("v"))))
        one, two = roots.toDF("a", "ra"), roots.toDF("b", "rb")
        merged = open_.join(one, "a", "left").join(two, "b", "left")
        merged = merged.select("u", "v", "height", F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")
        least = merged.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("height", "u", "v")).alias("e"))
        open_ = materialise(least.select("e.*", "a", "b"))
    if count:
        last = open_.select("a", "b", "u", "v", "height").coalesce(1).mapInArrow(_last, "u long, v long, height double")
        taken = last if taken is None else taken.select("u", "v", "height").unionByName(last)
    return edges if taken is None else taken.select("u", "v", "height")


def _clusters(forest: DataFrame) -> DataFrame:
    """``node, root`` of edges ``u, v`` as ``connected_components`` gives them."""
    if forest.count() > FEW:
        return connected_components(forest)

    def run(batches):
        us, vs = [], []
        for b in batches:
            us += b.column(0).to_pylist()
            vs += b.column(1).to_pylist()
        found = {x: r for x, r in _forest(us, vs).items() if x != r}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["node", "root"])

    return forest.coalesce(1).mapInArrow(run, "node long, root long")


def _edges(u, v, height) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(height, pa.float64())], names=["u", "v", "height"])


def _last(batches):
    cols = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    if cols:
        cols = [np.concatenate(c) for c in zip(*cols)]
        at = least_forest(*cols)
        yield _edges(*(c[at] for c in cols[2:]))


@dataclass
class SingleLinkage:
    """Merges of points up to a height, the Euclidean distance at which two clusters become one."""

    height: float
    rows: DataFrame | None = None
    forest: DataFrame | None = None

    def __post_init__(self):
        if not (self.height > 0 and math.isfinite(self.height)):
            raise InvalidParameter("height must be positive and finite")

    def fit(self, packed: DataFrame, row_id: str = "row_id", features: str = "features") -> SingleLinkage:
        """Rows with equal vectors merge at height 0, along the smallest row_id of them.

        Rows without a row_id, or whose vector is null or empty or holds a null, NaN or infinity, are left out of every
        merge; row_ids that repeat are one point of several places; vectors of several lengths, or of over four numbers,
        are an error.
        """
        rows, good, dims = usable(packed, row_id, features)
        good = materialise(good)
        points = materialise(good.groupBy("x").agg(F.min("row_id").alias("pid")))
        same = good.join(points, "x").where("row_id <> pid").select(F.col("pid").alias("u"), F.col("row_id").alias("v"), F.lit(0.0).alias("height"))
        width = self.height * (1 + 1e-9)
        points = gridded(points, width, dims).withColumn("cell", box(0))
        sizes = materialise(points.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("int").alias("of")))
        # chunks by hash: at most twice CHUNK, as good as always
        chunk = F.pmod(F.xxhash64("pid"), F.col("of")).cast("int")
        chunks = points.join(sizes, "cell").groupBy("cell", chunk.alias("chunk")).agg(F.collect_list("pid").alias("ids"), F.flatten(F.collect_list("x")).alias("xs"))
        chunks = materialise(chunks)
        places = chunks.select("cell", "chunk")
        other = places.toDF("cell2", "chunk2")
        near = places.withColumn("o", F.explode(shifts(dims, 1.0, True))).select("cell", "chunk", _moved("cell", "o").alias("cell2")).join(other, "cell2")
        own = places.join(other, F.col("cell") == F.col("cell2")).where("chunk <= chunk2")
        pairs = near.unionByName(own).select("cell", "chunk", "cell2", "chunk2")
        met = pairs.join(chunks, ["cell", "chunk"]).join(chunks.toDF("cell2", "chunk2", "ids2", "xs2"), ["cell2", "chunk2"])
        met = met.select("ids", "xs", "ids2", "xs2", ((F.col("cell") == F.col("cell2")) & (F.col("chunk") == F.col("chunk2"))).alias("own"))

        height = self.height

        def run(batches):
            held, n = [], 0

            def forest():
                u, v, h = (np.concatenate(c) for c in zip(*held))
                at = least_forest(u, v, u, v, h)
                return u[at], v[at], h[at]

            for b in batches:
                for i in range(b.num_rows):
                    ids, xs, ids2, xs2 = (np.asarray(b.column(j)[i].values) for j in range(4))
                    held.append(within(ids, xs.reshape(-1, dims), ids2, xs2.reshape(-1, dims), height, b.column(4)[i].as_py()))
                    n += len(held[-1][0])
                    if n > HELD:
                        held[:] = [forest()]
                        n = len(held[0][0])
                        if 2 * n > HELD:
                            yield _edges(*held.pop())
                            n = 0
            if held:
                yield _edges(*forest())

        # as many tasks as shuffles have: what is read is little for what is computed of it
        met = met.repartition(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ids", "ids2")
        with _batches(packed.sparkSession):
            edges = materialise(met.mapInArrow(run, "u long, v long, height double"))
        self.rows = rows.select("row_id")
        self.forest = materialise(spanning_forest(edges).unionByName(same))
        return self

    def linkage(self) -> DataFrame:
        """``u, v, height``: the merges, an edge of the forest each; by height they are the dendrogram's."""
        if self.forest is None:
            raise NotFitted("Model not fitted. Call fit() first.")
        return self.forest

    def cut_tree(self, height: float) -> DataFrame:
        """``row_id, cluster`` of each row after all merges up to a height: the smallest row_id of its cluster.

        A row that is left out of every merge is a cluster by itself (null without a row_id)."""
        if height > self.height:
            raise InvalidParameter(f"Merges are known up to height {self.height}, not {height}")
        roots = _clusters(self.linkage().where(F.col("height") <= height).select("u", "v"))
        return self.rows.join(roots, F.col("row_id") == F.col("node"), "left").select("row_id", F.coalesce("root", "row_id").alias("cluster"))

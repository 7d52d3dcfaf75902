"""Connected components by contraction inside partitions between large-star and small-star rounds.

Stars: Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014). Edges live in ``(file_id, a, b)`` with
a < b. Before a round is written, every task replaces slices of its edges by stars round the least vertex that the slice connects,
so a graph that fits one slice is done without a star round, and a larger one enters it with fewer edges. A star round is
two map-side combined minimum aggregations joined back to the edges. Every round is written to the checkpoint folder, so a lost
executor costs at most one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.operators.staging import materialize, release

# Edges that a task holds and contracts at a time; the rest of its edges come in further slices.
SLICE = 500_000


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least vertex that each of the vertices 0 to n - 1 is connected with: roots hook to lower roots, paths are halved."""
    label = np.arange(n)
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        up = label[label]
        while (up != label).any():
            label, up = up, up[up]


def _stars_of(edges: pa.Table) -> pa.RecordBatch:
    """One edge from every vertex to the least vertex of its file that these edges connect it with."""
    files = edges["file_id"].unique()
    ends = pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks])
    vertices = ends.unique()
    vertices = vertices.take(pc.sort_indices(vertices))
    # Numbers of (file, vertex) in the order of vertices.
    file = pc.index_in(edges["file_id"], files).to_numpy().astype(np.int64)
    number = np.concatenate([file, file]) * len(vertices) + pc.index_in(ends, vertices).to_numpy()
    points, place = np.unique(number, return_inverse=True)
    label = _least_labels(len(points), place[:len(file)], place[len(file):])
    leaves = np.flatnonzero(label != np.arange(len(points)))
    leaf, root = points[leaves], points[label[leaves]]
    return pa.RecordBatch.from_arrays(
        [files.take(pa.array(leaf // len(vertices))), vertices.take(pa.array(root % len(vertices))), vertices.take(pa.array(leaf % len(vertices)))],
        names=["file_id", "a", "b"])


def contracted(edges: DataFrame) -> DataFrame:
    """The same components with fewer edges: slices of each partition as stars."""
    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= SLICE:
                yield _stars_of(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield _stars_of(pa.Table.from_batches(held))

    return edges.select("file_id", "a", "b").mapInArrow(contract, edges.select("file_id", "a", "b").schema)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("file_id", F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select("file_id", F.col("b").alias("u"), F.col("a").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a vertex to the vertex's smallest neighbour (or itself)."""
    near = _both_ways(edges)
    low = near.groupBy("file_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    return (near.join(low, ["file_id", "u"]).where("v > u")
            .select("file_id", F.col("low").alias("a"), F.col("v").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a vertex and its smaller neighbours to the smallest of them."""
    low = edges.groupBy("file_id", "b").agg(F.min("a").alias("low"))
    moved = edges.join(low, ["file_id", "b"]).where("a > low").select(
        "file_id", F.col("low").alias("a"), F.col("a").alias("b"))
    kept = low.select("file_id", F.col("low").alias("a"), "b")
    return moved.unionByName(kept).distinct()


def _roots(edges: DataFrame) -> DataFrame:
    """``(file_id, vertex, component, others)``: the least root of each vertex, and whether it has another one too."""
    ends = edges.select("file_id", F.col("b").alias("vertex"), F.col("a").alias("root")).unionByName(
        edges.select("file_id", F.col("a").alias("vertex"), F.col("a").alias("root")))
    return ends.groupBy("file_id", "vertex").agg(
        F.min("root").alias("component"), (F.min("root") < F.max("root")).alias("others"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(file_id, vertex, component)`` for every vertex on an edge; component is its smallest vertex.

    Rows with a null end and loops count for nothing. Rounds end when every vertex has one root.
    """
    ordered = edges.select("file_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    stars = materialize(contracted(ordered.distinct()))
    while _roots(stars).where("others").limit(1).count():
        before, stars = stars, materialize(contracted(_small_star(_large_star(stars))))
        release(before)
    return _roots(stars).drop("others")

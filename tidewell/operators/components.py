"""Connected components by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014. Before the first shuffle, and
after each round, every task contracts the edges it holds to a forest of stars, so chains shrink where
they are and repeated edges go. Each round is two
aggregations with map-side combine and two joins back on the node; every intermediate has at
most as many rows as the edge set, so one node that touches a third of all edges costs a
skewed join that AQE splits, never a quadratic expansion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import drop_path, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """True if every node has one edge to a smaller node, or none: then each edge ends in its component's smallest node."""
    edges = edges.distinct()  # tasks may hold the same edge
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return not sums.where("up > 1 or (up > 0 and down > 0)").take(1)


#: Edges that a task holds at once while it contracts them.
CONTRACT_ROWS = 1 << 20


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node of some edges to the smallest node of its component; a node with loops alone keeps one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    low, high = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(low):
        ours, theirs = label[low], label[high]
        apart = ours != theirs
        low, high, ours, theirs = low[apart], high[apart], ours[apart], theirs[apart]
        np.minimum.at(label, np.maximum(ours, theirs), np.minimum(ours, theirs))
        while (label[label] != label).any():
            label = label[label]
    own = label == np.arange(len(nodes))
    alone = own & (np.bincount(label, minlength=len(nodes)) == 1)
    kept = ~own | alone
    return nodes[kept], nodes[label[kept]]


def _contracted(edges: DataFrame, at_once: int) -> DataFrame:
    """The edges that each task holds, replaced by a forest of stars, a bounded number at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in star_forest(*(table.column(i).to_numpy() for i in (0, 1)))], ["u", "v"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= at_once:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    return edges.mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: list[int] | None = None, contract_rows: int = CONTRACT_ROWS) -> DataFrame:
    """Label every node that occurs in ``edges`` with the smallest node of its component.

    Returns ``(node, component)``, one row per node. Self-loops, repeated edges, both
    directions and null ends are allowed (null ends are ignored); an empty input gives an
    empty result. Nodes are 64-bit numbers. Nodes without an edge do not appear: the caller supplies
    ``component = node``. ``rounds`` gets the number of edges that each round begins with.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(src).cast("bigint").alias("a"), F.col(dst).cast("bigint").alias("b")).where("a is not null and b is not null")
    ends, _ = materialize(_contracted(pairs, contract_rows), "edges")
    loops = ends.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    current, path = ends.where("u <> v"), None
    while not _is_forest_of_stars(current):
        if rounds is not None:
            rounds.append(current.count())
        after, new_path = materialize(_contracted(_small_star(_large_star(current)), contract_rows), "edges")
        if path:
            drop_path(spark, path)
        current, path = after, new_path
    labelled = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return labelled.unionAll(roots).unionAll(loops).groupBy("node").agg(F.min("component").alias("component"))

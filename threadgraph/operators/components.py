"""Connected components of an edge table, on DataFrames: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

MAX_ROUNDS = 100
LOCAL_EDGES = 200_000  # so many edges of forests, a few MB, are left to one task
FOREST_NODES = 1_000_000


def forest(batches):
    """Of edges (a, b), in order, those that tie two parts together, and those from a node to itself (Kruskal's forest)."""
    import numpy as np
    import pyarrow as pa

    parent: dict[int, int] = {}  # started anew when it is full; more edges are then kept than are needed

    def root(v: int) -> int:
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = v = parent[up]
        return v

    for batch in batches:
        if len(parent) > FOREST_NODES:
            parent.clear()
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        roots = np.array([root(v) for v in nodes.tolist()], np.int64)[place]
        x, y = roots[: len(a)], roots[len(a) :]
        keep = a == b
        for k in np.flatnonzero(x != y).tolist():
            p, q = root(int(x[k])), root(int(y[k]))
            keep[k] = p != q
            parent[p] = q
        yield batch.filter(pa.array(keep))


def _least_nodes(batches):
    """node, component of all nodes of the edges (a, b)."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = v = parent[up]
        return v

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_pydict({"node": pa.array(parent, pa.int64()), "component": pa.array([root(v) for v in parent], pa.int64())})


def components_of(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """As ``connected_components``, for edges a, b: partitions keep forests first, and few edges are left to one task."""
    kept = materialise(edges.select("a", "b").where("a <> b").mapInArrow(forest, "a long, b long"), "components-forest")
    if kept.limit(local_edges + 1).count() <= local_edges:
        return kept.coalesce(1).mapInArrow(_least_nodes, "node long, component long")
    return connected_components(kept.select(F.col("a").alias("u"), F.col("b").alias("v")))


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node with an edge; ``edges`` has two long columns, u and v.

    Each node is linked to the least of its neighbourhood, in turn among its larger and its smaller neighbours, until nothing
    changes; every round shuffles the edges, of which there are never more than at the start, and is written to the shared
    folder. Minima are combined before the shuffle, so a node with very many neighbours is no hot key there.
    """
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "components")
    before = None
    for _ in range(MAX_ROUNDS):
        mark = _checksum(now)
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = materialise(small, "components")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

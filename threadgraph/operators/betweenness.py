"""Shortest paths through edges, and the first Girvan-Newman split, on tables: for components that one task can't hold.

Brandes' accumulation in rounds of joins. Sources are worked off in blocks. Forwards, a round takes each source of a block one
level further and adds up paths; neighbours of a level are on it, before it or after it, so only the last two levels are looked
at again. Backwards, a round hands each node's share to the nodes before it. A block holds as many sources as keep a round's
rows below a bound; what a source hands on lies spread over all executors. A node with very many neighbours is one key of the
joins, so arcs are either broadcast, if they are few, or repeated for some salts of the source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, release
from .components import components_of

DIGITS = 9  # betweenness values that differ by less are equal
BLOCK_ROWS = 200_000_000  # rows of (source, arc) that a block of sources may make
BROADCAST_ARCS = 500_000  # 8 MB
SALTS = 16


class _Arcs:
    """Both directions of edges a, b, joined to rows (source, node)."""

    def __init__(self, edges: DataFrame, count: int, broadcast_arcs: int):
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        self.few = 2 * count <= broadcast_arcs
        self.table = F.broadcast(both) if self.few else both.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def of(self, rows: DataFrame) -> DataFrame:
        if self.few:
            return rows.join(self.table, "node")
        return rows.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int")).join(self.table, ["node", "salt"]).drop("salt")


def _levels(sources: DataFrame, arcs: _Arcs) -> list[DataFrame]:
    """source, node, paths for each distance from 0."""
    levels = [materialise(sources.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")), "between-level")]
    while True:
        reached = arcs.of(levels[-1]).groupBy("source", F.col("to").alias("node")).agg(F.sum("paths").alias("paths"))
        for back in levels[-2:]:
            reached = reached.join(back.select("source", "node"), ["source", "node"], "left_anti")
        further = materialise(reached, "between-level")
        if further.isEmpty():
            release(further)
            return levels
        levels.append(further)


def _shares(levels: list[DataFrame], arcs: _Arcs) -> list[DataFrame]:
    """a, b, v: what the sources of these levels send through each edge, in parts."""
    sums, carried, past = [], None, None
    for before, here in zip(levels[-2::-1], levels[:0:-1], strict=True):
        rows = here.withColumn("carried", F.lit(0.0)) if carried is None else here.join(carried, ["source", "node"], "left").fillna(0.0, ["carried"])
        ahead = before.select("source", F.col("node").alias("to"), F.col("paths").alias("fewer"))
        share = F.col("fewer") / F.col("paths") * (1 + F.col("carried"))
        handed = materialise(arcs.of(rows).join(ahead, ["source", "to"]).select("source", "node", "to", share.alias("share")), "between-handed")
        sums.append(materialise(handed.groupBy(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).agg(F.sum("share").alias("v")), "between-sums"))
        if past is not None:
            release(past)
        carried, past = handed.groupBy("source", F.col("to").alias("node")).agg(F.sum("share").alias("carried")), handed
    if past is not None:
        release(past)
    return sums


def betweenness_table(edges: DataFrame, block_rows: int = BLOCK_ROWS, broadcast_arcs: int = BROADCAST_ARCS) -> DataFrame:
    """component, a, b, v of distinct edges component, a < b: shortest paths through each edge, in both directions.

    No edges give no rows; a null node joins nothing, so its edges get no row either.
    """
    ends = edges.select("component", F.col("a").alias("node")).union(edges.select("component", F.col("b").alias("node")))
    nodes = materialise(ends.distinct(), "between-nodes")
    by_component = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(edges.groupBy("component").agg(F.count(F.lit(1)).alias("m")), "component")
    size = by_component.agg(F.sum("m").alias("m"), F.sum(F.col("n").cast("double") * F.col("m") * 2).alias("rows")).first()
    arcs = _Arcs(edges, size["m"] or 0, broadcast_arcs)
    blocks = max(1, int(-(-(size["rows"] or 0) // block_rows)))
    sums: list[DataFrame] = []
    for block in range(blocks):
        levels = _levels(nodes.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == block), arcs)
        sums += _shares(levels, arcs)
        release(*levels)
        if len(sums) > 30:  # so that no plan reads very many tables
            sums = [_sum_up(sums)]
    if not sums:
        return edges.select("component", "a", "b", F.lit(0.0).alias("v")).limit(0)
    total = _sum_up(sums)
    release(nodes)
    return edges.select("component", "a", "b").join(total, ["a", "b"]).select("component", "a", "b", "v")


def _sum_up(sums: list[DataFrame]) -> DataFrame:
    total = materialise(reduce(DataFrame.union, sums).groupBy("a", "b").agg(F.sum("v").alias("v")), "between-sums")
    release(*sums)
    return total


def first_split_tables(edges: DataFrame, best: tuple | None = None, block_rows: int = BLOCK_ROWS, broadcast_arcs: int = BROADCAST_ARCS):
    """Of the components of edges (component, a, b, ord), the one that falls apart first: (level, latest, component), node and side.

    A round removes an edge from each component that may still be first. ``best`` is what another component has done: (level,
    latest). A component's level only falls, and the latest edge at its level only gets later, so those that are worse are left
    alone. Returns None if none is better than ``best``.
    """
    left = materialise(edges.select("component", "a", "b", "ord"), "split-edges")
    states = edges.select("component", F.lit(None).cast("double").alias("level"), F.col("ord").alias("latest")).limit(0)
    winner = None
    while not left.isEmpty():
        found = betweenness_table(left, block_rows, broadcast_arcs)
        order = F.struct((-F.round("v", DIGITS)).alias("minus"), "ord", "a", "b")
        most = left.join(found, ["component", "a", "b"]).groupBy("component").agg(F.min(order).alias("e"))
        picked = materialise(most.select("component", (-F.col("e.minus")).alias("v"), "e.ord", "e.a", "e.b"), "split-picked")
        remaining = materialise(left.join(picked.select("component", "a", "b"), ["component", "a", "b"], "left_anti"), "split-edges")
        parts = materialise(components_of(remaining), "split-parts")
        of_a, of_b = parts.select(F.col("node").alias("a"), F.col("component").alias("pa")), parts.select(F.col("node").alias("b"), F.col("component").alias("pb"))
        apart = F.coalesce("pa", "a") != F.coalesce("pb", "b")
        old = states.select("component", F.col("level").alias("_level"), F.col("latest").alias("_latest"))
        fell = F.col("_level").isNull() | (F.col("v") < F.col("_level"))
        later = (F.col("v") == F.col("_level")) & (F.col("ord") > F.col("_latest"))
        latest = F.when(fell | later, F.col("ord")).otherwise(F.col("_latest"))
        now = picked.join(of_a, "a", "left").join(of_b, "b", "left").join(old, "component", "left")
        states = materialise(now.select("component", F.when(fell, F.col("v")).otherwise(F.col("_level")).alias("level"), latest.alias("latest"), apart.alias("apart")), "split-states")
        top = states.where("apart").orderBy(F.desc("level"), "latest").first()
        if top is not None and (best is None or (-top["level"], list(top["latest"])) < (-best[0], list(best[1]))):
            best = (top["level"], list(top["latest"]))
            own = left.where(F.col("component") == top["component"])
            nodes = own.select(F.col("a").alias("node")).union(own.select(F.col("b").alias("node"))).distinct()
            sides = nodes.join(parts.select("node", F.col("component").alias("side")), "node", "left").select("node", F.coalesce("side", "node").alias("side"))
            winner = (*best, top["component"], materialise(sides, "split-sides"))
        may = ~F.col("apart")
        if best is not None:
            at = F.lit(float(best[0]))
            may = may & ((F.col("level") > at) | ((F.col("level") == at) & (F.col("latest") < F.array(*[F.lit(int(x)) for x in best[1]]).cast("array<bigint>"))))
        alive = materialise(remaining.join(states.where(may).select("component"), "component", "left_semi"), "split-edges")
        release(left, remaining, parts, picked)
        left = alive
    return winner

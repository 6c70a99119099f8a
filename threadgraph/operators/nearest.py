"""Edges for isolated nodes (A1).

A node without edges is tied to the first sentence of its comment, or if it is that, to the node of another comment that is
nearest by a node weight (ties by node order). Nodes of equal weight form a level, and levels are numbered in order of their
weight. The nearest is on the node's own level, or on the first level to either side that has another comment: levels are
looked up by their number, one step further out in each round, until every node has been answered on both sides. A comment
only stands alone on as many levels in a row as it has sentences, so rounds are few.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EDGE_WEIGHTS, NODE, NODE_WEIGHTS, Graph, GraphError, check_name
from ..storage import materialise, ranked_position
from .filters import require
from .rank import endpoints

LAST = (1 << 62) - 1  # these edges come after all others


def nearest_of_others(nodes: DataFrame, wanted: DataFrame, weight: str) -> DataFrame:
    """src_c, src_s, tgt_c, tgt_s for each wanted node: the node of another comment with the nearest weight."""
    first = nodes.groupBy(F.col(weight).alias("v"), "c_idx").agg(F.min("s_idx").alias("s_idx"))
    # Of a level, the first two comments are enough: whichever comment asks, one of them is another.
    by = Window.partitionBy("v").orderBy("c_idx")
    two = first.withColumn("_n", F.row_number().over(by)).where("_n <= 2").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("c_idx", "s_idx"))).alias("two"))
    levels = materialise(ranked_position(two, ["v"], "p"), "levels")  # in ranges of rows, so weights in [0, 1] are no hot bucket
    asks = wanted.select(F.col(weight).alias("v"), F.col("c_idx").alias("src_c"), F.col("s_idx").alias("src_s"))
    asks = asks.join(levels.select("v", "p"), "v").withColumnRenamed("v", "w")
    at = levels.select(F.col("p").alias("q"), "v", "two")

    def offers(open_, q):
        found = open_.withColumn("q", q).join(at, "q").withColumn("t", F.get(F.filter("two", lambda t: t["c_idx"] != F.col("src_c")), F.lit(0)))
        return found.where("t is not null").select("src_c", "src_s", F.struct(F.abs(F.col("v") - F.col("w")).alias("d"), F.col("t.c_idx").alias("c"), F.col("t.s_idx").alias("s")).alias("b"))

    found = [offers(asks, F.col("p"))]
    done = found[0].select("src_c", "src_s")
    last = levels.agg(F.max("p").alias("p")).first()["p"]
    for side in (-1, 1):
        open_, step = asks.join(done, ["src_c", "src_s"], "left_anti"), 1
        while True:
            here = materialise(offers(open_, F.col("p") + side * step), "nearest")
            found.append(here)
            beyond = (F.col("p") + side * (step + 1)).between(0, last)
            open_ = materialise(open_.join(here.select("src_c", "src_s"), ["src_c", "src_s"], "left_anti").where(beyond), "nearest-open")
            if open_.isEmpty():
                break
            step += 1
    best = reduce(DataFrame.union, found).groupBy("src_c", "src_s").agg(F.min("b").alias("b"))
    return best.select("src_c", "src_s", F.col("b.c").alias("tgt_c"), F.col("b.s").alias("tgt_s"))


def add_single_edges(graph: Graph, base: float = 0.1, edge_type: str = "TEMPORAL", node_weight: str = "RECENCY") -> Graph:
    check_name(edge_type, EDGE_WEIGHTS)
    check_name(node_weight, NODE_WEIGHTS)
    tied = endpoints(graph.edges.select("src_c", "src_s", "tgt_c", "tgt_s")).select(*NODE).distinct()
    alone = graph.nodes.join(tied, list(NODE), "left_anti").select(*NODE, node_weight)
    within = alone.where("s_idx > 0").select(F.col("c_idx").alias("src_c"), F.col("s_idx").alias("src_s"), F.col("c_idx").alias("tgt_c"), F.lit(0).cast("long").alias("tgt_s"))
    roots = alone.where("s_idx = 0")
    if roots.limit(1).count():
        require(graph, node_weight)
        if graph.nodes.select("c_idx").distinct().limit(2).count() < 2:
            raise GraphError("there is no other comment to tie a node to")
    new = within.union(nearest_of_others(graph.nodes, roots, node_weight))
    weights = [(F.lit(base) if w == edge_type else F.lit(None)).cast("double").alias(w) for w in EDGE_WEIGHTS]
    added = new.select("src_c", "src_s", "tgt_c", "tgt_s", *weights, F.array(F.lit(LAST), "src_c", "src_s").alias("ord"))
    return graph.with_(edges=graph.edges.unionByName(added))

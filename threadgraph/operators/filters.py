"""Node filters, which remove edges, and edge filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EDGE_WEIGHTS, ENDS, NODE, NODE_WEIGHTS, Graph, GraphError, check_name
from .bundles import ALL, at_comments, for_top, spread
from .rank import endpoints
from .similar import SimilarPairs

OR_ORDER = ("REPLY_TO", "SAME_ARTICLE", "SIMILARITY", "SAME_GROUP", "SAME_COMMENT")


def _passes(weight: Column, threshold: float, smaller_as: bool) -> Column:
    return weight <= threshold if smaller_as else weight >= threshold


def _edges_at(graph: Graph, nodes: DataFrame, both: bool, small: bool = False) -> DataFrame:
    """Edges of which one end, or ``both``, may be among the nodes: of bundles that hold for all sentences, others aren't spread."""
    if graph.bundles is None or ALL not in graph.bundles.scopes.values():
        return graph.edges
    return spread(at_comments(graph.bundles, nodes, both, small))


def node_threshold(graph: Graph, threshold: float, node_weight: str, strict: bool = True, smaller_as: bool = False) -> Graph:
    """Edges whose two ends both pass; ``strict`` makes no difference. A missing weight is an error."""
    check_name(node_weight, NODE_WEIGHTS)
    fails = F.raise_error(F.lit(f"a node has no {node_weight}")).cast("boolean")
    passing = graph.nodes.where(F.when(F.col(node_weight).isNull(), fails).otherwise(_passes(F.col(node_weight), threshold, smaller_as))).select(*NODE)
    if isinstance(graph.bundles, SimilarPairs):
        return graph.with_(edges=None, bundles=graph.bundles.at(passing, True))
    edges = _edges_at(graph, passing, True)
    for end in ("src", "tgt"):
        edges = edges.join(passing.select(F.col("c_idx").alias(f"{end}_c"), F.col("s_idx").alias(f"{end}_s")), [f"{end}_c", f"{end}_s"], "left_semi")
    return graph.with_(edges=edges.select(*graph.edges.columns))


def node_top(graph: Graph, top_k: int, node_weight: str, strict: bool = False, descending: bool = True) -> Graph:
    """Edges with both ends (strict) or one end among the ``top_k`` nodes; ties go by node order."""
    check_name(node_weight, NODE_WEIGHTS)
    order = F.col(node_weight).desc() if descending else F.col(node_weight).asc()
    top = graph.nodes.orderBy(order, *NODE).limit(top_k).select(*NODE).withColumn("_in", F.lit(True))
    small = top_k <= 10_000  # by the parameter, whatever the graph
    if isinstance(graph.bundles, SimilarPairs):
        return graph.with_(edges=None, bundles=graph.bundles.at(top, strict))
    edges = _edges_at(graph, top, strict, small)
    top = F.broadcast(top) if small else top
    for end in ("src", "tgt"):
        edges = edges.join(top.select(F.col("c_idx").alias(f"{end}_c"), F.col("s_idx").alias(f"{end}_s"), F.col("_in").alias(f"_{end}")), [f"{end}_c", f"{end}_s"], "left")
    both, either = F.col("_src") & F.col("_tgt"), F.col("_src").isNotNull() | F.col("_tgt").isNotNull()
    return graph.with_(edges=edges.where(both if strict else either).select(*graph.edges.columns))


def edge_threshold(graph: Graph, threshold: float, edge_type: str, smaller_as: bool = False) -> Graph:
    """Edges that have the weight (0 is none), at or beyond the threshold."""
    weight = F.col(check_name(edge_type, EDGE_WEIGHTS))
    return graph.with_(edges=graph.edges.where((weight != 0) & _passes(weight, threshold, smaller_as)))


def edge_any(graph: Graph, thresholds: dict[str, float]) -> Graph:
    """Edges over any of the positive thresholds; for TEMPORAL, under it."""
    terms = []
    for kind, t in thresholds.items():
        weight = F.col(check_name(kind, EDGE_WEIGHTS))
        if t > 0:
            terms.append((weight > 0) & (weight < t) if kind == "TEMPORAL" else weight > t)
    found = reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in terms], F.lit(False))
    return graph.with_(edges=graph.edges.where(found))


def edge_top(graph: Graph, top_edges: int, edge_type: str, descending: bool = True) -> Graph:
    """For every node its ``top_edges`` edges by weight (missing: 0), ties by edge order; edges are then ordered by the first
    node that picked them and their rank there."""
    if graph.bundles is not None and graph.bundles.holds_for_all(edge_type):
        graph = graph.with_(edges=spread(for_top(graph.bundles, top_edges, edge_type, descending)))
    weight = F.coalesce(F.col(check_name(edge_type, EDGE_WEIGHTS)), F.lit(0.0))
    by = Window.partitionBy(*NODE).orderBy(weight.desc() if descending else weight.asc(), "ord")
    picked = endpoints(graph.edges).withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= top_edges)
    first = F.min(F.array("c_idx", "s_idx", F.col("_rank").cast("long"))).alias("ord")
    kept = picked.groupBy(*ENDS, *EDGE_WEIGHTS).agg(first)
    return graph.with_(edges=kept.select(*graph.edges.columns))


def require(graph: Graph, node_weight: str) -> None:
    """Raise unless every node has the weight."""
    if graph.nodes.where(F.col(node_weight).isNull()).limit(1).count():
        raise GraphError(f"a node has no {node_weight}")

"""Node mergers: connected components of qualifying edges, as MERGE_ID (M1-M8).

Ids come from the order of edges: one whose ends are both new opens a cluster with the next id; where two clusters meet, the one
of the source stays. Nodes outside get -1, -2, ... in node order.

An edge within what earlier edges have tied together changes nothing. So each partition first keeps a forest of its edges. What is
left is replayed in order by one task if it has ``LOCAL_EDGES`` rows at most; otherwise ids come from rounds of joins and
aggregates (``contracted``), in which no task ever holds a component:

* Every cluster picks its first edge to another one. Picks tie clusters together to trees along which edges come later the farther
  out they are, so a cluster is met by its pick just when nothing else has happened to it yet.
* In the first round clusters are single nodes. The one edge of a tree that both ends picked opens the cluster, all others add a new
  node to it; that fixes which edges open clusters, and their order numbers them.
* In later rounds a pick adds a whole cluster. If the cluster is the pick's target, the id of the rest stays; if it is the source, its
  id takes over from that time on. Takeovers are kept with their time, as a cluster's id at the time of a pick is the last before it.
* Trees become the next round's clusters, which halves them at least; the last takeover of a component is its id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EDGE_WEIGHTS, NODE, Graph, check_name, dense_position
from ..storage import materialise, ranked_position
from .bundles import for_forest, spread
from .components import LOCAL_EDGES, forest
from .similar import SimilarPairs

SHIFT = 20  # sentences of a comment fit into so many bits of a node key


def node_key(c: Column, s: Column) -> Column:
    return F.shiftleft(c.cast("long"), SHIFT) + s


def replay(batches):
    """The cluster id of every node, by all edges in order."""
    import pyarrow as pa

    own: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    seeds = 0
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = own.get(a), own.get(b)
            if x is None and y is None:
                own[a] = own[b] = seeds
                members[seeds] = [a] if a == b else [a, b]
                seeds += 1
            elif x is None or y is None:
                new, there = (a, y) if x is None else (b, x)
                own[new] = there
                members[there].append(new)
            elif x != y:
                for node in members[y]:
                    own[node] = x
                members[x] += members.pop(y)
    yield pa.RecordBatch.from_pydict({"node": pa.array(own.keys(), pa.int64()), "id": pa.array(own.values(), pa.int64())})


def _roots(picks: DataFrame) -> DataFrame:
    """v, r: the root of each pick's tree, which is the source of the edge that both its ends picked; by pointer jumping."""
    other = picks.select(F.col("v").alias("u"), F.col("u").alias("back"), F.col("t").alias("back_t"))
    mutual = (F.col("back") == F.col("v")) & (F.col("back_t") == F.col("t")) & F.col("source")
    stays = mutual | (F.col("u") == F.col("v"))
    now = materialise(picks.join(other, "u").select("v", F.when(stays, F.col("v")).otherwise(F.col("u")).alias("r")), "merge-roots")
    while True:
        up = now.select(F.col("v").alias("r"), F.col("r").alias("further"))
        now = materialise(now.join(up, "r").select("v", F.col("further").alias("r"), (F.col("further") != F.col("r")).alias("moved")), "merge-roots")
        if now.where("moved").isEmpty():
            return now.drop("moved")


def contracted(keyed: DataFrame) -> DataFrame:
    """node, id of every node of the edges (a, b, ord), as ``replay`` gives them, on tables alone."""
    edges, labels, takeovers, seeds = keyed, None, None, None
    while True:
        side = lambda v, u, source: edges.select(F.col(v).alias("v"), F.struct(F.col("ord").alias("t"), F.col(u).alias("u"), F.lit(source).alias("source")).alias("p"))
        firsts = side("a", "b", True).union(side("b", "a", False)).groupBy("v").agg(F.min("p").alias("p")).select("v", "p.*")
        picks = materialise(firsts, "merge-picks")
        if picks.isEmpty():
            break
        roots = _roots(picks)
        if labels is None:
            labels = roots.select(F.col("v").alias("node"), F.col("r").alias("label"))
            opened = roots.where("v = r").select("v").join(picks, "v").select("v", "t")
            seeds = ranked_position(opened, ["t"], "id")
            takeovers = seeds.select("v", "t", "id")
        else:
            labels = materialise(labels.join(roots.select(F.col("v").alias("label"), "r"), "label", "left").select("node", F.coalesce("r", "label").alias("label")), "merge-labels")
            known = takeovers.join(picks.select("v", F.col("t").alias("met"), "source"), "v", "left").join(roots, "v", "left")
            later = known.where(F.col("met").isNull() | (F.col("t") > F.col("met"))).select(F.coalesce("r", "v").alias("v"), "t", "id")
            before = known.where("source and t < met").groupBy("v").agg(F.max(F.struct("t", "id")).alias("last"), F.first("met").alias("met"), F.first("r").alias("r"))
            takeovers = materialise(later.union(before.select(F.col("r").alias("v"), F.col("met").alias("t"), "last.id")), "merge-takeovers")
        to = lambda v, name: roots.select(F.col("v").alias(v), F.col("r").alias(name))
        moved = edges.join(to("a", "x"), "a").join(to("b", "y"), "b").where("x <> y")
        first = F.min(F.struct("ord", "x", "y")).alias("e")  # of several edges between two clusters only the first ties them together
        edges = materialise(moved.groupBy(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q")).agg(first).select(F.col("e.x").alias("a"), F.col("e.y").alias("b"), F.col("e.ord").alias("ord")), "merge-edges")
    last = takeovers.groupBy("v").agg(F.max(F.struct("t", "id")).alias("last")).select(F.col("v").alias("label"), "last.id")
    return labels.join(last, "label").select("node", "id")


def _whole(thresholds: dict[str, float], smaller_as: bool = False, conjunctive: bool = False) -> Column:
    tests = []
    for kind, t in thresholds.items():
        weight = F.col(check_name(kind, EDGE_WEIGHTS))
        tests.append(F.coalesce(weight <= t if smaller_as else weight >= t, F.lit(False)))
    return reduce((lambda a, b: a & b) if conjunctive else (lambda a, b: a | b), tests, F.lit(conjunctive))


def qualifying(edges: DataFrame, thresholds: dict[str, float], smaller_as: bool = False, conjunctive: bool = False) -> DataFrame:
    return edges.where(_whole(thresholds, smaller_as, conjunctive))


def merge_edges(graph: Graph, edges: DataFrame, name: str = "MERGE_ID", local_edges: int = LOCAL_EDGES) -> Graph:
    keyed = edges.select(node_key(F.col("src_c"), F.col("src_s")).alias("a"), node_key(F.col("tgt_c"), F.col("tgt_s")).alias("b"), "ord")
    keyed = materialise(keyed.sortWithinPartitions(F.col("ord")[0], "ord").mapInArrow(forest, "a long, b long, ord array<long>"), "merge-forest")
    few = keyed.limit(local_edges + 1).count() <= local_edges
    if few:
        found = materialise(keyed.coalesce(1).sortWithinPartitions("ord").mapInArrow(replay, "node long, id long"), "merge-ids")
    elif keyed.isEmpty():
        found = keyed.select(F.col("a").alias("node"), F.col("b").alias("id"))
    else:
        found = contracted(keyed)
    nodes = graph.nodes.drop(name).withColumn("_key", node_key(F.col("c_idx"), F.col("s_idx"))).join(found.select(F.col("node").alias("_key"), F.col("id").cast("double").alias("_id")), "_key", "left")
    alone = dense_position(nodes.where("_id is null").select("_key"), ["_key"], F.shiftright("_key", SHIFT + 10), "_nth")
    joined = nodes.join(alone.select("_key", "_nth"), "_key", "left")
    return graph.with_(nodes=joined.withColumn(name, F.coalesce("_id", -(F.col("_nth") + 1).cast("double"))).select(*graph.nodes.columns))


def merge(graph: Graph, threshold: float, edge_type: str, smaller_as: bool = False) -> Graph:
    edges = graph.edges
    if graph.bundles is not None and graph.bundles.holds_for_all(edge_type):
        implied = isinstance(graph.bundles, SimilarPairs)
        edges = spread(graph.bundles.forest(threshold, smaller_as) if implied else for_forest(graph.bundles, _whole({edge_type: threshold}, smaller_as)))
    return merge_edges(graph, qualifying(edges, {edge_type: threshold}, smaller_as))


def merge_multi(graph: Graph, thresholds: dict[str, float], smaller_as: bool = False, conj_or: bool = True) -> Graph:
    """Negative thresholds don't count; without any, OR takes no edge and AND takes all."""
    used = {k: t for k, t in thresholds.items() if t >= 0}
    return merge_edges(graph, qualifying(graph.edges, used, smaller_as, conjunctive=not conj_or))


def merged_groups(nodes: DataFrame, name: str = "MERGE_ID") -> DataFrame:
    """c_idx, s_idx, rep_c, rep_s: the first node of each node's group, whatever the ids."""
    first = nodes.groupBy(name).agg(F.min(F.struct(*NODE)).alias("_first"))
    return nodes.join(first, name).select(*NODE, F.col("_first.c_idx").alias("rep_c"), F.col("_first.s_idx").alias("rep_s"))

"""Community detection, as CLUSTER_ID.

Both algorithms work within connected components; only a few numbers per component meet. A component is one task, but
Girvan-Newman splits those of over SPLIT_EDGES edges on tables (``betweenness.py``). Girvan-Newman removes
the edge of largest betweenness, anywhere, until some component falls apart. A component needs to get through removals of
certain betweenness before it does; the one whose least such value is largest is through first, so that is the one that
splits. Greedy modularity needs the number of all edges, and joins only within components.
"""

from __future__ import annotations

import heapq
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EDGE_WEIGHTS, Graph, check_name, dense_position
from ..storage import materialise
from .betweenness import DIGITS, first_split_tables
from .components import components_of
from .merge import SHIFT, node_key

SPLIT_EDGES = 10_000  # of a component that one task splits


def betweenness(near: dict[int, list[int]]) -> dict[tuple[int, int], float]:
    """Shortest paths through each edge of an unweighted graph (Brandes' accumulation)."""
    total: dict[tuple[int, int], float] = {}
    for source in near:
        paths, level, below, order, queue = {source: 1.0}, {source: 0}, {source: []}, [], deque([source])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in level:
                    level[w], paths[w], below[w] = level[v] + 1, 0.0, []
                    queue.append(w)
                if level[w] == level[v] + 1:
                    paths[w] += paths[v]
                    below[w].append(v)
        carried = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in below[w]:
                share = paths[v] / paths[w] * (1 + carried[w])
                carried[v] += share
                key = (min(v, w), max(v, w))
                total[key] = total.get(key, 0.0) + share
    return total


def _graph_of(ends_a: list[int], ends_b: list[int]) -> dict[int, list[int]]:
    near: dict[int, list[int]] = {}
    for a, b in zip(ends_a, ends_b, strict=True):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    return near


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of each component, of batches that are sorted by it."""
    open_: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("component")
        ends = (pc.indices_nonzero(pc.not_equal(ids[1:], ids[:-1])).to_numpy() + 1).tolist()
        for start, end in zip([0, *ends], [*ends, len(ids)], strict=True):
            if open_ and open_[0].column("component")[0] != ids[start]:
                yield pa.Table.from_batches(open_)
                open_ = []
            open_.append(batch.slice(start, end - start))
    if open_:
        yield pa.Table.from_batches(open_)


def _by_component(placed: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on a stream of components. Most have a few edges, and as groups of their own they'd cost far more than their work."""
    return placed.repartition("component").sortWithinPartitions("component").mapInArrow(lambda batches: work(_components(batches)), schema)


def split_of(own: pa.Table, best: tuple[float, tuple] | None = None) -> tuple[float, tuple, list[int], list[int]] | None:
    """One component: the least betweenness on its way to falling apart, the latest edge at that level, and its two halves.

    None if it can't do better than ``best``: its level only falls, and the latest edge at its level only gets later. Shortest paths
    through an edge lead from nodes nearer to one end to nodes nearer to the other, so half the square of the nodes is a bound.
    """
    near = _graph_of(own["a"].to_pylist(), own["b"].to_pylist())
    if best and 2 * (len(near) // 2) * (len(near) - len(near) // 2) + 1 < best[0]:
        return None
    edges = sorted(zip(map(tuple, own["ord"].to_pylist()), own["a"].to_pylist(), own["b"].to_pylist(), strict=True), key=lambda e: e[0])
    place = {(min(a, b), max(a, b)): k for k, (_, a, b) in reversed(list(enumerate(edges)))}
    level, latest = float("inf"), ()
    while True:
        found = betweenness(near)
        most = max(round(v, DIGITS) for v in found.values())
        a, b = min((e for e, v in found.items() if round(v, DIGITS) == most), key=place.__getitem__)
        order = edges[place[a, b]][0]
        level, latest = min(level, most), order if most < level else max(latest, order) if most == level else latest
        if best and (-level, latest) > (-best[0], best[1]):
            return None
        near[a].remove(b)
        near[b].remove(a)
        half, queue = {a}, [a]
        while queue:
            for w in near[queue.pop()]:
                if w not in half:
                    half.add(w)
                    queue.append(w)
        if b not in half:
            return level, latest, sorted(half), sorted(set(near) - half)


SPLIT = pa.schema([("component", pa.int64()), ("level", pa.float64()), ("latest", pa.list_(pa.int64())), ("node", pa.int64()), ("side", pa.int64())])


def first_splits(components: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Of a task's components, the one that falls apart first."""
    best, first = None, None
    for own in components:
        found = split_of(own, best)
        if found:
            best, first = found[:2], (own["component"][0].as_py(), *found)
    if first:
        component, level, latest, half, other = first
        n = len(half) + len(other)
        columns = [component] * n, [level] * n, [list(latest)] * n, [*half, *other], [half[0]] * len(half) + [other[0]] * len(other)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, SPLIT, strict=True)], schema=SPLIT)


def greedy_modularity(ends_a: list[int], ends_b: list[int], edges: int) -> list[list[int]]:
    """One component: its communities, made by joining the pair that gains most modularity while any does; ties by least nodes.

    Gains are whole numbers (times 2 edges**2), so ties are exact. A heap holds a gain for each pair of neighbours, anew for each
    pair of a community that grew; what is out of date is skipped.
    """
    weight: dict[int, dict[int, int]] = {}
    for v, others in _graph_of(ends_a, ends_b).items():
        near = weight[v] = {}
        for w in others:
            near[w] = near.get(w, 0) + 1
    degree = {v: sum(near.values()) for v, near in weight.items()}
    members = {v: [v] for v in weight}
    grown = dict.fromkeys(weight, 0)  # how often a community grew

    def entry(v, w):
        v, w = min(v, w), max(v, w)
        return degree[v] * degree[w] - 2 * edges * weight[v][w], v, w, grown[v], grown[w]

    heap = [entry(v, w) for v in weight for w in weight[v] if v < w]
    heapq.heapify(heap)
    while heap and heap[0][0] < 0:
        _, v, w, at_v, at_w = heapq.heappop(heap)
        if grown.get(v) != at_v or grown.get(w) != at_w:
            continue
        for x, n in weight.pop(w).items():
            del weight[x][w]
            if x != v:
                weight[v][x] = weight[x][v] = weight[v].get(x, 0) + n
        degree[v] += degree.pop(w)
        members[v] += members.pop(w)
        grown[v] += 1
        del grown[w]
        for x in weight[v]:
            heapq.heappush(heap, entry(v, x))
    return list(members.values())


class AlikeSentences:
    """``greedy_modularity`` of one component of bundles whose weight holds for all sentences of two comments.

    Sentences of a comment have the same neighbours. Those that have joined nothing yet are alike but for their place, and of equal
    gains the first comes first; so a comment is one unit, of which the first sentence that is left joins, and communities are the
    others. Units are numbered, comments first. The heap has one entry for each unit: the best of its pairs when it last changed. A
    pair's entry, by the end that changed last, is never behind the pair, so the first that still holds is the best of all.
    """

    def __init__(self, c_a: np.ndarray, c_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, edges: int):
        self.comments, first = np.unique(np.concatenate((c_a, c_b)), return_index=True)
        size = np.concatenate((n_a, n_b))[first].astype(np.int64)
        a, b = np.searchsorted(self.comments, c_a), np.searchsorted(self.comments, c_b)
        within, apart = a[a == b], a != b
        a, b = np.concatenate((a[apart], b[apart])), np.concatenate((b[apart], a[apart]))
        order = np.argsort(a, kind="stable")
        self.other = b[order].astype(np.int32)
        self.cuts = np.searchsorted(a[order], np.arange(len(size) + 1))
        inside = np.zeros(len(size), np.int64)
        inside[within] = 1
        degree = np.bincount(a, weights=size[b], minlength=len(size)).astype(np.int64) + inside * (size - 1)
        self.edges, self.inside = edges, inside.astype(bool).tolist()
        self.start = np.concatenate(([0], np.cumsum(size)))
        self.left = size.tolist()  # sentences of a comment that have joined nothing
        self.degree = degree.tolist()  # of one of its sentences; of a community
        self.first = (self.comments << SHIFT).tolist()  # least sentence of a unit
        self.joined = array("q", bytes(8 * int(size.sum())))  # 1 + the community that a sentence joined first
        self.into: list[int] = []  # what a community became
        self.near: dict[int, dict[int, int]] = {}  # edges of a community, to one sentence of a comment or to a community; and back
        self.stamp = [0] * len(size)
        self.heap: list[tuple] = []

    def neighbours(self, c: int) -> list[int]:
        return self.other[self.cuts[c] : self.cuts[c + 1]].tolist()

    def best(self, u: int) -> tuple[int, int, int, int] | None:
        """(gain, least sentences of both, other unit) of a unit's best pair; of the gain, twice the edges for each edge that it counts."""
        own, at, degree, first, twice = self.degree[u], self.first[u], self.degree, self.first, 2 * self.edges
        pairs = [(own * degree[x] - twice * n, first[x], x) for x, n in self.near.get(u, {}).items()]
        if u < len(self.left):
            pairs += [(own * degree[x] - twice, first[x], x) for x in self.neighbours(u) if self.left[x]]
            if self.inside[u] and self.left[u] > 1:
                pairs.append((own * own - twice, at + 1, u))
        if not pairs:
            return None
        gain = min(pairs)[0]
        return min((gain, at, y, x) if at < y else (gain, y, at, x) for g, y, x in pairs if g == gain)

    def push(self, u: int) -> None:
        self.stamp[u] += 1
        found = self.best(u)
        if found and found[0] < 0:
            heapq.heappush(self.heap, (*found, u, self.stamp[u]))

    def alive(self, u: int) -> bool:
        return self.left[u] > 0 if u < len(self.left) else self.into[u - len(self.left)] == u

    def absorb(self, x: int, c: int) -> None:
        """The first sentence that is left of a comment joins a community."""
        near, mine = self.near[x], self.near.get(c, {})
        self.joined[int(self.start[c]) + (self.first[c] & (1 << SHIFT) - 1)] = x + 1
        self.first[x] = min(self.first[x], self.first[c])
        self.degree[x] += self.degree[c]
        self.left[c] -= 1
        self.first[c] += 1
        for y, n in mine.items():
            if y != x:
                near[y] = self.near[y][x] = near.get(y, 0) + n
        for d in self.neighbours(c):
            if self.left[d]:
                near[d] = self.near.setdefault(d, {})[x] = near.get(d, 0) + 1
        if not self.left[c]:
            for y in self.near.pop(c, {}):
                del self.near[y][c]
        elif self.inside[c]:
            near[c] = self.near.setdefault(c, {})[x] = near.get(c, 0) + 1

    def join(self, u: int, v: int) -> int:
        """The community that two units become."""
        kinds = u >= len(self.left), v >= len(self.left)
        if all(kinds):
            x, y = (u, v) if len(self.near[u]) >= len(self.near[v]) else (v, u)
            near = self.near[x]
            for z, n in self.near.pop(y).items():
                del self.near[z][y]
                if z != x:
                    near[z] = self.near[z][x] = near.get(z, 0) + n
            self.degree[x] += self.degree[y]
            self.first[x] = min(self.first[x], self.first[y])
            self.into[y - len(self.left)] = x
            return x
        if any(kinds):
            x, c = (u, v) if kinds[0] else (v, u)
            self.absorb(x, c)
            return x
        x = len(self.degree)
        self.near[x] = {}
        self.degree.append(0)
        self.first.append(self.first[u])
        self.stamp.append(0)
        self.into.append(x)
        self.absorb(x, u)
        self.absorb(x, v)
        return x

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """node, side (the first node of its community) of all sentences that joined any."""
        for u in range(len(self.left)):
            self.push(u)
        while self.heap:
            gain, v, w, other, u, stamp = heapq.heappop(self.heap)
            if stamp != self.stamp[u] or not self.alive(u):
                continue
            found = self.best(u)
            if found != (gain, v, w, other):
                self.push(u)
                continue
            x = self.join(u, other)
            self.push(x)
            if x != u and self.alive(u):
                self.push(u)
        for y in range(len(self.into) - 1, -1, -1):
            x = y + len(self.left)
            while self.into[x - len(self.left)] != x:
                x = self.into[x - len(self.left)]
            self.into[y] = x
        joined = np.frombuffer(self.joined, np.int64)
        at = np.flatnonzero(joined)
        comment = np.searchsorted(self.start, at, side="right") - 1
        node = (self.comments[comment] << SHIFT) + at - self.start[comment]
        sides = np.array(self.first, np.int64)[np.array(self.into, np.int64)[joined[at] - 1 - len(self.left)]] if len(at) else at
        return node, sides


STREAM_ROWS = 20_000


def communities(components: Iterator[pa.Table], edges: int) -> Iterator[pa.RecordBatch]:
    """node, side (the first node of its community)."""
    nodes: list[int] = []
    sides: list[int] = []
    for own in components:
        for members in greedy_modularity(own["a"].to_pylist(), own["b"].to_pylist(), edges):
            nodes += members
            sides += [min(members)] * len(members)
        if len(nodes) > STREAM_ROWS:
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "side": pa.array(sides, pa.int64())})
            nodes, sides = [], []
    if nodes:
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "side": pa.array(sides, pa.int64())})


def communities_of_bundles(components: Iterator[pa.Table], edges: int) -> Iterator[pa.RecordBatch]:
    """node, side (the first node of its community); sentences that join nothing may be left out."""
    for own in components:
        node, side = AlikeSentences(*[own[c].to_numpy() for c in ("a", "b", "n_a", "n_b")], edges).run()
        for start in range(0, len(node), STREAM_ROWS):
            part = slice(start, start + STREAM_ROWS)
            yield pa.RecordBatch.from_pydict({"node": pa.array(node[part], pa.int64()), "side": pa.array(side[part], pa.int64())})


def _split_first(placed: DataFrame, split_edges: int) -> DataFrame | None:
    """node, side of the component that falls apart first; None without edges."""
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    large = materialise(sizes.where(F.col("n") > split_edges).select("component"), "cluster-large")
    small = placed.join(large, "component", "left_anti")
    halves = materialise(_by_component(small, first_splits, "component long, level double, latest array<long>, node long, side long"), "cluster-halves")
    first = halves.orderBy(F.desc("level"), "latest").select("component", "level", "latest").first()
    found = None
    if not large.isEmpty():
        found = first_split_tables(placed.join(large, "component", "left_semi"), (first["level"], first["latest"]) if first else None)
    if found:
        return found[3]
    return halves.where(F.col("component") == first["component"]).select("node", "side") if first else None


def cluster_edges(graph: Graph, edges: DataFrame, girvan_newman: bool = True, split_edges: int = SPLIT_EDGES) -> Graph:
    keyed = edges.select(node_key(F.col("src_c"), F.col("src_s")).alias("_a"), node_key(F.col("tgt_c"), F.col("tgt_s")).alias("_b"), "ord")
    keyed = keyed.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "ord").where("a <> b").groupBy("a", "b").agg(F.min("ord").alias("ord"))
    keyed = materialise(keyed, "cluster-edges")
    found = materialise(components_of(keyed), "cluster-components")
    placed = keyed.join(found, keyed["a"] == found["node"]).select("component", "a", "b", "ord")
    nodes = graph.nodes.drop("CLUSTER_ID").withColumn("_key", node_key(F.col("c_idx"), F.col("s_idx")))
    if girvan_newman:
        halves = _split_first(materialise(placed, "cluster-placed"), split_edges)
        split = (halves if halves is not None else found.selectExpr("node", "component AS side").limit(0)).withColumnRenamed("node", "_key")
        own = found.select(F.col("node").alias("_key"), "component")
        sides = nodes.join(own, "_key", "left").join(split, "_key", "left").withColumn("_side", F.coalesce("side", "component", "_key"))
        sizes = sides.select("_side").distinct()
        ids = dense_position(sizes, ["_side"], F.shiftright("_side", SHIFT + 10), "_id")
    else:
        m = keyed.count()
        parts = _by_component(placed.select("component", "a", "b"), lambda components: communities(components, m), "node long, side long")
        return numbered_by_size(graph, parts)
    return _with_ids(graph, sides, ids)


def _with_ids(graph: Graph, sides: DataFrame, ids: DataFrame) -> Graph:
    done = sides.join(ids.select("_side", "_id"), "_side").withColumn("CLUSTER_ID", F.col("_id").cast("double"))
    return graph.with_(nodes=done.select(*graph.nodes.columns))


def numbered_by_size(graph: Graph, parts: DataFrame) -> Graph:
    """``parts``: node, side of nodes that aren't alone."""
    nodes = graph.nodes.drop("CLUSTER_ID").withColumn("_key", node_key(F.col("c_idx"), F.col("s_idx")))
    sides = nodes.join(parts.select(F.col("node").alias("_key"), "side"), "_key", "left").withColumn("_side", F.coalesce("side", "_key"))
    sizes = sides.groupBy("_side").agg(F.count(F.lit(1)).alias("_size")).withColumn("_neg", -F.col("_size"))
    # Most communities are alone or small: number them by size, and then by their first node, in buckets.
    ids = dense_position(sizes, ["_neg", "_side"], F.struct("_neg", F.shiftright("_side", SHIFT + 10).alias("b")), "_id")
    return _with_ids(graph, sides, ids)


def cluster_bundles(graph: Graph, edge_type: str) -> Graph:
    """Greedy modularity by a weight that holds for all sentences of two comments, whose edges are never made.

    Components of sentences with edges are those of comments, as all sentences of two comments are tied, and those of one comment by
    itself are if it is tied to itself.
    """
    used = graph.bundles.table.where(F.col(edge_type) != 0)
    own = materialise(used.select(F.col("c_a").cast("long").alias("a"), F.col("c_b").cast("long").alias("b"), F.col("n_a").cast("long").alias("n_a"), F.col("n_b").cast("long").alias("n_b")), "cluster-bundles")
    m = own.agg(F.sum(F.when(F.col("a") == F.col("b"), F.expr("n_a * (n_a - 1) div 2")).otherwise(F.col("n_a") * F.col("n_b")))).first()[0] or 0
    found = components_of(own).union(own.groupBy("a").agg(F.min("a")))  # comments with edges to themselves only
    found = materialise(found.groupBy("node").agg(F.min("component").alias("component")), "cluster-components")
    placed = own.join(found, own["a"] == found["node"]).select("component", "a", "b", "n_a", "n_b")
    # What a component joins is written down, as it is read twice.
    parts = materialise(_by_component(placed, lambda components: communities_of_bundles(components, m), "node long, side long"), "cluster-parts")
    return numbered_by_size(graph, parts)


def cluster(graph: Graph, edge_type: str, algorithm: str = "GirvanNewman", split_edges: int = SPLIT_EDGES) -> Graph:
    used = graph.edges.where(F.col(check_name(edge_type, EDGE_WEIGHTS)) != 0)
    girvan_newman = algorithm.lower().endswith("girvannewman")
    if not girvan_newman and graph.bundles is not None and graph.bundles.holds_for_all(edge_type):
        return cluster_bundles(graph, edge_type)
    return cluster_edges(graph, used, girvan_newman, split_edges)


def cluster_multi(graph: Graph, edge_types: list[str], algorithm: str = "GirvanNewman") -> Graph:
    """Edges with any of the weights. Here the algorithm's name must be exact."""
    used = F.lit(False)
    for kind in edge_types:
        used = used | F.coalesce(F.col(check_name(kind, EDGE_WEIGHTS)) != 0, F.lit(False))
    return cluster_edges(graph, graph.edges.where(used), algorithm == "GirvanNewman")

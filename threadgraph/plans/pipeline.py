"""From comments to a graph, by configuration; its cache; and the sweep over configurations."""

from __future__ import annotations

import hashlib
import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import edges
from ..operators.bundles import edges_in, spread
from ..operators.rank import pagerank_bundles, pageranks
from ..operators.similar import SimilarPairs
from ..schema import ENDS, NODE, Graph, GraphError
from ..sources.comments import positions
from ..sources.versions import Versions
from ..storage import materialise, ranked_position, release
from .config import COMPARATORS, MODIFIERS, pagerank_settings, resolve, run_step


def generate(comments: DataFrame, settings: dict, vectors: DataFrame | None = None, fix_offsets: bool = False) -> Graph:
    nodes = edges.nodes_of(comments, fix_offsets)
    active = [(op, settings[name]) for name, op in COMPARATORS.items() if settings[name] is not None]
    if active and all(op.pairs for op, _ in active):
        return edges.bundled(comments, nodes, [op.pairs(comments, nodes, vectors, **own) for op, own in active])
    parts = [op.apply(comments, nodes, vectors, **own) for op, own in active]
    if not parts:
        parts = [edges.edges_same_comment(nodes, 0.0)]
    return Graph(comments, nodes, edges.assemble(parts))


#: Steps that read the graph many times; it is written down before the first of them.
MANY_READS = ("Merger", "Clusterer", "Adder")


def written(graph: Graph, comments: bool = False) -> Graph:
    """The same graph with its lineage cut; one whose edges come from bundles is written down as those."""
    if graph.bundles is not None:
        bundles = graph.bundles.written()
        own = graph.with_(nodes=materialise(graph.nodes, "nodes"), edges=spread(bundles), bundles=bundles)
    else:
        own = graph.with_(nodes=materialise(graph.nodes, "nodes"), edges=materialise(graph.edges, "edges"))
    return own.with_(comments=materialise(graph.comments, "comments")) if comments else own


def apply_steps(graph: Graph, settings: dict, cut: bool = True) -> Graph:
    for name in MODIFIERS:
        if settings[name] is not None:
            if cut and name.endswith(MANY_READS):
                graph, cut = written(graph), False
            graph = run_step(graph, name, settings[name])
    return graph


def build(comments: DataFrame, overrides: dict | None = None, vectors: DataFrame | None = None, base: dict | None = None, cut: bool = True) -> Graph:
    """``comments`` need reply_to_id; c_idx is added if it isn't there. With ``cut``, the graph is written down after the
    generators, and again before steps that read it many times."""
    settings = resolve(overrides, base)
    placed = comments if "c_idx" in comments.columns else positions(comments)
    if cut:
        placed = materialise(placed, "comments")
    graph = generate(placed, settings, vectors)
    return apply_steps(written(graph) if cut else graph, settings, cut)


def request(comments: DataFrame, article_ids: list[int]) -> DataFrame:
    return comments.where(F.col("article_id").isin([int(a) for a in article_ids]))


def cache_key(article_ids: list[int], overrides: dict | None = None, config_in_cache_key: bool = False) -> str:
    """Sorted article ids as JSON; the settings aren't part of it unless asked for."""
    key = json.dumps(sorted(int(a) for a in article_ids))
    return key + json.dumps(overrides or {}, sort_keys=True) if config_in_cache_key else key


class GraphCache:
    """Graphs as versioned Parquet tables, by key: read if there, else built and stored. A graph's three tables are stored in one
    commit, and one that was read stays as it was when its key is stored anew."""

    PARTS = ("comments", "nodes", "edges")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self, key: str) -> Versions:
        return Versions(self.spark, f"{self.path}/{hashlib.sha256(key.encode()).hexdigest()}")

    def has(self, key: str) -> bool:
        return bool(self.versions(key).current().tables)

    def drop(self, key: str) -> None:
        self.versions(key).commit(lambda base: {})

    def load(self, key: str) -> Graph:
        own = self.versions(key)
        version = own.current()
        return Graph(*[own.read(version, part) for part in self.PARTS])

    def store(self, key: str, graph: Graph) -> None:
        self.versions(key).replace({part: getattr(graph, part) for part in self.PARTS})

    def get(self, comments: DataFrame, article_ids: list[int], overrides: dict | None = None, override_cache: bool = False, ignore_cache: bool = False, config_in_cache_key: bool = False, **options) -> Graph:
        key = cache_key(article_ids, overrides, config_in_cache_key)
        if not ignore_cache and not override_cache and self.has(key):
            return self.load(key)
        graph = build(request(comments, article_ids), overrides, **options)
        if ignore_cache:
            return graph
        self.store(key, graph)
        return self.load(key)


def _json_items(graph: Graph) -> dict[str, tuple[DataFrame, list[str]]]:
    """Comments with their sentences, and edges, as JSON of each (``item``), with the columns that order them."""
    weights = [c for c in graph.nodes.columns if c.isupper()]
    split = F.struct("s_idx", "s", "e", F.struct(*weights).alias("wgts"))
    per = graph.nodes.groupBy("c_idx", "id").agg(F.sort_array(F.collect_list(split)).alias("splits"))  # sentences of a comment
    edge = F.struct("ord", F.struct("src_c", "src_s").alias("src"), F.struct("tgt_c", "tgt_s").alias("tgt"), F.struct(*[c for c in graph.edges.columns if c.isupper()]).alias("wgts"))
    comments = per.select("c_idx", "id", F.to_json(F.struct("c_idx", "id", "splits")).alias("item"))
    return {"comments": (comments, ["c_idx", "id"]), "edges": (graph.edges.select("ord", *ENDS, F.to_json(edge).alias("item")), ["ord", *ENDS])}


DOCUMENT_ROWS = 1_000_000


def to_document(graph: Graph, limit: int = DOCUMENT_ROWS) -> DataFrame:
    """The graph as the API hands it out: one row with JSON of the comments' sentences and of the edges.

    This is for requests whose graph one reader can show: one of over ``limit`` sentences or edges is an error, and
    ``document_parts`` is the form for it.
    """
    parts = []
    for name, (rows, order) in _json_items(graph).items():
        source = graph.nodes if name == "comments" else graph.edges
        if source.limit(limit + 1).count() > limit:
            raise GraphError(f"over {limit} rows of {name}; document_parts gives them in parts")
        listed = F.transform(F.sort_array(F.collect_list(F.struct(*order, "item"))), lambda x: x["item"])
        parts.append(rows.agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias(name)))
    return parts[0].crossJoin(F.broadcast(parts[1]))  # one row each


PART_BUCKET = 4096


def document_parts(graph: Graph, per_part: int = 10_000) -> DataFrame:
    """The document of any graph in parts: kind (comments, edges), part, start, bytes, json.

    The parts of a kind, put together by their number, are the JSON array that ``to_document`` gives; ``start`` is the place of a
    part's first byte in its UTF-8 form. A part holds ``per_part`` comments or edges, and a last one closes the array, which for an
    empty table is all there is. Items are numbered in ranges of their order, so no task sorts them all.
    """
    if per_part < 1:
        raise GraphError("a part holds one item at least")
    out = []
    for name, (rows, order) in _json_items(graph).items():
        placed = ranked_position(rows, order, "_place").withColumn("part", F.floor(F.col("_place") / per_part))
        items = F.transform(F.sort_array(F.collect_list(F.struct("_place", "item"))), lambda x: x["item"])
        joined = placed.groupBy("part").agg(F.array_join(items, ",").alias("_items"))
        made = joined.select("part", F.concat(F.when(F.col("part") == 0, "[").otherwise(","), "_items").alias("json"))
        parts = materialise(made.withColumn("bytes", F.octet_length("json").cast("long")), "document")
        end = parts.agg(F.coalesce(F.max("part") + 1, F.lit(0)).alias("part"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("start"))
        closing = end.select("part", "start", F.when(F.col("part") == 0, "[]").otherwise("]").alias("json")).withColumn("bytes", F.octet_length("json").cast("long"))
        out.append(_started(parts).unionByName(closing).select(F.lit(name).alias("kind"), "part", "start", "bytes", "json"))
    return out[0].union(out[1])


def _started(parts: DataFrame) -> DataFrame:
    """``start``: bytes of all parts before, summed up within buckets of parts, and over the buckets."""
    dealt = parts.withColumn("_bucket", F.floor(F.col("part") / PART_BUCKET))
    sums = dealt.groupBy("_bucket").agg(F.sum("bytes").alias("_sum"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 4,096 parts
    offsets = sums.select("_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_in", F.coalesce(F.sum("bytes").over(within), F.lit(0)))
    return summed.join(offsets, "_bucket").select("part", "bytes", "json", (F.col("_before") + F.col("_in")).alias("start"))


@dataclass
class Branch:
    """A node of the tree of configurations: what its step is, the configurations that end here, and what follows."""

    step: tuple
    ends: list[int] = field(default_factory=list)
    follow: dict[str, Branch] = field(default_factory=dict)


def plan_tree(settings: list[dict]) -> dict[str, Branch]:
    """Configurations as paths of steps, of which equal beginnings are one: generators first, then modifiers in their order."""
    trunk: dict[str, Branch] = {}
    for k, own in enumerate(settings):
        steps = [("generate", {name: own[name] for name in COMPARATORS})]
        steps += [(name, own[name]) for name in MODIFIERS if own[name] is not None]
        level = trunk
        for name, parameters in steps:
            branch = level.setdefault(repr((name, parameters)), Branch((name, parameters)))
            level = branch.follow
        branch.ends.append(k)
    return trunk


#: Filters by a node's weight that a ranker without edges, or PageRank, gives.
NODE_FILTERS = tuple(f"{kind}{how}Filter" for kind in ("PageRank", "Votes", "Size", "Recency", "Toxicity") for how in ("", "Bottom"))


class Sweep:
    """Runs a tree of configurations. A step that others share is written down once and deleted behind the last of them; edges of
    all configurations of a generator are counted in one job. Branches run side by side, and their jobs share the executors."""

    def __init__(self, comments: DataFrame, vectors: DataFrame | None, pool: ThreadPoolExecutor):
        self.comments, self.vectors, self.pool = comments, vectors, pool
        self.found: dict[int, tuple[int, int, int | None]] = {}
        self.seconds: dict[int, float] = {}

    def start(self, work, *arguments):
        return self.pool.submit(inheritable_thread_target(self.comments.sparkSession)(work), *arguments)

    def spent(self, branch: Branch, began: float) -> None:
        """Time of a shared step counts for the first configuration behind it."""
        while not branch.ends:
            branch = next(iter(branch.follow.values()))
        self.seconds[branch.ends[0]] = self.seconds.get(branch.ends[0], 0.0) + time.perf_counter() - began

    def grown(self, branch: Branch) -> tuple[Graph, list[DataFrame]]:
        began = time.perf_counter()
        if self.implied(branch):
            own = branch.step[1]["SimilarityComparator"]
            nodes = materialise(edges.nodes_of(self.comments), "nodes")
            pairs = SimilarPairs.of(self.comments, nodes, self.vectors, own["max_similarity"], own["base_weight"])
            self.spent(branch, began)
            return Graph(self.comments, nodes, None, pairs), [nodes, pairs.known]
        graph = written(generate(self.comments, branch.step[1], self.vectors))
        self.spent(branch, began)
        return graph, [graph.nodes, graph.edges if graph.bundles is None else graph.bundles.table]

    @staticmethod
    def implied(branch: Branch) -> bool:
        """Whether edges are of SIMILARITY alone and all that follows asks for sums over them, or a forest: they are then never made."""
        if [name for name, own in branch.step[1].items() if own is not None] != ["SimilarityComparator"]:
            return False
        for after in branch.follow.values():
            name, own = after.step
            if name == "PageRanker" and (own["edge_type"] != "SIMILARITY" or not own["use_power_mode"]):
                return False
            if name not in ("PageRanker", "VotesRanker", "SizeRanker", "RecencyRanker", "ToxicityRanker", "SimilarityNodeMerger"):
                return False
            if any(last.follow or last.step[0] not in NODE_FILTERS for last in after.follow.values()):
                return False
        return True

    def counted(self, counts: list[tuple[int, Graph]], graph: Graph) -> None:
        began = time.perf_counter()
        if isinstance(graph.bundles, SimilarPairs):
            before, *sizes = graph.bundles.edges([own.bundles for _, own in counts])
            grouped = {k: own.nodes.agg(F.count_distinct(own.nodes.grouped)).first()[0] for k, own in counts if getattr(own.nodes, "grouped", None)}
            for (k, _), n in zip(counts, sizes, strict=True):
                self.found[k] = (n, before - n, grouped.get(k))
                self.seconds[k] = self.seconds.get(k, 0.0) + (time.perf_counter() - began) / len(counts)
            return
        rows = reduce(DataFrame.union, [self.size(graph, -1), *[self.size(own, k) for k, own in counts]]).collect()  # a row for each configuration
        sizes = {r["k"]: (r["n"], r["groups"]) for r in rows}
        before = sizes.pop(-1)[0]
        for k, (n, groups) in sizes.items():
            self.found[k] = (n, before - n, groups)
            self.seconds[k] = self.seconds.get(k, 0.0) + (time.perf_counter() - began) / len(counts)

    @staticmethod
    def size(graph: Graph, k: int) -> DataFrame:
        """Number of edges, and of groups if a step has grouped the nodes."""
        if graph.bundles is None:
            own = graph.edges.agg(F.count(F.lit(1)).alias("n"))
        else:
            own = graph.bundles.table.agg(F.coalesce(F.sum(edges_in(graph.bundles)), F.lit(0)).alias("n"))
        groups = getattr(graph.nodes, "grouped", None)
        if groups is None:
            return own.select(F.lit(k).alias("k"), "n", F.lit(None).cast("long").alias("groups"))
        return own.crossJoin(F.broadcast(graph.nodes.agg(F.count_distinct(groups).alias("groups")))).select(F.lit(k).alias("k"), "n", "groups")  # one row each

    def follow(self, graph: Graph, after: Branch, ranked: Graph | None = None) -> tuple[list, list[DataFrame]]:
        """Configurations behind a step of a graph, with their graphs, and what was written down for them."""
        began = time.perf_counter()
        name, parameters = after.step
        own, steps = ranked if ranked is not None else run_step(graph, name, parameters), []
        ids = next((column for kind, column in (("Merger", "MERGE_ID"), ("Clusterer", "CLUSTER_ID")) if name.endswith(kind)), None)
        if ids or after.follow:
            own = own.with_(nodes=materialise(own.nodes, "sweep-nodes"))
            own.nodes.grouped = ids
            steps.append(own.nodes)
        if after.follow and own.edges is not graph.edges:
            own = own.with_(edges=materialise(own.edges, "sweep-edges"))
            steps.append(own.edges)
        self.spent(after, began)
        counts = [(k, own) for k in after.ends]
        for branch in after.follow.values():
            more, written_ = self.follow(own, branch)
            counts, steps = counts + more, steps + written_
        return counts, steps

    def run(self, trunk: dict[str, Branch]) -> None:
        grown = [(branch, self.start(self.grown, branch)) for branch in trunk.values()]
        started = []
        for branch, made in grown:
            graph, steps = made.result()
            ranked, parts = [], []
            for after in self.alike(graph, branch):
                if after.step[0] == "PageRanker" and after.step[1]["use_power_mode"]:
                    ranked.append((graph, after))
                else:
                    parts.append(self.start(lambda own, step: [self.follow(own, step)], graph, after))
            if ranked:
                parts.append(self.start(self.rank, ranked))
            started.append((branch, graph, steps, parts))
        results = [(branch, graph, steps, [one for part in parts for one in part.result()]) for branch, graph, steps, parts in started]
        counting = []
        for branch, graph, steps, parts in results:
            counts = [(k, graph) for k in branch.ends] + [pair for more, _ in parts for pair in more]
            counting.append((self.start(self.counted, counts, graph), steps))
        for done, _ in counting:
            done.result()
        for _, _, steps, parts in results:
            release(*steps, *[step for _, written_ in parts for step in written_])

    def rank(self, branches: list[tuple[Graph, Branch]]) -> list[tuple[list, list[DataFrame]]]:
        """PageRank steps in one go, and what follows each."""
        began = time.perf_counter()
        graphs: list[tuple[Graph, str]] = []
        runs = []
        for graph, after in branches:
            own = pagerank_settings(**after.step[1])
            place = next((k for k, (known, kind) in enumerate(graphs) if known is graph and kind == own["edge_type"]), len(graphs))
            if place == len(graphs):
                graphs.append((graph, own["edge_type"]))
            runs.append((place, own["damping"], own["iterations"], own["tolerance"]))
        bundled = {k for k, (graph, kind) in enumerate(graphs) if graph.bundles is not None and graph.bundles.holds_for_all(kind)}
        places = [k for k in range(len(graphs)) if k not in bundled]
        apart = [(places.index(k), *own) for k, *own in runs if k not in bundled]
        rest = iter(pageranks([(graphs[k][0].nodes, graphs[k][0].edges, graphs[k][1]) for k in places], apart) if apart else [])
        found = [pagerank_bundles(graphs[k][0].nodes, graphs[k][0].bundles, graphs[k][1], *own) if k in bundled else next(rest) for k, *own in runs]
        self.spent(branches[0][1], began)
        return [self.follow(graph, after, graph.with_(nodes=graph.nodes.drop("PAGERANK").join(ranks, list(NODE), "left"))) for (graph, after), ranks in zip(branches, found, strict=True)]

    def alike(self, graph: Graph, branch: Branch) -> list[Branch]:
        """What follows a generator; mergers of a type by several thresholds are one if as many edges qualify, as these are then the same."""
        out, mergers = [], []
        for after in branch.follow.values():
            (mergers if after.step[0].endswith("NodeMerger") and "threshold" in after.step[1] and not after.follow else out).append(after)
        if not mergers:
            return out
        began = time.perf_counter()
        kinds = dict(zip(("Similarity", "ReplyTo", "SameComment", "SameArticle", "SameGroup", "Temporal"), ("SIMILARITY", "REPLY_TO", "SAME_COMMENT", "SAME_ARTICLE", "SAME_GROUP", "TEMPORAL"), strict=True))
        tests, limits, whole = [], [], graph.bundles is not None
        for k, after in enumerate(mergers):
            name, own = after.step
            kind = own.get("edge_weight_type") or kinds[name.removesuffix("NodeMerger")]
            weight = F.col(kind)
            limits.append((own["threshold"], own["smaller_as"]))
            tests.append(F.count(F.when(weight <= own["threshold"] if own["smaller_as"] else weight >= own["threshold"], 1)).alias(str(k)))
            whole = whole and graph.bundles.holds_for_all(kind)
        # As many bundles are as many edges, if their weights hold for all: those by one threshold are among those by another.
        if isinstance(graph.bundles, SimilarPairs):
            row = {str(k): n for k, n in enumerate(graph.bundles.counts(limits))}
        else:
            row = (graph.bundles.table if whole else graph.edges).agg(*tests).first()
        same: dict[tuple, Branch] = {}
        for k, after in enumerate(mergers):
            key = (after.step[0], after.step[1]["smaller_as"], after.step[1].get("edge_weight_type"), row[str(k)])
            if key in same:
                same[key].ends += after.ends
            else:
                same[key] = Branch(after.step, list(after.ends))
        self.spent(mergers[0], began)
        return out + list(same.values())


AT_ONCE = 8  # branches of a sweep that run at the same time


def sweep(comments: DataFrame, configs: list[tuple[str, dict]], vectors: DataFrame | None = None) -> DataFrame:
    """A row for each configuration (label, settings; labels may repeat): id, description, remaining and removed edges, seconds, and
    the number of groups if its last step merges or clusters nodes.

    Configurations are run as a tree, so that what they have in common is done once. Time of a common step counts for the first of
    them, that of a common count for all alike.
    """
    placed = materialise(comments, "sweep-comments")
    with ThreadPoolExecutor(AT_ONCE) as pool:
        run = Sweep(placed, vectors, pool)
        run.run(plan_tree([resolve(overrides) for _, overrides in configs]))
    rows = [(k, label, *run.found[k], run.seconds[k]) for k, (label, _) in enumerate(configs)]
    release(placed)
    return comments.sparkSession.createDataFrame(rows, "config_id long, description string, remaining_edges long, removed_edges long, groups long, seconds double")


def write_sweep(result: DataFrame, path: str) -> None:
    """A sweep as CSV, under the benchmark's column names; it has a row for each configuration, and so one file."""
    names = {"config_id": "configuration ID", "description": "Description", "remaining_edges": "remaining edges", "removed_edges": "removed edges", "seconds": "seconds"}
    result.select(*[F.col(c).alias(n) for c, n in names.items()]).coalesce(1).write.mode("overwrite").csv(path, header=True)

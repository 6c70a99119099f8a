"""Node rankers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, token_window
from ..schema import NODE, Graph, GraphError, check_name, EDGE_WEIGHTS
from ..storage import materialise, release
from .bundles import Bundles
from .similar import SimilarPairs

UPVOTES = ("upvotes", "leseempfehlungen", "likes", "love", "recommended")
PAGERANK_DIGITS = 12  # sums of another order of addition are then equal
BROADCAST_NODES = 500_000  # ranks of so many nodes, 12 MB, may be broadcast


def size(graph: Graph) -> Graph:
    return graph.with_(nodes=graph.nodes.withColumn("SIZE", (F.col("e") - F.col("s")).cast("double")))


def votes_of(use_upvotes: bool = True, use_downvotes: bool = True) -> Column:
    """Downvotes count like upvotes."""
    terms = [F.coalesce(c, F.lit(0)) for c in (UPVOTES if use_upvotes else ()) + (("downvotes",) if use_downvotes else ())]
    return reduce(lambda a, b: a + b, terms, F.lit(0)).cast("double")


def _of_comment(graph: Graph, column: Column, name: str) -> Graph:
    own = graph.comments.select("c_idx", column.alias("_w"))
    return graph.with_(nodes=graph.nodes.join(own, "c_idx", "left").withColumn(name, F.col("_w")).drop("_w"))


def votes(graph: Graph, use_upvotes: bool = True, use_downvotes: bool = True) -> Graph:
    return _of_comment(graph, votes_of(use_upvotes, use_downvotes), "VOTES")


def recency(graph: Graph, use_youngest: bool = False) -> Graph:
    """Seconds after the oldest comment, or before the youngest."""
    edge = graph.comments.agg((F.max if use_youngest else F.min)(F.unix_micros("ts")).alias("_edge"))
    own = graph.comments.crossJoin(F.broadcast(edge))  # one row
    gap = F.col("_edge") - F.unix_micros("ts") if use_youngest else F.unix_micros("ts") - F.col("_edge")
    return _of_comment(graph.with_(comments=own), gap / 1_000_000, "RECENCY").with_(comments=graph.comments)


def endpoints(edges: DataFrame) -> DataFrame:
    """A row for each edge and end: the node, and the edge's columns."""
    ends = F.array(F.struct(F.col("src_c").alias("c_idx"), F.col("src_s").alias("s_idx")), F.struct(F.col("tgt_c").alias("c_idx"), F.col("tgt_s").alias("s_idx")))
    return edges.withColumn("_end", F.explode(F.array_distinct(ends))).select("_end.*", *edges.columns)


def degree(graph: Graph) -> Graph:
    counted = endpoints(graph.edges.select("src_c", "src_s", "tgt_c", "tgt_s")).groupBy(*NODE).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    nodes = graph.nodes.join(counted, list(NODE), "left").withColumn("DEGREE_CENTRALITY", F.coalesce("_w", F.lit(0.0))).drop("_w")
    return graph.with_(nodes=nodes)


def _by_run(values: dict[int, float]) -> Column:
    """The value of a row's sequence ``q``."""
    if len(set(values.values())) == 1:
        return F.lit(next(iter(values.values())))
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("q")]


def pageranks(graphs: list[tuple[DataFrame, DataFrame, str]], runs: list[tuple[int, float, int, float]], every: int = 5) -> list[DataFrame]:
    """c_idx, s_idx, PAGERANK of each run (place of its graph, damping, iterations, tolerance), by power iteration from uniform ranks,
    which stops at an L2 change of the tolerance. ``graphs``: nodes, edges, edge type.

    All runs advance together, and those that differ only in their number of iterations are one sequence. Rank of nodes without
    outgoing weight is spread evenly. Each iteration is a join and a sum by target, combined before its shuffle; the driver sees
    three numbers for each sequence, and the lineage is cut every few iterations.
    """
    sequences = list(dict.fromkeys((g, damping, tolerance) for g, damping, _, tolerance in runs))
    key = ["q", *NODE] if len(sequences) > 1 else list(NODE)
    taken = []
    for k, (_, edges, kind) in enumerate(graphs):
        weight = F.col(check_name(kind, EDGE_WEIGHTS))
        taken.append(edges.where(weight != 0).select(F.lit(k).alias("g"), "src_c", "src_s", F.col("tgt_c").alias("c_idx"), F.col("tgt_s").alias("s_idx"), weight.alias("w")))
    used = materialise(reduce(DataFrame.union, taken), "pagerank-edges")
    found = {r["g"] for r in used.select("g").distinct().collect()}  # a row for each graph
    for k, (_, _, kind) in enumerate(graphs):
        if k not in found:
            raise GraphError(f"no edge has a {kind} weight")
    # Edges stay dealt by target, as nodes are, so an iteration only moves the ranks.
    parts = int(used.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = used.repartition(parts, *NODE).persist()
    given = used.groupBy("g", F.col("src_c").alias("c_idx"), F.col("src_s").alias("s_idx")).agg(F.sum("w").alias("r"))
    all_nodes = reduce(DataFrame.union, [nodes.select(F.lit(k).alias("g"), *NODE) for k, (nodes, _, _) in enumerate(graphs)])
    base = materialise(all_nodes.join(given, ["g", *NODE], "left"), "pagerank-nodes")
    counts = {r["g"]: (r["n"], r["k"]) for r in base.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count("r").alias("k")).collect()}
    giving = {q: counts[g][1] / counts[g][0] for q, (g, _, _) in enumerate(sequences)}
    start = reduce(DataFrame.union, [base.where(F.col("g") == g).select(F.lit(q).alias("q"), "g", *NODE, "r", F.lit(1.0 / counts[g][0]).alias("x")) for q, (g, _, _) in enumerate(sequences)])
    x = start.repartition(parts, *NODE).persist()
    gives = F.col("r").isNotNull()
    out: dict[int, DataFrame] = {}
    k = 0
    while len(out) < len(runs):
        k += 1
        active = sorted({sequences.index((g, d, t)) for i, (g, d, _, t) in enumerate(runs) if i not in out})
        leaks = {q: ((1 - sequences[q][1]) * giving[q] + (1 - giving[q])) / counts[sequences[q][0]][0] for q in active}
        now = x.where(F.col("q").isin(active)) if len(sequences) > 1 else x
        source = now.where(gives).select(*(["q"] if len(sequences) > 1 else []), "g", F.col("c_idx").alias("src_c"), F.col("s_idx").alias("src_s"), (F.col("x") / F.col("r")).alias("x"))
        if sum(counts[sequences[q][0]][0] for q in active) <= BROADCAST_NODES:
            source = F.broadcast(source)
        open_graphs = sorted({sequences[q][0] for q in active})
        got = (share.where(F.col("g").isin(open_graphs)) if len(graphs) > 1 else share).join(source, ["g", "src_c", "src_s"])
        got = got.groupBy(*key).agg(F.sum(F.col("w") * F.col("x")).alias("in"))
        damping = _by_run({q: sequences[q][1] for q in active})
        new = now.join(got, key, "left").select("q", "g", *NODE, "r", F.col("x").alias("old"), (damping * F.coalesce("in", F.lit(0.0)) + _by_run(leaks)).alias("x"))
        before, x = x, materialise(new, "pagerank") if k % every == 0 else new.persist()
        rows = x.groupBy("q").agg(F.sqrt(F.sum((F.col("x") - F.col("old")) ** 2)).alias("change"), F.sum(F.when(gives, F.col("x")).otherwise(0.0)).alias("giving"), F.sum("x").alias("all")).collect()
        before.unpersist()
        for row in rows:
            q = row["q"]
            giving[q] = row["giving"] / row["all"]
            ends = [i for i, (g, d, most, t) in enumerate(runs) if i not in out and (g, d, t) == sequences[q] and (k >= most or row["change"] <= t)]
            if ends:
                last = x.where(F.col("q") == q).select(*NODE, F.round(F.col("x") / row["all"], PAGERANK_DIGITS).alias("PAGERANK"))
                last = materialise(last, "pagerank-ranks")
                out |= dict.fromkeys(ends, last)
    x.unpersist()
    share.unpersist()
    return [out[i] for i in range(len(runs))]


def pagerank_of(nodes: DataFrame, edges: DataFrame, edge_type: str = "TEMPORAL", damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-6, every: int = 5) -> DataFrame:
    return pageranks([(nodes, edges, edge_type)], [(0, damping, iterations, tolerance)], every)[0]


def pagerank_bundles(nodes: DataFrame, bundles: Bundles | SimilarPairs, edge_type: str, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-6, every: int = 5) -> DataFrame:
    """As ``pagerank_of``, over a weight that holds for all sentences of two comments.

    What a comment hands to another one is the same for each of its sentences, so it is summed up by comment before it meets the
    pairs of comments; within a comment, a sentence gets what those before it give. Edges of sentences are never made.
    """
    weight = F.col(check_name(edge_type, EDGE_WEIGHTS))
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    implied = isinstance(bundles, SimilarPairs)
    if implied:  # no pair is of one comment
        inner = nodes.where("false").select("c_idx", F.lit(0).cast("long").alias("_n"), F.lit(0.0).alias("_w"))
        outer = bundles.given()
    else:
        used = bundles.table.where(weight != 0)
        pairs = materialise(used.where("c_a < c_b").select("c_a", "c_b", "n_b", weight.alias("w")), "pagerank-pairs")
        inner = used.where("c_a = c_b").select(F.col("c_a").alias("c_idx"), F.col("n_a").alias("_n"), weight.alias("_w"))
        outer = pairs.groupBy(F.col("c_a").alias("c_idx")).agg(F.sum(F.col("w") * F.col("n_b")).alias("_out"))
    # r: all weight that a sentence gives; those after it in its comment and those of later comments take it.
    after = F.col("_n") - 1 - F.col("s_idx")
    given = F.when(F.col("_out").isNotNull() | (after > 0), F.coalesce("_out", F.lit(0.0)) + F.coalesce(F.col("_w") * after, F.lit(0.0)))
    base = materialise(nodes.select(*NODE).join(outer, "c_idx", "left").join(inner, "c_idx", "left").select(*NODE, F.col("_w").alias("own"), given.alias("r")), "pagerank-nodes")
    row = base.agg(F.count(F.lit(1)).alias("n"), F.count("r").alias("k")).first()
    n, giving = row["n"], row["k"] / max(row["n"], 1)
    if not row["k"]:
        raise GraphError(f"no edge has a {edge_type} weight")
    share = None if implied else pairs.select("c_a", "c_b", "w").repartition(parts, "c_a").persist()
    dealt = lambda df: df.repartition(parts, "c_idx").persist()
    x = dealt(base.withColumn("x", F.lit(1.0 / n)))
    gives = F.col("r").isNotNull()
    before_it = Window.partitionBy("c_idx").orderBy("s_idx").rowsBetween(Window.unboundedPreceding, -1)
    kept: list[DataFrame] = []
    for k in range(1, max(iterations, 1) + 1):
        leak = ((1 - damping) * giving + (1 - giving)) / n
        handed = x.where(gives).groupBy(F.col("c_idx").alias("c_a")).agg(F.sum(F.col("x") / F.col("r")).alias("z"))
        got = bundles.received(handed) if implied else share.hint("merge").join(handed, "c_a").groupBy(F.col("c_b").alias("c_idx")).agg(F.sum(F.col("w") * F.col("z")).alias("in"))
        inside = F.coalesce(F.col("own") * F.sum(F.col("x") / F.col("r")).over(before_it), F.lit(0.0))
        new = x.withColumn("_inside", inside).hint("merge").join(got, "c_idx", "left")
        new = new.select(*NODE, "own", "r", F.col("x").alias("old"), (damping * (F.coalesce("in", F.lit(0.0)) + F.col("_inside")) + leak).alias("x"))
        past = x
        if k % every:
            x = new.persist()
        else:
            kept.append(materialise(new, "pagerank"))
            x = dealt(kept[-1])
        row = x.agg(F.sqrt(F.sum((F.col("x") - F.col("old")) ** 2)).alias("change"), F.sum(F.when(gives, F.col("x")).otherwise(0.0)).alias("giving"), F.sum("x").alias("all")).first()
        past.unpersist()
        giving = row["giving"] / row["all"]
        if row["change"] <= tolerance:
            break
    out = materialise(x.select(*NODE, F.round(F.col("x") / row["all"], PAGERANK_DIGITS).alias("PAGERANK")), "pagerank-ranks")
    x.unpersist()
    if not implied:
        share.unpersist()
    release(base, *kept, *([] if implied else [pairs]))
    return out


def _minus_walk(vectors: DataFrame, share: DataFrame, column: str, name: str, damping: float) -> DataFrame:
    """``vectors`` with ``name``: (I - damping * A) of a column, where A moves each node's value along its edges.

    Nothing is broadcast, as that goes through the driver, twice in each iteration.
    """
    source = vectors.select(F.col("c_idx").alias("src_c"), F.col("s_idx").alias("src_s"), F.col(column).alias("_z"))
    got = share.hint("merge").join(source, ["src_c", "src_s"]).groupBy(*NODE).agg(F.sum(F.col("p") * F.col("_z")).alias("_in"))
    return vectors.hint("merge").join(got, list(NODE), "left").withColumn(name, F.col(column) - damping * F.coalesce("_in", F.lit(0.0))).drop("_in")


def pagerank_exact(nodes: DataFrame, edges: DataFrame, edge_type: str = "TEMPORAL", damping: float = 0.85, tolerance: float = 1e-12, iterations: int = 200) -> DataFrame:
    """c_idx, s_idx, PAGERANK as the solution of its equations, to a relative residual of ``tolerance``; an error if that isn't met.

    Ranks are a multiple of the y with (I - damping * A) y = 1, as all that nodes without outgoing weight spread evenly only scales
    them. It is solved by stabilised biconjugate gradients over a table of nodes: two joins with the edges in each iteration, whose
    vectors are written down, and a few sums for the driver. Where these break down, or end short of the tolerance, plain steps
    along the residual follow, which always converge, by the damping each time.
    """
    weight = F.col(check_name(edge_type, EDGE_WEIGHTS))
    used = edges.where(weight != 0).select("src_c", "src_s", F.col("tgt_c").alias("c_idx"), F.col("tgt_s").alias("s_idx"), weight.alias("w"))
    given = used.groupBy("src_c", "src_s").agg(F.sum("w").alias("r"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = materialise(used.join(given, ["src_c", "src_s"]).select("src_c", "src_s", *NODE, (F.col("w") / F.col("r")).alias("p")), "pagerank-share")
    if share.isEmpty():
        raise GraphError(f"no edge has a {edge_type} weight")
    share = share.repartition(parts, "src_c", "src_s").persist()
    # A node without edges has a y of 1, which the walk never changes.
    ends = share.select(F.col("src_c").alias("c_idx"), F.col("src_s").alias("s_idx")).union(share.select(*NODE)).distinct()
    linked = nodes.select(*NODE).hint("merge").join(ends, list(NODE), "left_semi")
    alone = materialise(nodes.select(*NODE).hint("merge").join(ends, list(NODE), "left_anti"), "pagerank-alone")
    x = materialise(linked.select(*NODE, F.lit(0.0).alias("x"), F.lit(1.0).alias("r"), F.lit(1.0).alias("p")), "pagerank-exact")
    n, others = x.count(), alone.count()
    times = lambda vectors, column, name: materialise(_minus_walk(vectors, share, column, name, damping), "pagerank-exact")
    rho, left = float(n), 1.0
    for _ in range(iterations):
        x = times(x, "p", "v")
        moved = x.agg(F.sum("v").alias("v")).first()["v"]
        if abs(moved) < 1e-200 or abs(rho) < 1e-200:
            break
        alpha = rho / moved
        x = times(x.withColumn("s", F.col("r") - alpha * F.col("v")), "s", "t")
        row = x.agg(F.sum(F.col("t") * F.col("s")).alias("ts"), F.sum(F.col("t") ** 2).alias("tt"), F.sum(F.col("s") ** 2).alias("ss"), F.sum("s").alias("s"), F.sum("t").alias("t")).first()
        omega = row["ts"] / row["tt"] if row["tt"] else 0.0
        new = row["s"] - omega * row["t"]
        beta = new / rho * alpha / omega if omega else 0.0
        step, rest = F.col("x") + alpha * F.col("p") + omega * F.col("s"), F.col("s") - omega * F.col("t")
        x = x.select(*NODE, step.alias("x"), rest.alias("r"), (rest + beta * (F.col("p") - omega * F.col("v"))).alias("p"))
        rho, left = new, (max(row["ss"] - 2 * omega * row["ts"] + omega**2 * row["tt"], 0.0) / n) ** 0.5
        if left <= tolerance or not omega:
            break
    x = x.select(*NODE, "x")
    for _ in range(10 * iterations):
        x = times(x, "x", "v")
        row = x.agg(F.sqrt(F.sum((1 - F.col("v")) ** 2) / n).alias("left"), F.sum("x").alias("all")).first()
        if row["left"] <= tolerance:
            share.unpersist()
            every = x.select(*NODE, "x").union(alone.select(*NODE, F.lit(1.0).alias("x")))
            return every.select(*NODE, F.round(F.col("x") / (row["all"] + others), PAGERANK_DIGITS).alias("PAGERANK"))
        x = x.select(*NODE, (F.col("x") + 1 - F.col("v")).alias("x"))
    raise GraphError(f"ranks are not settled: a residual of {row['left']} is left")


def pagerank(graph: Graph, **options) -> Graph:
    exact = options.pop("exact", False)
    kind = options.get("edge_type", "TEMPORAL")
    if not exact and graph.bundles is not None and graph.bundles.holds_for_all(kind):
        ranks = pagerank_bundles(graph.nodes, graph.bundles, **{"edge_type": kind} | options)
        return graph.with_(nodes=graph.nodes.drop("PAGERANK").join(ranks, list(NODE), "left"))
    ranks = (pagerank_exact if exact else pagerank_of)(graph.nodes, graph.edges, **options)
    return graph.with_(nodes=graph.nodes.drop("PAGERANK").join(ranks, list(NODE), "left"))


def stub_score(tokens: Column) -> Column:
    """Deterministic stand-in for a toxicity model: share of the window's tokens with a mark or a capital."""
    real = F.filter(tokens, lambda t: t != "")
    marked = F.filter(real, lambda t: t.rlike(r"[A-Z!?]"))
    return F.when(F.size(real) == 0, 0.0).otherwise(F.size(marked) / F.size(real))


def toxicity(graph: Graph, window: int = 125, whole_comment: bool = True, scorer=stub_score) -> Graph:
    """``scorer`` turns a token window into a number: an expression, or a pandas UDF around a model."""
    if whole_comment:
        return _of_comment(graph, scorer(token_window(normalize(F.col("text")), window)), "TOXICITY")
    from ..functions.text import split_text

    texts = graph.comments.select("c_idx", F.col("text").alias("_text"))
    own = scorer(token_window(normalize(split_text(F.col("_text"), F.col("s"), F.col("e"))), window))
    return graph.with_(nodes=graph.nodes.join(texts, "c_idx", "left").withColumn("TOXICITY", own).drop("_text"))

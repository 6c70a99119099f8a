"""Edges that come from bundles of two comments against edges generated one by one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadgraph.operators import community, edges, filters, merge, rank
from threadgraph.plans import pipeline
from threadgraph.schema import EDGE_WEIGHTS, ENDS, NODE, Graph
from threadgraph.sources import comments as src

WORDS = "One sentence stands here. Another sentence is here. And a third one follows. "


@pytest.fixture(scope="module")
def comments(spark):
    rows = []
    for k in range(24):
        text = [WORDS * 2, WORDS, "A single sentence is here.", None, ""][k % 5]
        rows.append((5 + 2 * k, k % 3, f"c{k}", float([0, 10, 990, 1000, 400][k % 5] + 700 * (k // 5)) if k % 7 else None, text, f"c{k - 3}" if k > 2 else None))
    df = spark.createDataFrame(rows, "id long, article_id long, comment_id string, at double, text string, reply_to string")
    df = df.withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))
    return src.positions(src.resolve_replies(src.conform(df))).persist()


def both(comments, root=True):
    n = edges.nodes_of(comments)
    one = edges.assemble([edges.edges_same_article(n, only_root=root), edges.edges_same_comment(n, only_consecutive=root), edges.edges_reply_to(comments, n, only_root=root), edges.edges_temporal(comments, n)])
    parts = [edges.pairs_same_article(n, only_root=root), edges.pairs_same_comment(n, only_consecutive=root), edges.pairs_reply_to(comments, only_root=root), edges.pairs_temporal(comments)]
    return Graph(comments, n, one), edges.bundled(comments, n, parts)


def rows(df, *columns):
    return sorted(df.select(*[F.to_json(F.struct(*columns)).alias("j")]).toPandas()["j"])


@pytest.mark.parametrize("root", [True, False])
def test_edges(comments, root):
    plain, graph = both(comments, root)
    want = rows(plain.edges, *ENDS, *EDGE_WEIGHTS, "ord")
    assert len(want) > 100 and rows(graph.edges, *ENDS, *EDGE_WEIGHTS, "ord") == want
    assert rows(pipeline.written(graph).edges, *ENDS, *EDGE_WEIGHTS, "ord") == want


@pytest.mark.parametrize("k, descending", [(1, True), (2, True), (2, False), (7, False)])
def test_first_edges_of_every_sentence(comments, k, descending):
    plain, graph = (pipeline.written(g) for g in both(comments))
    for kind in ("TEMPORAL", "REPLY_TO"):
        want = filters.edge_top(plain, k, kind, descending).edges
        assert rows(filters.edge_top(graph, k, kind, descending).edges, *ENDS, "ord") == rows(want, *ENDS, "ord")
    again = filters.edge_top(filters.edge_threshold(graph, 0.3, "TEMPORAL"), k, "TEMPORAL", descending)
    assert rows(again.edges, *ENDS, "ord") == rows(filters.edge_top(filters.edge_threshold(plain, 0.3, "TEMPORAL"), k, "TEMPORAL", descending).edges, *ENDS, "ord")


@pytest.mark.parametrize("smaller", [False, True])
def test_merge_ids(comments, smaller):
    plain, graph = (pipeline.written(g) for g in both(comments))
    for t in (0.05, 0.5, 0.99):
        assert rows(merge.merge(graph, t, "TEMPORAL", smaller).nodes, *NODE, "MERGE_ID") == rows(merge.merge(plain, t, "TEMPORAL", smaller).nodes, *NODE, "MERGE_ID")


def test_pagerank(comments):
    plain, graph = (pipeline.written(g) for g in both(comments))
    for options in ({"iterations": 1, "tolerance": 0.0}, {"iterations": 7, "tolerance": 0.0, "damping": 0.5}, {"tolerance": 1e-6}):
        want = {(r.c_idx, r.s_idx): r.PAGERANK for r in rank.pagerank(plain, **options).nodes.collect()}
        got = {(r.c_idx, r.s_idx): r.PAGERANK for r in rank.pagerank(graph, **options).nodes.collect()}
        assert got == pytest.approx(want, abs=2e-12)


def test_few_rows_are_written_and_ranked(comments):
    """What is written down, and what the first edges are picked from, has a row for two comments, not for two sentences."""
    from threadgraph.operators.bundles import for_top

    _, graph = both(comments)
    kept = pipeline.written(graph)
    pairs = graph.edges.select("src_c", "tgt_c").distinct().count()
    assert kept.bundles.table.count() == pairs < graph.edges.count() / 2
    assert for_top(graph.bundles, 1, "TEMPORAL", True).table.count() < pairs


@pytest.mark.parametrize("block_rows", [3, 8, None])
def test_similar_comments_are_left_out_in_blocks(spark, comments, block_rows):
    """Blocks give the first neighbours and what isn't tied yet, not all pairs; missing vectors tie many weights."""
    vectors = spark.createDataFrame([(k, [float(k % 3), float(k % 4 - 2), 1.0] if k % 6 else [0.0, 0.0, 0.0]) for k in range(0, 24) if k % 5 < 3], "vec_id long, embedding array<float>")
    near = {(r.c_a, r.c_b): r.SIMILARITY for r in edges.similar_comments(comments, vectors).collect()}
    for k, descending in ((1, True), (2, True), (2, False), (30, True)):
        want = set()
        for c in range(24):
            mine = sorted((-w if descending else w, a + b - c, (a, b)) for (a, b), w in near.items() if c in (a, b))
            want |= {pair for _, _, pair in mine[:k]}
        got = {(r.c_a, r.c_b): r.SIMILARITY for r in edges.first_similar(comments, vectors, k, descending, block_rows=block_rows).collect()}
        assert want <= set(got) and all(near[p] == w for p, w in got.items())
        assert block_rows or len(got) <= 2 * k * 24
    kept = [(r.c_a, r.c_b) for r in edges.tied_similar(comments, vectors, lambda w: w >= 0.3, block_rows=block_rows).collect()]
    assert len(set(kept)) == len(kept) and all(near[p] >= 0.3 for p in kept)
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in sorted(p for p, w in near.items() if w >= 0.3):
        if find(a) != find(b):
            root[find(a)] = find(b)
            assert (a, b) in kept
    assert block_rows or len(kept) < 24


@pytest.mark.parametrize("seed", range(60))
def test_modularity_of_alike_sentences(seed):
    """Comments as units give the communities that their sentences give one by one, with ties in the same order."""
    rng = random.Random(seed)
    n, reach = rng.randint(1, 25), rng.choice([1, 3, 9])
    size = [rng.randint(1, rng.choice([2, 9])) for _ in range(n)]
    chain = [(k, k + 1) for k in range(n - 1)]
    pairs = sorted({*chain, *((a, b) for a in range(n) for b in range(a + 1, min(n, a + reach + 1)) if rng.random() < 0.8), *((c, c) for c in range(n) if size[c] > 1 and rng.random() < rng.choice([0, 0.7, 1]))})
    ends = [((a << community.SHIFT) + s, (b << community.SHIFT) + t) for a, b in pairs for s in range(size[a]) for t in range(s + 1 if a == b else 0, size[b])]
    m = len(ends) * rng.choice([1, 1, 30])
    columns = np.array([(a, b, size[a], size[b]) for a, b in pairs], np.int64).reshape(-1, 4).T
    want = sorted(sorted(g) for g in community.greedy_modularity(*zip(*ends, strict=True), m) if len(g) > 1) if ends else []
    groups = {}
    for node, side in zip(*community.AlikeSentences(*columns, m).run(), strict=True):
        groups.setdefault(int(side), []).append(int(node))
    assert sorted(groups.values()) == want and all(min(g) == side for side, g in groups.items())


def test_modularity_never_makes_edges(comments, monkeypatch):
    plain, graph = (pipeline.written(g) for g in both(comments))
    want = rows(community.cluster(plain, "TEMPORAL", "GreedyModularity").nodes, *NODE, "CLUSTER_ID")
    monkeypatch.setattr(community, "cluster_edges", None)
    assert rows(community.cluster(graph, "TEMPORAL", "GreedyModularity").nodes, *NODE, "CLUSTER_ID") == want


@pytest.mark.parametrize("root", [True, False])
def test_counts_and_node_filters_by_comments(comments, root, monkeypatch):
    """A sweep's numbers of edges come from bundles, and filters by nodes spread only bundles of comments that they take."""
    plain, graph = (rank.size(pipeline.written(g)) for g in both(comments, root))
    want = pipeline.Sweep.size(plain, 0).first()
    made = []
    monkeypatch.setattr(filters, "spread", lambda b, own=filters.spread: made.append(b.table.count()) or own(b))
    for low, top in ((20.0, 3), (27.0, 1), (1000.0, 40)):
        pairs = [(filters.node_threshold, (low, "SIZE"))] + [(filters.node_top, (top, "SIZE", strict)) for strict in (True, False)]
        for step, own in pairs:
            assert rows(step(graph, *own).edges, *ENDS, *EDGE_WEIGHTS, "ord") == rows(step(plain, *own).edges, *ENDS, *EDGE_WEIGHTS, "ord")
    assert len(made) == 9 and min(made) == 0 and max(made[4], made[5]) < graph.bundles.table.count()
    assert pipeline.Sweep.size(Graph(comments, graph.nodes, None, graph.bundles), 0).first() == want


@pytest.mark.parametrize("block_rows", [3, 8, None])
def test_similar_pairs_bring_their_sizes(spark, comments, block_rows, monkeypatch):
    """Pairs of comments, which are quadratic, are neither joined nor shuffled behind the blocks, and low blocks' ids come first."""
    vectors = spark.createDataFrame([(k, [float(k % 3), float(k % 4 - 2), 1.0]) for k in range(20)], "vec_id long, embedding array<float>")
    n = edges.nodes_of(comments)
    monkeypatch.setattr(edges, "similar_comments", lambda *a, own=edges.similar_comments, **more: own(*a, **{"block_rows": block_rows} | more))
    sizes = {r.c_idx: r.n for r in n.groupBy("c_idx").agg(F.count(F.lit(1)).alias("n")).collect()}
    plain = {(r.c_a, r.c_b): r.SIMILARITY for r in edges.similar_comments(comments, vectors).collect()}
    graph = edges.bundled(comments, n, [edges.pairs_similarity(comments, n, vectors)])
    got = {(r.c_a, r.c_b): (r.n_a, r.n_b, r.SIMILARITY) for r in graph.bundles.table.collect()}
    assert got == {(a, b): (sizes[a], sizes[b], w) for (a, b), w in plain.items() if a in sizes and b in sizes} and len(got) > 50
    plan = graph.bundles.table._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("MapInArrow")]
    gaps = comments.withColumn("c_idx", F.col("c_idx") * 1000)  # dealt by hash
    far = edges.similar_comments(gaps, vectors.withColumn("vec_id", F.col("vec_id") * 1000), sizes=n.withColumn("c_idx", F.col("c_idx") * 1000).groupBy("c_idx").agg(F.count(F.lit(1)).alias("n")))
    assert {(r.c_a // 1000, r.c_b // 1000): (r.n_a, r.n_b, r.SIMILARITY) for r in far.collect()} == got


@pytest.mark.parametrize("least, lone", [(0.3, 0), (0.3, 2), (0.3, 30), (0.62, 2), (0.79, 0)])
def test_first_comments_tie_most(spark, comments, least, lone, monkeypatch):
    """Where most pairs pass, the first comments tie them; those that they leave apart are met with all others, and no block with a block."""
    ids = [3 * k + 1 for k in range(60)]
    own = spark.createDataFrame([(k,) for k in ids], "c_idx long")
    rng = np.random.default_rng(5)
    at = {k: [1.0, 0.0, 0.0] if k < 30 or n >= 60 - lone else rng.normal(size=3).tolist() for n, k in enumerate(ids)}
    vectors = spark.createDataFrame(list(at.items()), "vec_id long, embedding array<float>")
    near = sorted((r.c_a, r.c_b) for r in edges.similar_comments(own, vectors).collect() if r.SIMILARITY >= least)
    made = []
    monkeypatch.setattr(edges, "_tiles", lambda *a, tiles=edges._tiles: made.append(1) or tiles(*a))
    kept = sorted((r.c_a, r.c_b) for r in edges.tied_similar(own, vectors, lambda w: w >= least, block_rows=20).collect())
    assert len(set(kept)) == len(kept) <= len(near) and set(kept) <= set(near)
    assert made == ([1] if least > 0.7 else [])

    def forest(pairs):
        root, out = {k: k for k in ids}, []
        for a, b in pairs:
            if root[a] != root[b]:
                out.append((a, b))
                root = {k: root[a] if v == root[b] else v for k, v in root.items()}
        return out

    assert forest(near) == forest(kept)


@pytest.mark.parametrize("k, descending, odd", [(1, True, False), (2, True, True), (2, False, False), (3, False, True), (2, True, False)])
def test_first_neighbours_by_products(spark, k, descending, odd, monkeypatch):
    """Products of matrices leave few pairs for the expression; copies, zero, missing and odd vectors and ties get the same neighbours."""
    rng = np.random.default_rng(k)
    at = {n: rng.normal(size=4).round(1).tolist() for n in range(90) if n % 4}
    at |= {n: [1.0, -2.0, 0.5, 0.0] for n in range(20, 60, 3)} | {30: [0.0] * 4, 31: [0.0] * 4, 90: [0.0] * 4}
    at |= {17: [float("nan")] * 4, 52: [1.0, 2.0], 80: [1e-200, 0.0, 0.0, 0.0], 81: []} if odd else {}
    own = spark.createDataFrame([(n,) for n in range(91)], "c_idx long")
    vectors = spark.createDataFrame(list(at.items()), "vec_id long, embedding array<double>")
    near = {(r.c_a, r.c_b): r.SIMILARITY for r in edges.similar_comments(own, vectors).collect()}
    want = set()
    for c in range(91):
        mine = sorted((-w if descending else w, a + b - c, (a, b)) for (a, b), w in near.items() if c in (a, b))
        want |= {pair for _, _, pair in mine[:k]}
    monkeypatch.setattr(edges, "BOUND_ROWS", 8)
    for block_rows in (13, None):
        got = {(r.c_a, r.c_b): r.SIMILARITY for r in edges.first_similar(own, vectors, k, descending, block_rows=block_rows).collect()}
        assert want <= set(got) and all(near[p] == w for p, w in got.items())
        assert odd or block_rows or len(got) <= 2 * k * 91


def test_few_pairs_get_the_expressions_value(monkeypatch):
    """Of a pair of blocks only pairs within a bound are worked out one by one."""
    from threadgraph.functions import vectors as vx

    rng = np.random.default_rng(1)
    matrix = rng.normal(size=(300, 16))
    side = (np.full(300, 16), np.arange(300), {16: matrix})
    whole = np.concatenate([cos for _, cos in vx.cosine_blocks(side, side)])
    r, c = np.divmod(np.arange(90_000), 300)
    assert (vx.cosines_of(side, side, r, c) == whole.ravel()).all()
    assert np.abs(vx.units(side) @ vx.units(side).T - whole).max() < edges.NEAR / 1000


def test_sweep_never_makes_similar_pairs(spark, comments, monkeypatch):
    """Configurations of SIMILARITY get their numbers from sums over pairs of vectors; no pair of comments is written down."""
    import copy

    from threadgraph.plans import sweeps

    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(k, rng.normal(size=3).tolist()) for k in range(20)], "vec_id long, embedding array<float>")
    picked = [(label, copy.deepcopy(own)) for label, own in sweeps.sweeps() if own["SimilarityComparator"]["active"]]
    for label, own in picked:
        for settings in own.values():
            settings |= {k: v for k, v in (("top_k", 5), ("threshold", {"S_V": 2, "S_merge_01": 0.5, "S_merge_001": 0.78}.get(label, 0.1))) if k in settings}
    both = copy.deepcopy(picked[0])
    picked.append(("asc", both[1] | {"PageRankBottomFilter": both[1]["PageRankBottomFilter"] | {"descending_order": False, "strict": True}}))
    assert len(picked) == 8
    names = ["config_id", "description", "remaining_edges", "removed_edges", "groups"]
    with monkeypatch.context() as m:
        m.setattr(pipeline.Sweep, "implied", staticmethod(lambda branch: False))
        want = rows(pipeline.sweep(comments, picked, vectors), *names)
    monkeypatch.setattr(edges, "LEAST_ROWS", 5)
    monkeypatch.setattr(edges, "similar_comments", None)
    assert rows(pipeline.sweep(comments, picked, vectors), *names) == want

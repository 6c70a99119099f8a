import random

import pytest
from pyspark.sql import functions as F

from threadgraph.functions import text as tx
from threadgraph.operators import betweenness, community, components, edges, filters, merge, nearest, rank
from threadgraph.plans import config, pipeline
from threadgraph.schema import EDGE_WEIGHTS, ENDS, Graph, GraphError
from threadgraph.sources import comments as src

from . import plain

TEXTS = [
    "First sentence here. Is it? Second one follows here. No.", "Das ist z.B. ein Satz. Dr. Who said so? Yes he did!", "", "Too short.", "A long enough sentence without an end",
    "Trailing space here. ", "One more sentence. And another one? Yet another sentence.", "Zehn Zeichen.\nNeue Zeile hier. Ende gut alles gut.", "x" * 30, "Again some text here. And some more text.",
]


@pytest.fixture(scope="module")
def rows():
    out = []
    for k, text in enumerate(TEXTS):
        reply = {1: "c0", 2: "c1", 6: "c5", 7: "c6", 9: "c6"}.get(k)
        out.append((10 + 3 * k, 1 if k < 5 else 2, f"c{k}", "u", float(1_700_000_000 + [0, 900, 300.25, 100.5, 2500, 2600, 2600, 3700.75, 3000, 9000][k]), text, reply, k % 4, k % 3))
    return out


@pytest.fixture(scope="module")
def comments(spark, rows):
    df = spark.createDataFrame(rows, "id long, article_id long, comment_id string, username string, at double, text string, reply_to string, upvotes long, downvotes long")
    df = df.withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))
    return src.positions(src.resolve_replies(src.conform(df))).persist()


@pytest.fixture(scope="module")
def graph(comments):
    n = edges.nodes_of(comments)
    parts = [edges.edges_same_article(n), edges.edges_same_comment(n), edges.edges_reply_to(comments, n), edges.edges_temporal(comments, n)]
    return pipeline.written(Graph(comments, n, edges.assemble(parts)))


@pytest.fixture(scope="module")
def expected(rows):
    ids = {r[2]: r[0] for r in rows}
    return plain.generated([{"id": r[0], "article": r[1], "ts": r[4], "reply": ids.get(r[6]), "n": len(plain.spans(r[5]))} for r in rows])


def pairs(df):
    return {((r.src_c, r.src_s), (r.tgt_c, r.tgt_s)) for r in df.select(*ENDS).collect()}


def in_order(df):
    return [((r.src_c, r.src_s), (r.tgt_c, r.tgt_s)) for r in sorted(df.collect(), key=lambda r: list(r.ord))]


def weights(nodes, name):
    return {(r.c_idx, r.s_idx): r[name] for r in nodes.collect()}


def test_sentences_and_spans(spark):
    texts = [*TEXTS, "a.b. cd? e.f.g h. Mr. X. Ok? ", "É. Über uns. Ja."]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for r in df.select("k", tx.split_sentences(F.col("t")).alias("x"), tx.spans(F.col("t")).alias("y")).collect():
        assert r.x == plain.sentences(texts[r.k])
        assert [(s.s, s.e) for s in r.y] == plain.spans(texts[r.k])
    fixed = df.select("t", F.explode(tx.spans(F.col("t"), fix_offsets=True)).alias("y")).select(tx.split_text(F.col("t"), F.col("y.s"), F.col("y.e")).alias("cut"), "y.text").collect()
    assert fixed and all(r.cut == r.text for r in fixed)


def test_generators(graph, expected):
    got = {((r.src_c, r.src_s), (r.tgt_c, r.tgt_s)): {w: r[w] for w in EDGE_WEIGHTS if r[w] is not None} for r in graph.edges.collect()}
    assert got.keys() == expected.keys()
    for e, own in expected.items():
        assert got[e] == pytest.approx(own)
    assert in_order(graph.edges) == sorted(expected)


def test_similarity_generator(spark, comments):
    vectors = spark.createDataFrame([(k, [float(k % 3), float(k % 2), 0.0]) for k in range(8)], "vec_id long, embedding array<double>")
    got = {(r.c_a, r.c_b): r.SIMILARITY for r in edges.similar_comments(comments, vectors, 0.75, 0.1, block_rows=4).collect()}
    own = {k: (k % 3, k % 2) for k in range(8)}
    want = {}
    for a in range(10):
        for b in range(a + 1, 10):
            x, y = own.get(a), own.get(b)
            nx, ny = (sum(v * v for v in z) ** 0.5 if z else 0 for z in (x, y))
            cos = 0 if x is None or y is None else 1 if nx == ny == 0 else 0 if not nx * ny else sum(p * q for p, q in zip(x, y, strict=True)) / (nx * ny)
            if cos < 0.75:
                want[a, b] = (1 - cos) / 0.25 * 0.1
    assert got == pytest.approx(want)


@pytest.mark.parametrize("block_rows", [1, 7, 1000])
def test_similarity_blocks_equal_the_expression(spark, block_rows):
    from threadgraph.functions.vectors import cosine

    rng = random.Random(block_rows)
    some = [None, [], [0.0, 0.0], [0.0, 0.0, 0.0], [1.0, None, 2.0], [float("nan"), 1.0, 0.0], [float("inf"), 0.0, 1.0], [1.0, 2.0], [1.0, 2.0, 2.0], [1.0, 2.0, 2.0]]
    rows = [(1000 * k + 7, some[k] if k < len(some) else [rng.gauss(0, 1) for _ in range(3)]) for k in range(150)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    comments = spark.createDataFrame([(k, "x") for k, _ in rows] + [(5, "no vector")], "c_idx long, text string")
    got = sorted(tuple(r) for r in edges.similar_comments(comments, vectors, 0.75, 0.1, block_rows=block_rows).collect())
    known = comments.join(vectors.withColumnRenamed("vec_id", "c_idx"), "c_idx", "left")
    pairs = known.select(F.col("c_idx").alias("c_a"), F.col("embedding").alias("a")).join(known.select(F.col("c_idx").alias("c_b"), F.col("embedding").alias("b")), F.expr("c_a < c_b"))
    cos = cosine(F.col("a"), F.col("b"))
    want = pairs.withColumn("cos", cos).where("cos < 0.75").select("c_a", "c_b", ((1 - F.col("cos")) / (1 - 0.75) * 0.1).alias("w"))
    assert got == sorted(tuple(r) for r in want.collect())  # to the last bit
    assert edges.similar_comments(comments.limit(0), vectors).count() == 0 and edges.similar_comments(comments, vectors.limit(0)).count() == 151 * 150 // 2


def test_rankers(graph, expected, rows):
    g = rank.recency(rank.votes(rank.size(rank.degree(graph))))
    nodes = {(r.c_idx, r.s_idx): r for r in g.nodes.collect()}
    assert {v: r.SIZE for v, r in nodes.items()} == {(k, j): e - s for k, row in enumerate(rows) for j, (s, e) in enumerate(plain.spans(row[5]))}
    for v, r in nodes.items():
        assert r.DEGREE_CENTRALITY == sum(v in e for e in expected)
        assert r.VOTES == v[0] % 4 + v[0] % 3
        assert r.RECENCY == pytest.approx(rows[v[0]][4] - 1_700_000_000)
    ranks = weights(rank.pagerank(graph).nodes, "PAGERANK")
    want = plain.pagerank(list(nodes), [(a, b, w["TEMPORAL"]) for (a, b), w in expected.items() if w.get("TEMPORAL")])
    assert ranks == pytest.approx(want, abs=1e-9) and sum(ranks.values()) == pytest.approx(1)
    with pytest.raises(GraphError):
        rank.pagerank(graph, edge_type="SAME_GROUP")


def test_edge_filters(graph, expected):
    got = pairs(filters.edge_threshold(graph, 0.5, "TEMPORAL").edges)
    assert got == {e for e, w in expected.items() if w.get("TEMPORAL", 0) >= 0.5}
    got = pairs(filters.edge_any(graph, {"REPLY_TO": 0.5, "TEMPORAL": 0.3, "SAME_ARTICLE": -1.0}).edges)
    assert got == {e for e, w in expected.items() if w.get("REPLY_TO", 0) > 0.5 or 0 < w.get("TEMPORAL", 0) < 0.3}
    nodes = sorted({v for e in expected for v in e})
    for kind, k, down in (("TEMPORAL", 2, True), ("TEMPORAL", 1, False), ("SAME_GROUP", 1, True)):
        want = plain.edge_top(nodes, sorted(expected), lambda e, kind=kind: expected[e].get(kind), k, down)
        assert in_order(filters.edge_top(graph, k, kind, down).edges) == want
    again = filters.edge_top(filters.edge_top(graph, 2, "TEMPORAL"), 1, "REPLY_TO")
    first = plain.edge_top(nodes, sorted(expected), lambda e: expected[e].get("TEMPORAL"), 2)
    assert in_order(again.edges) == plain.edge_top(nodes, first, lambda e: expected[e].get("REPLY_TO"), 1)


def test_node_filters_and_ties(graph, expected):
    g = rank.votes(graph)
    vote = weights(g.nodes, "VOTES")
    assert pairs(filters.node_threshold(g, 2.0, "VOTES").edges) == {e for e in expected if vote[e[0]] >= 2 and vote[e[1]] >= 2}
    for down in (True, False):
        top = set(sorted(vote, key=lambda v: ((-vote[v] if down else vote[v]), v))[:5])
        assert pairs(filters.node_top(g, 5, "VOTES", True, down).edges) == {e for e in expected if e[0] in top and e[1] in top}
        assert pairs(filters.node_top(g, 5, "VOTES", False, down).edges) == {e for e in expected if e[0] in top or e[1] in top}
    with pytest.raises(Exception, match="SIZE"):
        filters.node_threshold(graph, 1.0, "SIZE").edges.collect()
    with pytest.raises(GraphError):
        filters.node_threshold(graph, 1.0, "NAME")


def random_graph(spark, rng, n=14, m=12):
    nodes = [(v // 3, v % 3) for v in range(n)]
    chosen = sorted({tuple(sorted(rng.sample(nodes, 2))) for _ in range(m)})
    node_df = spark.createDataFrame([(c, s, 100 + c, 1, 0, 20) for c, s in nodes], "c_idx long, s_idx long, id long, article_id long, s long, e long")
    node_df = node_df.select("*", *[F.lit(None).cast("double").alias(w) for w in ("SIZE", "PAGERANK", "DEGREE_CENTRALITY", "RECENCY", "VOTES", "TOXICITY", "MERGE_ID", "CLUSTER_ID")])
    order = chosen[:]
    rng.shuffle(order)
    place = {e: k for k, e in enumerate(order)}
    edge_df = spark.createDataFrame([(*a, *b, 1.0, [place[a, b]]) for a, b in chosen], "src_c long, src_s long, tgt_c long, tgt_s long, REPLY_TO double, ord array<long>")
    edge_df = edge_df.select(*ENDS, "REPLY_TO", *[F.lit(None).cast("double").alias(w) for w in EDGE_WEIGHTS if w != "REPLY_TO"], "ord")
    return Graph(None, node_df, edge_df), nodes, order


@pytest.mark.parametrize("seed", range(3))
def test_merge_ids(spark, seed):
    g, nodes, order = random_graph(spark, random.Random(seed))
    got = weights(merge.merge(g, 0.5, "REPLY_TO").nodes, "MERGE_ID")
    assert got == plain.merge_ids(nodes, order)


def replayed(order, places=None):
    """node -> id by the edges at the given places of the order."""
    import pyarrow as pa

    own = [order[k] for k in (places if places is not None else range(len(order)))]
    rows = pa.table({"a": [a for a, _ in own], "b": [b for _, b in own]}, pa.schema({"a": pa.int64(), "b": pa.int64()}))
    (out,) = merge.replay(rows.to_batches(4))
    return dict(zip(out.column("node").to_pylist(), out.column("id").to_pylist(), strict=True))


def test_merge_replay_of_many_orders():
    rng = random.Random(1)
    for _ in range(300):
        order = [tuple(rng.sample(range(6), 2)) for _ in range(rng.randint(1, 9))]
        assert replayed(order) == plain.merge_ids([], order)


def test_merge_forests_leave_ids_alone():
    """Edges in any partitions: each keeps a forest of its own, and the replay of what is left gives the same ids."""
    import pyarrow as pa

    rng = random.Random(2)
    for _ in range(300):
        order = [tuple(rng.choices(range(9), k=2)) for _ in range(rng.randint(1, 40))]
        parts: list[list[int]] = [[] for _ in range(3)]
        for k in range(len(order)):
            rng.choice(parts).append(k)
        left = []
        for own in parts:
            rows = pa.table({"a": [order[k][0] for k in own], "b": [order[k][1] for k in own], "ord": own}, pa.schema({"a": pa.int64(), "b": pa.int64(), "ord": pa.int64()}))
            kept = [k for batch in components.forest(rows.to_batches(4)) for k in batch.column("ord").to_pylist()]
            assert sum(order[k][0] != order[k][1] for k in kept) < 9
            left += kept
        assert replayed(order, sorted(left)) == replayed(order)


def test_merge_multi_and_empty(graph, expected):
    nodes = sorted(weights(graph.nodes, "SIZE"))
    got = weights(merge.merge_multi(graph, {"SAME_GROUP": -1.0}, conj_or=True).nodes, "MERGE_ID")
    assert got == {v: -(k + 1) for k, v in enumerate(nodes)}
    every = weights(merge.merge_multi(graph, {"SAME_GROUP": -1.0}, conj_or=False).nodes, "MERGE_ID")
    assert every == plain.merge_ids(nodes, sorted(expected))


@pytest.mark.parametrize("seed", range(3))
def test_girvan_newman(spark, seed):
    g, nodes, order = random_graph(spark, random.Random(seed + 20), 12, 11)
    got = weights(community.cluster(g, "REPLY_TO").nodes, "CLUSTER_ID")
    want = plain.girvan_newman(nodes, order)
    assert got == {v: k for k, part in enumerate(want) for v in part}


def test_betweenness_on_tables(spark):
    rng = random.Random(3)
    pairs = {(i, i + 1) for i in range(7)} | {(0, k) for k in range(20, 30)} | {tuple(sorted(rng.sample(range(9), 2))) for _ in range(6)}
    pairs |= {(a + 100, b + 100) for a, b in pairs if b < 9} | {(300, 301)}  # a hub, a second component, a lone edge
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    want = community.betweenness(near)
    table = spark.createDataFrame([(a // 100, a, b) for a, b in pairs], "component long, a long, b long")
    for block_rows, broadcast_arcs in ((10**9, 10**6), (500, 0)):
        got = {(r["a"], r["b"]): r["v"] for r in betweenness.betweenness_table(table, block_rows, broadcast_arcs).collect()}
        assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in want)
    assert betweenness.betweenness_table(table.limit(0)).count() == 0


@pytest.mark.parametrize("large", [0, 4])
def test_girvan_newman_on_tables(spark, large):
    for seed in (20, 31):
        g, nodes, order = random_graph(spark, random.Random(seed), 12, 11)
        got = weights(community.cluster(g, "REPLY_TO", split_edges=large).nodes, "CLUSTER_ID")
        assert got == {v: k for k, part in enumerate(plain.girvan_newman(nodes, order)) for v in part}


def test_greedy_modularity(spark):
    g, nodes, order = random_graph(spark, random.Random(5), 12, 14)
    got = weights(community.cluster(g, "REPLY_TO", "GreedyModularity").nodes, "CLUSTER_ID")
    parts = [sorted(v for v in nodes if got[v] == k) for k in range(int(max(got.values())) + 1)]
    assert [len(p) for p in parts] == sorted((len(p) for p in parts), reverse=True)
    best = plain.modularity(nodes, order, parts)
    assert best > plain.modularity(nodes, order, plain.components(nodes, order)) - 1e-12
    for i in range(len(parts)):
        for j in range(i):
            joined = [p for k, p in enumerate(parts) if k not in (i, j)] + [parts[i] + parts[j]]
            assert plain.modularity(nodes, order, joined) <= best + 1e-12


def test_two_triangles(spark):
    g, _, _ = random_graph(spark, random.Random(0), 6, 1)
    v = [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]
    links = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)]
    e = spark.createDataFrame([(*v[a], *v[b], 1.0, [k]) for k, (a, b) in enumerate(links)], "src_c long, src_s long, tgt_c long, tgt_s long, REPLY_TO double, ord array<long>")
    g = g.with_(edges=e.select(*ENDS, "REPLY_TO", *[F.lit(None).cast("double").alias(w) for w in EDGE_WEIGHTS if w != "REPLY_TO"], "ord"))
    for algorithm in ("GirvanNewman", "enum.girvannewman", "GreedyModularity"):
        got = weights(community.cluster(g, "REPLY_TO", algorithm).nodes, "CLUSTER_ID")
        assert [got[x] for x in v] == [0, 0, 0, 1, 1, 1]
    assert weights(community.cluster(g, "SAME_GROUP").nodes, "CLUSTER_ID") == {x: k for k, x in enumerate(v)}


def test_busy_seconds(spark):
    rng = random.Random(8)
    at = [1_700_000_000.0 + rng.choice((0, 0, 0, 0.25, 999.5, 1000, 5000, -1200)) for _ in range(400)]
    own = spark.createDataFrame(list(enumerate(at)), "c_idx long, at double").select("c_idx", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("ts"))

    def rows(bucket_rows):
        return {(r["c_a"], r["c_b"]): r["TEMPORAL"] for r in edges.close_comments(own, bucket_rows=bucket_rows).collect()}

    want = {}
    for b in range(400):
        for a in range(b):
            gap = at[a] - at[b] if at[a] > at[b] else (at[b] - at[a]) // 1
            if gap < 1000:
                want[a, b] = 1 - gap / 1000
    for bucket_rows in (20, 4096):
        got = rows(bucket_rows)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_busy_keys_are_bounded(spark):
    n, part = 100_000, 1000
    own = spark.range(n).select(F.col("id").alias("c_idx"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("bucket"))
    busy = spark.createDataFrame([(0, n // part)], "bucket long, parts long")
    side = edges._busy_keys(own, "a", "b", busy)
    most = side.groupBy(*edges.PAIR_KEY).count().agg(F.max("count").alias("m"), F.count(F.lit(1)).alias("keys")).first()
    assert most["m"] < 1.25 * part and most["keys"] == (n // part) * (n // part + 2)


def test_positions_of_sparse_ids(spark):
    rng = random.Random(4)
    ids = list({rng.getrandbits(63) - (1 << 62) for _ in range(3000)})
    got = {r["id"]: r["c_idx"] for r in src.positions(spark.createDataFrame([(i,) for i in ids], "id long").repartition(7)).collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids))}
    assert src.positions(spark.createDataFrame([], "id long")).count() == 0


def test_nearest_by_small_weights(spark):
    rng = random.Random(6)
    rows = [(c, s, rng.choice((0.0, 0.25, 1e-9 * c, rng.random()))) for c in range(60) for s in range(rng.randint(1, 3))]
    nodes = spark.createDataFrame(rows, "c_idx long, s_idx long, PAGERANK double").repartition(5)
    got = {(r["src_c"], r["src_s"]): (r["tgt_c"], r["tgt_s"]) for r in nearest.nearest_of_others(nodes, nodes.where("s_idx = 0"), "PAGERANK").collect()}
    assert got == {(c, s): min((abs(w - v), (d, t)) for d, t, v in rows if d != c)[1] for c, s, w in rows if s == 0}


def test_single_edges(graph, expected):
    g = rank.recency(graph)
    when = weights(g.nodes, "RECENCY")
    kept = g.with_(edges=g.edges.where("src_c = 0 and tgt_c = 1"))
    tied = {v for e in pairs(kept.edges) for v in e}
    want = set()
    for v in sorted(when):
        if v not in tied:
            want.add((v, (v[0], 0) if v[1] else min((u for u in when if u[0] != v[0]), key=lambda u: (abs(when[u] - when[v]), u))))
    added = nearest.add_single_edges(kept).edges.where("ord[0] > 1000000")
    assert pairs(added) == want and {r.TEMPORAL for r in added.collect()} == {0.1}
    sized = rank.size(graph)
    size = weights(sized.nodes, "SIZE")
    none = sized.with_(edges=sized.edges.where("false"))
    got = pairs(nearest.add_single_edges(none, node_weight="SIZE").edges)
    assert got == {(v, (v[0], 0) if v[1] else min((u for u in size if u[0] != v[0]), key=lambda u: (abs(size[u] - size[v]), u))) for v in size}
    with pytest.raises(GraphError):
        nearest.add_single_edges(none, node_weight="VOTES")
    with pytest.raises(GraphError):
        nearest.add_single_edges(none.with_(nodes=none.nodes.where("c_idx = 0")), node_weight="SIZE")


def test_configuration():
    settings = config.resolve()
    on = [name for name, s in settings.items() if s is not None]
    assert on == [
        "SameArticleComparator", "SameCommentComparator", "ReplyToComparator", "TemporalComparator", "PageRanker", "CentralityDegreeCalculator", "SizeRanker", "VotesRanker",
        "RecencyRanker", "VotesFilter", "PageRankBottomFilter", "ReplyToNodeMerger", "GenericSingleEdgeAdder",
    ]
    assert len(config.COMPARATORS) == 5 and len(config.MODIFIERS) == 52
    text = "[SizeFilter]\nactive = yes\nthreshold = 3\n[PageRanker]\nactive = no\n[GenericEdgeFilter]\nedge_type = EdgeWeightType.TEMPORAL\n"
    own = config.resolve({"SizeFilter": {"threshold": 4, "strict": None}}, config.read_ini(text))
    assert own["SizeFilter"]["threshold"] == 4.0 and own["PageRanker"] is None and own["GenericEdgeFilter"]["edge_type"] == "TEMPORAL"
    with pytest.raises(GraphError):
        config.resolve({"SizeFilter": {"size": 1}})


def test_build_cache_and_document(spark, comments, tmp_path):
    light = {"PageRanker": {"active": False}, "PageRankBottomFilter": {"active": False}, "TemporalComparator": {"active": False}}
    plain_comments = comments.drop("c_idx")
    cache = pipeline.GraphCache(spark, str(tmp_path / "graphs"))
    one = cache.get(plain_comments, [2, 1], light)
    n = one.edges.count()
    assert cache.has(pipeline.cache_key([1, 2])) and n > 0
    doc = pipeline.to_document(one).first()
    assert '"splits"' in doc.comments and doc.edges.startswith("[")
    none = {**light, "SizeBottomFilter": {"top_k": 0, "strict": True}, "GenericSingleEdgeAdder": {"active": False}}
    assert cache.get(plain_comments, [1, 2], none).edges.count() == n  # the settings aren't part of the key
    assert cache.get(plain_comments, [1, 2], none, ignore_cache=True).edges.count() == 0
    assert cache.get(plain_comments, [1, 2], none, override_cache=True).edges.count() == 0
    assert pipeline.cache_key([3, 1]) == "[1, 3]"


def test_sweep(spark, comments, tmp_path):
    from threadgraph.plans import sweeps

    every = sweeps.sweeps()
    assert len(every) == 52 and len({label for label, _ in every}) == 49
    for _, own in every:
        on = [name for name, s in config.resolve(own).items() if s is not None]
        assert len(on) in (2, 3)
    tree = pipeline.plan_tree([config.resolve(own) for _, own in every])
    assert len(tree) == 6 and sum(len(branch.follow) for branch in tree.values()) == 36  # 6 sets of edges; what is done to each of them
    picked = [every[k] for k in (0, 1, 19, 25, 31, 32, 46)]
    out = pipeline.sweep(comments, picked)
    pipeline.write_sweep(out, str(tmp_path / "sweep"))
    back = spark.read.csv(str(tmp_path / "sweep"), header=True).collect()
    assert len(back) == 7 and all(int(r["remaining edges"]) + int(r["removed edges"]) > 0 for r in back)
    # The whole chain of each configuration by itself.
    for (_, own), row in zip(picked, sorted(out.collect(), key=lambda r: r.config_id), strict=True):
        alone = pipeline.build(comments, own)
        assert row.remaining_edges == alone.edges.count()
        grouped = next((c for c in ("MERGE_ID", "CLUSTER_ID") if row.groups is not None and alone.nodes.where(f"{c} is not null").count()), None)
        assert row.groups == (alone.nodes.select(grouped).distinct().count() if grouped else None)


@pytest.mark.parametrize("seed", range(2))
def test_exact_pagerank_solves_its_equations(spark, seed):
    """Against a dense solve, with nodes that have no outgoing weight, and cycles."""
    import numpy as np

    rng = random.Random(seed)
    g, nodes, order = random_graph(spark, rng)
    turned = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in order]
    edges_ = spark.createDataFrame([(*a, *b, 1.0 + k % 3) for k, (a, b) in enumerate(turned)], "src_c long, src_s long, tgt_c long, tgt_s long, REPLY_TO double")
    place = {v: k for k, v in enumerate(nodes)}
    walk = np.zeros((len(nodes), len(nodes)))
    for k, (a, b) in enumerate(turned):
        walk[place[b], place[a]] += 1.0 + k % 3
    out = walk.sum(axis=0)
    walk = np.where(out > 0, walk / np.where(out > 0, out, 1), 1 / len(nodes))
    want = np.linalg.solve(np.eye(len(nodes)) - 0.85 * walk, np.full(len(nodes), 0.15 / len(nodes)))
    got = {(r.c_idx, r.s_idx): r.PAGERANK for r in rank.pagerank_exact(g.nodes, edges_, "REPLY_TO").collect()}
    assert max(abs(got[v] - want[k]) for v, k in place.items()) < 1e-9
    with pytest.raises(GraphError):
        rank.pagerank_exact(g.nodes, edges_.where("false"), "REPLY_TO")
    with pytest.raises(GraphError):
        rank.pagerank_exact(g.nodes, edges_, "REPLY_TO", tolerance=0.0, iterations=1)


@pytest.mark.parametrize("algorithm", ["GirvanNewman", "GreedyModularity"])
def test_components_are_no_groups_of_their_own(spark, algorithm, monkeypatch):
    """Thousands of small components are a stream of each task; as a group each they took most of the time. Batches of a few rows cut
    components anywhere."""
    chains = spark.range(400).select(F.col("id").alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") % 9)).alias("s"))
    ends = chains.where("s > 0").select(F.col("c").alias("src_c"), (F.col("s") - 1).alias("src_s"), F.col("c").alias("tgt_c"), F.col("s").alias("tgt_s"))
    one = ends.select(*ENDS, *[F.lit(1.0 if w == "SAME_COMMENT" else None).cast("double").alias(w) for w in EDGE_WEIGHTS], F.array(*ENDS).alias("ord"))
    nodes = chains.select(F.col("c").alias("c_idx"), F.col("s").alias("s_idx"), F.lit(None).cast("double").alias("CLUSTER_ID"))
    used = []
    monkeypatch.setattr("pyspark.sql.group.GroupedData.applyInPandas", lambda *a, **k: used.append(a))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = community.cluster(Graph(None, nodes, one), "SAME_COMMENT", algorithm).nodes.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for r in got:
        groups.setdefault(r.CLUSTER_ID, set()).add((r.c_idx, r.s_idx))
    if algorithm == "GirvanNewman":  # the first of the longest chains, and in it the earliest of its two middle edges or the one
        want = {frozenset((c, s) for s in range(c % 9 + 1)) for c in range(400) if c != 8}
        want |= {frozenset((8, s) for s in part) for part in (range(4), range(4, 9))}
        assert set(map(frozenset, groups.values())) == want
    assert not used and len(got) == chains.count()
    assert all(len({c for c, _ in own}) == 1 for own in groups.values())


def test_exact_pagerank_leaves_nodes_without_edges_out(spark, monkeypatch):
    """Its vectors hold nodes with edges, and none of them goes through the driver."""
    nodes = spark.range(50).select(F.col("id").alias("c_idx"), F.lit(0).cast("long").alias("s_idx"))
    one = spark.createDataFrame([(0, 0, 1, 0, 1.0), (1, 0, 2, 0, 1.0), (0, 0, 2, 0, 3.0)], "src_c long, src_s long, tgt_c long, tgt_s long, REPLY_TO double")
    sizes, real = [], rank.materialise
    monkeypatch.setattr(rank, "materialise", lambda df, name: sizes.append((name, real(df, name))) or sizes[-1][1])
    monkeypatch.setattr(rank.F, "broadcast", lambda df: pytest.fail("a broadcast goes through the driver"))
    got = {r.c_idx: r.PAGERANK for r in rank.pagerank_exact(nodes, one, "REPLY_TO").collect()}
    y = {0: 1.0, 1: 1 + 0.85 / 4, 2: 1 + 0.85 * 3 / 4 + 0.85 * (1 + 0.85 / 4)}
    total = sum(y.values()) + 47
    assert got == pytest.approx({k: y.get(k, 1.0) / total for k in range(50)}, abs=2e-12)
    assert {df.count() for name, df in sizes if name == "pagerank-exact"} == {3}

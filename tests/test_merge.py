import random

import pytest

from threadgraph.operators import components, merge


def replayed(edges):
    own, members, seeds = {}, {}, 0
    for a, b, _ in sorted(edges, key=lambda e: e[2]):
        x, y = own.get(a), own.get(b)
        if x is None and y is None:
            own[a] = own[b] = seeds
            members[seeds] = {a, b}
            seeds += 1
        elif x is None or y is None:
            new, there = (a, y) if x is None else (b, x)
            own[new] = there
            members[there].add(new)
        elif x != y:
            for node in members[y]:
                own[node] = x
            members[x] |= members.pop(y)
    return own


def graphs():
    for seed, n, m in ((1, 60, 50), (2, 60, 70), (3, 300, 330), (4, 12, 60)):
        rng = random.Random(seed)
        yield [(rng.randrange(n), rng.randrange(n), [k]) for k in range(m)]
    rng = random.Random(9)
    yield [(k, k + 1, [o]) for k, o in zip(range(80), rng.sample(range(80), 80))]  # a path in random order
    yield [(k + 1, k, [k]) for k in range(80)]  # every new node is a source
    yield [(40 + k, 0, [o]) for k, o in zip(range(40), rng.sample(range(40), 40))] + [(40 + k, 200 + k, [-50 + k]) for k in range(40)]  # a hub taken over again and again
    yield [(3, 3, [5]), (3, 4, [6]), (7, 7, [1]), (7, 7, [2]), (8, 7, [9])]


def distinct(edges):
    """Every pair once, as in a graph."""
    seen, out = set(), []
    for a, b, o in edges:
        if (min(a, b), max(a, b)) not in seen:
            seen.add((min(a, b), max(a, b)))
            out.append((a, b, o))
    return out


@pytest.mark.parametrize("k", range(8))
def test_ids_on_tables_equal_replay(spark, k):
    edges = distinct(list(graphs())[k])
    rows = spark.createDataFrame(edges, "a long, b long, ord array<long>").repartition(3)
    assert {r.node: r.id for r in merge.contracted(rows).collect()} == replayed(edges)


def test_both_ways_of_merging(spark, monkeypatch):
    """One task, and rounds of joins, on a graph with nodes outside all edges; forests that start anew."""
    from threadgraph.operators import edges as e
    from threadgraph.schema import Graph

    rng = random.Random(5)
    comments = spark.createDataFrame([(k, k, 1, "A sentence here. And another one there. A third one.") for k in range(40)], "c_idx long, id long, article_id long, text string")
    nodes = e.nodes_of(comments)
    pairs = sorted({tuple(sorted((rng.randrange(30), rng.randrange(30)))) for _ in range(25)})
    own = spark.createDataFrame([(a, a % 3, b, b % 2, 1.0) for a, b in pairs if a < b], "src_c long, src_s long, tgt_c long, tgt_s long, REPLY_TO double")
    graph = Graph(comments, nodes, e.assemble([own]))
    ids = lambda **how: sorted((r.c_idx, r.s_idx, r.MERGE_ID) for r in merge.merge_edges(graph, graph.edges, **how).nodes.collect())
    one = ids()
    assert one == ids(local_edges=0) and min(x[2] for x in one) < 0 <= max(x[2] for x in one)
    monkeypatch.setattr(components, "FOREST_NODES", 1)
    assert ids() == one


def test_components_of_both_ways(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(70)]
    rows = spark.createDataFrame(edges, "a long, b long").repartition(3)
    one = sorted(tuple(r) for r in components.components_of(rows).collect())
    assert one == sorted(tuple(r) for r in components.components_of(rows, local_edges=0).collect())
    assert all(c <= v for v, c in one) and dict(one).keys() == {v for e in edges if e[0] != e[1] for v in e}
    assert all(dict(one)[a] == dict(one)[b] for a, b in edges if a != b)

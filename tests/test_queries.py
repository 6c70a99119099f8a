"""Registered queries against their SQL on the smallest test tables, and the entry points' contract."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from threadgraph import oracle, queries

from . import plain

WHERE = "/root/testdata/sf0.001"
SOME = (
    "sc_sb_top50", "sentence_split", "split_spans", "normalize_text", "token_window", "article_nest", "url_normalize", "ingest_welt", "delete_article", "embedding_cosine",
    "edges_reply_to_all", "rank_votes_up_only", "rank_toxicity_split", "filter_edge_or", "bottom_edge_reply_to", "bottom_node_votes_any", "search_tfidf", "time_histogram",
    "ingest_taz", "ingest_zeit", "ingest_spiegel", "ingest_spiegel_paged", "ingest_articles", "text_vectors", "visible_comments", "vote_colour", "cluster_centroid", "source_counts", "add_single_edges", "cluster_reply_to_gmc", "cluster_same_article_gmc", "merge_ids_reply_to", "cluster_reply_to_gn", "cluster_same_comment_gn",
    "merge_temporal", "merge_similarity", "filter_edge_similarity", "bottom_edge_similarity", "config_sweep", "edges_temporal",
    "store_versions", "graph_lookup", "graph_cache", "article_cache", "graph_document",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(WHERE), reason="test tables are not here")


def value(v):
    return v + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", [*SOME, "cluster_temporal_gmc"])
def test_query_equals_sql(spark, name):
    df = queries.queries()[name](spark, WHERE)
    # The last one's SQL takes minutes on larger tables, so it isn't registered.
    sql = oracle.oracle_sql().get(name) or oracle.modularity("TEMPORAL", "TEMPORAL")
    con = duckdb.connect()
    for file in os.listdir(WHERE):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{WHERE}/{file}'")
    found = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(found.columns)
    mine = sorted(repr([value(r[n]) for n in names]) for r in df.collect())
    theirs = sorted(repr([value(r[found.columns.index(n)]) for n in names]) for r in found.fetchall())
    assert mine == theirs


def test_every_sql_has_its_query():
    assert set(oracle.oracle_sql()) <= set(queries.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_llm_subpackage():
    code = "import sys; sys.modules['threadgraph.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(entry.__file__), check=True).stdout.split()
    assert int(out[0]) > 100 and out[1] == "False"


def test_similarity_of_all_sentences(spark):
    own = queries.queries()
    nodes = sorted((r.c_idx, r.s_idx) for r in queries.nodes(spark, WHERE).collect())
    of = {}
    for c, k in nodes:
        of.setdefault(c, []).append(k)
    near = {(r.c_a, r.c_b): r.SIMILARITY for r in queries.edges.similar_comments(queries.comments(spark, WHERE), queries.vectors(spark, WHERE)).collect()}
    assert any(len(own_) > 1 for own_ in of.values())

    def digest(pairs):
        return {(a, b): (len(of[a]) * len(of[b]), sum(1000 * x + y for x in of[a] for y in of[b])) for a, b in pairs if a in of and b in of}

    for name, least in (("edges_similarity_all", 0.0), ("filter_edge_similarity_all", 0.08)):
        got = {(r.src_c, r.tgt_c): (r.n, r.places) for r in own[name](spark, WHERE).collect()}
        assert got == digest(p for p, w in near.items() if w >= least)

    edges = sorted(((a, x), (b, y)) for a, b in near if a in of and b in of for x in of[a] for y in of[b])
    best = {v: [] for v in nodes}
    for e in edges:
        for v in e:
            best[v].append((-near[e[0][0], e[1][0]], e))
    kept = {e for v in nodes for _, e in sorted(best[v])[:2]}
    assert {((r.src_c, r.src_s), (r.tgt_c, r.tgt_s)) for r in own["bottom_edge_similarity_all"](spark, WHERE).collect()} == kept

    parts = plain.components(nodes, [e for e in edges if near[e[0][0], e[1][0]] >= 0.11])
    assert {((r.c_idx, r.s_idx), (r.rep_c, r.rep_s)) for r in own["merge_similarity"](spark, WHERE).collect()} == {(v, part[0]) for part in parts for v in part}

"""Versions: one commit for several tables, readers of older versions, writers that stop or collide; documents in parts."""

import json

import pytest
from pyspark.sql import functions as F

from threadgraph.operators import edges
from threadgraph.plans import pipeline
from threadgraph.schema import GraphError
from threadgraph.sources import store, versions

ARTICLE = "id long, url string"
COMMENT = "id long, article_id long, text string"


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.fixture()
def filled(spark, tmp_path):
    own = store.Store(spark, str(tmp_path / "store"))
    own.add({
        "articles": spark.createDataFrame([(1, "u1"), (2, "u2")], ARTICLE),
        "comments": spark.createDataFrame([(10, 1, "a"), (20, 2, "b"), (30, None, "c")], COMMENT),
    })
    own.add({"articles": spark.createDataFrame([(3, "u3"), (None, None)], ARTICLE), "comments": spark.createDataFrame([(40, 3, None)], COMMENT)})
    own.append("graphs", spark.createDataFrame([(1, "[1, 3]", "{}"), (2, "[2]", "{}"), (3, None, None)], store.GRAPHS))
    return own


def test_readers_keep_their_version(spark, filled):
    before, then = filled.read("comments"), filled.versions.current()
    filled.delete_articles(spark.createDataFrame([(1,), (1,), (None,), (77,)], "id long"))
    assert ids(before) == [10, 20, 30, 40] and ids(filled.read("comments", then)) == [10, 20, 30, 40]
    assert ids(filled.read("comments")) == [20, 30, 40]
    assert sorted(filled.read("articles").select("id").toPandas()["id"].fillna(-1)) == [-1, 2, 3]
    assert ids(filled.read("graphs")) == [2, 3]
    assert filled.versions.current().number == then.number + 1


def test_only_touched_folders_are_written(spark, filled):
    before = filled.versions.current().tables
    filled.delete_articles(spark.createDataFrame([(3,)], "id long"), recursive=False)
    after = filled.versions.current().tables
    assert after["comments"] == before["comments"] and after["graphs"] == before["graphs"]
    assert before["articles"][0] in after["articles"] and before["articles"][1] not in after["articles"]
    filled.delete_articles(spark.createDataFrame([], "id long"))
    assert filled.versions.current().tables == after
    filled.delete_comments(spark.createDataFrame([(2,)], "id long"))
    filled.delete_graphs(spark.createDataFrame([(3,)], "id long"))
    assert ids(filled.read("comments")) == [10, 30, 40] and ids(filled.read("graphs")) == [2, 3]
    assert ids(filled.graph([2])) == [2] and ids(filled.graph([2, 1])) == []


def test_a_writer_stops_between_tables(spark, filled, monkeypatch):
    tables = filled.versions.current().tables
    write = versions.Versions.write

    def stops(self, name, rows):
        if name == "comments":
            raise RuntimeError("stopped")
        return write(self, name, rows)

    monkeypatch.setattr(versions.Versions, "write", stops)
    with pytest.raises(RuntimeError):
        filled.delete_articles(spark.createDataFrame([(1,)], "id long"))
    with pytest.raises(RuntimeError):
        filled.add({"articles": spark.createDataFrame([(9, "u9")], ARTICLE), "comments": spark.createDataFrame([(90, 9, "x")], COMMENT)})
    assert filled.versions.current().tables == tables and ids(filled.read("comments")) == [10, 20, 30, 40]
    monkeypatch.undo()
    assert filled.versions.vacuum(older_than=86400) == 0  # what the stopped ones left is young
    assert filled.versions.vacuum(keep=1, older_than=0) == 2 and filled.versions.numbers() == [3]
    assert ids(filled.read("comments")) == [10, 20, 30, 40] and ids(filled.read("graphs")) == [1, 2, 3]


def test_colliding_writers(spark, filled):
    other, seen = store.Store(spark, filled.versions.path), []

    def change(base):
        if not seen:
            other.append("comments", spark.createDataFrame([(50, 5, "late")], COMMENT))
        seen.append(base.number)
        return base.tables | {"articles": []}

    filled.versions.commit(change)
    assert seen == [3, 4] and ids(filled.read("comments")) == [10, 20, 30, 40, 50] and filled.read("articles").count() == 0

    def always(base):
        other.append("comments", spark.createDataFrame([(60, 6, "x")], COMMENT))
        return base.tables

    with pytest.raises(versions.Conflict):
        filled.versions.commit(always)


def test_an_override_is_one_commit(spark, filled):
    scraped = spark.createDataFrame([(8, "u1")], ARTICLE), spark.createDataFrame([(80, 8, "new")], COMMENT)
    before = filled.versions.current().number
    assert ids(filled.get_article("u1", lambda url: scraped, override_cache=True)) == [8]
    assert filled.versions.current().number == before + 1
    assert ids(filled.read("comments")) == [20, 30, 40, 80] and ids(filled.read("graphs")) == [2, 3]
    assert ids(filled.get_article("u1", None)) == [8]
    assert ids(filled.get_article("u1", lambda url: scraped, ignore_cache=True)) == [8, 8]  # stored even so


def test_empty_store(spark, tmp_path):
    own = store.Store(spark, str(tmp_path / "none"))
    assert own.read("articles").count() == 0 and own.versions.current().number == 0 and own.versions.vacuum() == 0
    own.delete_articles(spark.createDataFrame([(1,)], "id long"))
    assert own.read("comments").count() == 0
    with pytest.raises(GraphError):
        own.versions.read(own.versions.current(), "nothing")


def test_a_cached_graph_stays_as_read(spark, tmp_path):
    comments = spark.createDataFrame([(k, k, 1, "One sentence here. Another sentence there. The third sentence.") for k in range(4)], "c_idx long, id long, article_id long, text string")
    cache, graph = pipeline.GraphCache(spark, str(tmp_path / "graphs")), edges.graph_of(comments)
    cache.store("k", graph)
    old = cache.load("k")
    cache.store("k", graph.with_(edges=graph.edges.where("src_c = 0")))
    assert old.edges.count() == 8 and cache.load("k").edges.count() == 2
    cache.drop("k")
    assert not cache.has("k") and old.edges.count() == 8


@pytest.mark.parametrize("per_part", [1, 3, 100])
def test_parts_are_the_document(spark, per_part):
    comments = spark.createDataFrame([(k, 70 - k, 1, "Öne sentence here. Another sentence there. The third \"sentence\".") for k in range(5)], "c_idx long, id long, article_id long, text string")
    graph = edges.graph_of(comments)
    whole = pipeline.to_document(graph).first().asDict()
    rows = pipeline.document_parts(graph, per_part).collect()
    for kind in ("comments", "edges"):
        own = sorted((r for r in rows if r.kind == kind), key=lambda r: r.part)
        assert [r.part for r in own] == list(range(len(own)))
        text = "".join(r.json for r in own)
        assert text == whole[kind] and len(json.loads(text)) == (5 if kind == "comments" else 10)
        for r in own:
            assert r.bytes == len(r.json.encode()) and text.encode()[r.start : r.start + r.bytes] == r.json.encode()
    assert json.loads(whole["edges"])[0]["src"] == {"src_c": 0, "src_s": 0}


def test_documents_of_no_rows_and_too_many(spark, monkeypatch):
    comments = spark.createDataFrame([(0, 1, 1, None), (1, 2, 1, "")], "c_idx long, id long, article_id long, text string")
    empty = edges.graph_of(comments)
    assert tuple(pipeline.to_document(empty).first()) == ("[]", "[]")
    assert sorted(tuple(r) for r in pipeline.document_parts(empty).collect()) == [("comments", 0, 0, 2, "[]"), ("edges", 0, 0, 2, "[]")]
    many = edges.graph_of(comments.withColumn("text", F.lit("One sentence here. Another sentence there.")))
    with pytest.raises(GraphError):
        pipeline.to_document(many, limit=3)
    monkeypatch.setattr(pipeline, "PART_BUCKET", 2)
    texts = [r.json for r in pipeline.document_parts(many, 1).where("kind = 'comments'").orderBy("start").collect()]
    assert "".join(texts) == pipeline.to_document(many).first().comments

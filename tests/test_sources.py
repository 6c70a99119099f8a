import json

import pytest
from pyspark.sql import functions as F

from threadgraph.functions import stem, vectors
from threadgraph.functions import text as tx
from threadgraph.operators import search, view
from threadgraph.sources import comments as src
from threadgraph.sources import ingest, pages, store
from threadgraph.streaming import live


def test_platforms_and_urls(spark):
    urls = ["https://www.welt.de/a#b", "welt.de/a", "https://m.faz.net/x#y#z", "http://zeit.de/", "sueddeutsche.de/1", "https://www.spiegel.de/x#y", "https://taz.de/!1/", "https://www.tagesschau.de/x", "https://example.org/zeit.de/", None]
    df = spark.createDataFrame(list(enumerate(urls)), "k int, url string").select("k", ingest.platform(F.col("url")).alias("p"), ingest.prepared_url(F.col("url")).alias("u"))
    got = {r.k: (r.p, r.u) for r in df.collect()}
    assert got == {
        0: ("WeltScraper", "https://www.welt.de/a"), 1: (None, None), 2: ("FAZScraper", "https://faz.net/x"), 3: ("ZONScraper", "http://zeit.de/"), 4: ("SueddeutscheScraper", "sueddeutsche.de/1"),
        5: ("SPONScraper", "https://www.spiegel.de/x#y"), 6: ("TAZScraper", "https://taz.de/!1/"), 7: ("TagesschauScraper", "https://www.tagesschau.de/x"), 8: (None, None), 9: (None, None),
    }


def test_json_platforms(spark):
    disqus = {"cursor": {"hasNext": False}, "response": [{"id": "1", "author": {"username": "u"}, "createdAt": "2020-01-02T03:04:05", "raw_message": "a \n  b", "parent": None}]}
    pages = spark.createDataFrame([("x", 0, json.dumps(disqus)), ("y", 0, "no json")], "url string, page int, payload string")
    (r,) = ingest.disqus(pages).collect()
    assert (r.comment_id, r.text, r.username, str(r.timestamp)) == ("1", "a b", "u", "2020-01-02 03:04:05")
    welt = lambda i, t, at: {"id": i, "user": {"displayName": "n", "id": "7"}, "created": at, "contents": t, "likes": 2}
    rows = [("x", 0, json.dumps({"comments": [welt("a", "old", "2020-01-01T00:00:00.5"), welt("b", "b", "2020-01-01T00:00:00")]})), ("x", 1, json.dumps({"comments": [welt("a", "new", "2020-01-01T00:00:00")]}))]
    out = {r.comment_id: r for r in ingest.welt(spark.createDataFrame(rows, "url string, page int, payload string")).collect()}
    assert out["a"].text == "new" and out["a"].ordinal.page == 0 and out["b"].likes == 2
    node = lambda i, body, replies=(), user=True: {"id": i, "user": {"username": "u", "id": "1"} if user else None, "body": body, "created_at": "2020-01-01T00:00:00.000Z", "action_summaries": [{"__typename": "UpvoteActionSummary", "count": 3}], "replies": {"nodes": list(replies)}}
    tree = {"nodes": [node("1", "a", [node("2", None, [node("3", "c")])]), node("4", "d", user=False)]}
    out = {r.comment_id: r for r in ingest.spiegel(spark.createDataFrame([("x", 0, json.dumps(tree))], "url string, page int, payload string")).collect()}
    assert set(out) == {"1", "3"} and out["3"].reply_to == "2" and out["1"].reply_to is None and (out["1"].upvotes, out["1"].love) == (3, 0)


def test_html_and_dates(spark):
    html = "<html><title>T &amp; t</title><script>var x='<p>no</p>'</script><h1>Head</h1><p>One <b>bold</b><p>Two<ul><li>item</ul><a href='/x'>y</a>"
    rows = {r.url: r for r in ingest.parse_html(spark.createDataFrame([("a", html), ("b", None)], "url string, html string")).collect()}
    assert (rows["a"].title, rows["a"].heading, rows["a"].text, rows["a"].n_links) == ("T & t", "Head", "One bold\nTwo", 1) and rows["b"].title is None
    df = spark.createDataFrame([("Am 3. März 2020 um 14:05 von Anna B.",)], "h string").select(ingest.tagesschau_header(F.col("h")).alias("x")).first().x
    assert (df.username, str(df.timestamp)) == ("Anna B.", "2020-03-03 14:05:00")
    when = spark.createDataFrame([("vor 2 Stunden",), ("vor 3 Tagen",), ("vor 5 Wochen",), ("7. Mai 2020, 9:30 Uhr",)], "t string")
    got = [str(r.x) for r in when.select(ingest.zeit_time(F.col("t"), F.lit("2020-05-10 12:00:00").cast("timestamp")).alias("x")).collect()]
    assert got == ["2020-05-10 10:00:00", "2020-05-07 12:00:00", "2020-05-10 12:00:00", "2020-05-07 09:30:00"]


def test_status_order_and_ids(spark):
    articles = spark.createDataFrame([("https://taz.de/1", "p", 5), ("https://taz.de/2", "p", 6), ("https://taz.de/3", None, 7), ("https://no.org/", "p", 8)], "url string, payload string, id long")
    comments = spark.createDataFrame([("https://taz.de/1", "b", "2020-01-01 00:00:00", 1), ("https://taz.de/1", "a", "2020-01-01 00:00:00", 0), ("https://taz.de/1", "c", "2019-01-01 00:00:00", 2)], "url string, comment_id string, at string, ordinal int")
    comments = comments.withColumn("timestamp", F.col("at").cast("timestamp"))
    assert {r.url[-2:]: r.status for r in ingest.statused(articles, comments).collect()} == {"/1": "OK", "/2": "NO_COMMENTS", "/3": "SCRAPER_ERROR", "g/": "NO_SCRAPER"}
    assert [(r.id, r.comment_id) for r in ingest.numbered(comments, articles).orderBy("id").collect()] == [(1, "c"), (2, "a"), (3, "b")]
    lines = spark.createDataFrame([("- https://x ",), ("# no",), ("-https://y",)], "value string")
    assert sorted(r.url for r in ingest.backfill_urls(lines).collect()) == ["https://x", "https://y"]


def test_replies_and_nesting(spark):
    rows = [(1, 1, "a", None), (2, 1, "b", "a"), (3, 1, "a", None), (4, 2, "c", "a")]
    df = src.conform(spark.createDataFrame(rows, "id long, article_id long, comment_id string, reply_to string"))
    got = {(r.id, r.reply_to_id) for r in src.resolve_replies(df).collect()}
    assert got == {(1, None), (2, 1), (2, 3), (3, None), (4, None)}  # a repeated comment_id multiplies its answers
    assert {r.id for r in src.resolve_replies(df, [2, "1", True]).collect()} == {4}
    articles = spark.createDataFrame([(1, "u"), (9, "v")], "id long, url string")
    assert {r.id: len(r.comments) for r in src.nest(articles, df).collect()} == {1: 3, 9: 0}
    placed = src.positions(df.withColumn("id", F.col("id") * 65536))
    assert [r.c_idx for r in placed.orderBy("id").collect()] == [0, 1, 2, 3]


def test_store(spark, tmp_path):
    own = store.Store(spark, str(tmp_path / "store"))
    scraped = (spark.createDataFrame([(1, "https://taz.de/1", "t")], "id long, url string, title string"), spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id long, article_id long, comment_id string"))
    calls = []

    def scrape(url):
        calls.append(url)
        return scraped

    assert own.get_article("https://taz.de/1", scrape).count() == 1
    assert own.get_article("https://taz.de/1", scrape).count() == 1 and len(calls) == 1
    own.append("graphs", spark.createDataFrame([(1, "[1, 2]", "{}"), (2, "[3]", "{}")], store.GRAPHS))
    assert [r.id for r in store.graph_id(own.read("graphs"), [2, 1]).collect()] == [1]
    own.delete_articles(spark.createDataFrame([(1,)], "id long"))
    assert own.read("comments").count() == 0 and [r.id for r in own.read("graphs").collect()] == [2]


def test_stemmer_known_words():
    # Examples of the published algorithm.
    known = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit valenci valenc digitizer digit radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll".split()
    for word, want in zip(known[::2], known[1::2], strict=True):
        assert stem.stem(word) == want, word
    assert stem.stem("is") == "is"


def test_search(spark):
    docs = spark.createDataFrame([(1, "Running runner runs"), (2, "The RUN of über things"), (3, "thing"), (4, None)], "id long, text string")
    index = search.build_index(docs)
    assert [r.doc for r in search.search(index, docs, " run ").collect()] == [1, 2]
    assert [r.doc for r in search.search(index, docs, "run th").collect()] == [2]
    assert search.search(index, docs, "zebra run").count() == 0 and search.search(index, docs, " . ").count() == 0
    exact = search.build_index(docs, "exact", stem=False, stop_words=["the"])
    assert {r.term for r in exact.collect()} == {"running", "runner", "runs", "run", "of", "ber", "things", "thing"}
    for query, strategy, stem in ((" run ", "prefix", True), ("run th", "prefix", True), ("the", "exact", False), ("u", "all", False), ("n th", "all", False), (" . ", "prefix", True)):
        whole, own = search.build_index(docs, strategy, stem=stem), search.build_index(docs, strategy, query, stem=stem)
        asked = search.query_tokens(query, stem)
        assert sorted(own.collect()) == sorted(whole.where(F.col("term").isin(asked)).collect())
        assert search.search(own, docs, query, stem).collect() == search.search(whole, docs, query, stem).collect()
    assert not search.triggered("a") and search.triggered("ab")
    (r,) = docs.where("id = 2").select(search.highlight(F.col("text"), ["ru"]).alias("x")).collect()
    assert r.x == "The <mark>RU</mark>N of über things"


def test_views(spark):
    comments = spark.createDataFrame([(k, f"2020-01-01 00:00:{k:02d}") for k in range(11)], "id long, at string").withColumn("ts", F.col("at").cast("timestamp"))
    assert {r.id: r.bin for r in view.time_bins(comments, 50).collect()} == {k: k for k in range(11)}
    assert sorted(r.id for r in view.brush(comments, 2, 4, 50).collect()) == [2, 3, 4]
    shown = view.apply_filter(view.with_filters(comments), "search", comments.where("id < 3"))
    assert view.counter(view.visible(shown, ["search"])).first() == (3, 11)
    assert view.counter(view.visible(view.clear_filters(shown), [])).first() == (11, 11)
    placed = spark.createDataFrame([(1, 50.0, 40.0), (1, 0.0, 0.0), (2, 95.0, 95.0)], "id long, x double, y double")
    assert {r.id: r.selected for r in view.lasso(placed, [(10.0, 10.0), (80.0, 20.0), (60.0, 90.0), (20.0, 70.0)]).collect()} == {1: True, 2: False}
    votes = spark.createDataFrame([(1, 7, 0, 1), (1, 7, 1, 1), (2, 7, 0, -1), (2, 8, 0, -1)], "vote_id int, id long, s_idx long, vote int")
    totals = view.vote_totals(votes)
    assert {r.id: (r.votes, r.least, r.most) for r in totals.collect()} == {7: (0, -1, 0), 8: (-1, -1, 0)}
    assert {r.id: r.colour for r in view.vote_colour(totals).collect()} == {7: 1.0, 8: 0.0}


def test_tokens_and_cosine(spark):
    df = spark.createDataFrame([("a;b (c) d\ne f",), ("",)], "t string")
    rows = df.select(tx.token_window(tx.normalize(F.col("t")), 4).alias("w")).collect()
    assert [r.w for r in rows] == [[")", "d", "e", "f"], [""] * 4]
    vs = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [0.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r.c for r in vs.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 1.0, 0.0, 0.0]


@pytest.mark.parametrize("kind", ["rate", "votes", "sessions"])
def test_streams(spark, tmp_path, kind):
    rows = [(1, 1, "u", 1, 1, "2020-01-01 00:01:00"), (1, 1, "u", 1, 1, "2020-01-01 00:01:00"), (2, 1, "v", 2, -1, "2020-01-01 00:05:00"), (3, 2, "u", 3, 1, "2020-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "id long, article_id long, username string, vote_id int, vote int, at string").selectExpr("id", "article_id", "username", "vote_id", "vote", "cast(at as timestamp) ts")
    path = str(tmp_path / "in")
    df.write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    made = {"rate": live.comment_rate, "votes": live.running_votes, "sessions": live.sessions}[kind](stream)
    q = made.writeStream.outputMode("complete").format("memory").queryName(f"live_{kind}").start()
    q.processAllAvailable()
    q.stop()
    out = [tuple(r) for r in spark.sql(f"select * from live_{kind}").collect()]
    if kind == "rate":
        assert sorted((r[0], r[3]) for r in out) == [(1, 3), (2, 1)]
    elif kind == "votes":
        assert sorted(out) == [(1, 1), (2, -1), (3, 1)]
    else:
        assert sorted((r[0], r[3]) for r in out) == [("u", 1), ("u", 2), ("v", 1)]


def test_selectors():
    page = pages.document('<div id=a class="x y"><p>1<p>2 <b>3</b><ul><li>4<li>5<ul><li>6</ul></ul></div><P class=x>7</P><img src=q><br/>8<script>no</script>')
    texts = lambda selector: [e.text().strip() for e in page.all(selector)]
    assert texts("p") == ["1", "2 3456", "7"] and texts(".x") == ["12 3456", "7"] and texts("#a > p, img") == ["1", "2 3456", ""]
    assert texts("div li li") == ["6"] and texts("li > ul > li") == ["6"] and texts("ul > li") == ["4", "56", "6"]
    outer = page.first("ul")
    assert [e.text() for e in outer.all(":scope > li")] == ["4", "56"]
    assert texts('img[src="q"]') == [""] and texts("img[src='r']") == [] and texts("p.x.y") == [] and page.first("nav") is None
    assert pages.document(None).all("p") == [] and pages.document("</p></div>text").text() == "text"


def test_pages_that_lack_parts_and_further_pages(spark):
    rows = [
        ("https://taz.de/1", 1, "<article><p class=article>only text</p></article>"), ("https://www.zeit.de/1", 1, None), ("https://example.org/", 1, "<h1>no platform</h1>"),
        ("https://www.zeit.de/2", 1, '<section id="comments"><div class="comment-section__body"><div class="comment__container"><a data-url="https://www.zeit.de/2?load=1"></a></div></div></section><ul class="pager__pages"><li><a href="https://www.zeit.de/2?page=2">2</a></li></ul>'),
        ("https://www.zeit.de/2", 2, '<article id="c9"><a class="comment-meta__date">#2 — vor 2 Stunden</a><div class="comment__body"><p> a </p><p>b</p></div></article><article>no id</article>'),
        ("https://www.faz.net/3", 1, '<a data-next-page-count="2"></a><li class="lst-Comments_Item-level1"></li>'), ("https://www.sueddeutsche.de/4", 1, '<div class="sz-article-body__asset"><a class="sz-teaser--article" href="/x/leserdiskussion-1">d</a></div>'),
        ("https://www.tagesschau.de/5", 1, '<div class="modConComments"><h3 class="headline"><a href="https://meta.tagesschau.de/5">m</a></h3></div>'),
    ]
    df = spark.createDataFrame(rows, "url string, page int, html string")
    found = {(r.url, r.text): r.problem for r in pages.articles(df).collect()}
    assert found["https://taz.de/1", "only text"] == "no title, published" and found["https://www.zeit.de/1", None] and not any("example" in u for u, _ in found)
    (r,) = pages.comments(df, F.lit("2020-05-10 12:00:00").cast("timestamp")).collect()
    assert (r.comment_id, r.text, r.username, r.reply_to, str(r.timestamp), r.ordinal) == ("c9", "a\n\nb", "", None, "2020-05-10 10:00:00", [2, 0])
    more = {(r.url[-1], r.more) for r in pages.more_pages(df).collect()}
    assert more == {("2", "https://www.zeit.de/2?load=1"), ("2", "https://www.zeit.de/2?page=2"), ("3", "https://www.faz.net/3#page=2"), ("4", "/x/leserdiskussion-1"), ("5", "https://meta.tagesschau.de/5")}
    assert pages.comments(df.where("false")).count() == 0 == pages.articles(df.where("false")).count()


def test_replies_of_any_depth_and_lists_that_go_on(spark):
    node = lambda i, *below, more=None: {"id": i, "user": {"username": "u", "id": "1"}, "body": i, "created_at": "2020-01-01T00:00:00.000Z", "action_summaries": None, "replies": {"nodes": list(below), **({"hasNextPage": True, "endCursor": more} if more else {})}}
    deep = node("40")
    for k in range(39, 0, -1):
        deep = node(str(k), deep, more="c12" if k == 12 else None)
    pages_ = spark.createDataFrame([("x", 0, None, json.dumps({"nodes": [deep, node("z")], "hasNextPage": True, "endCursor": "top"})), ("x", 1, "12", json.dumps({"nodes": [node("12b")]})), ("y", 0, None, "[]"), ("y", 1, None, "{")], "url string, page int, parent string, payload string")
    out = {r.comment_id: r for r in ingest.spiegel(pages_).collect()}
    assert set(out) == {*map(str, range(1, 41)), "z", "12b"}
    assert all(out[str(k)].reply_to == str(k - 1) for k in range(2, 41)) and out["12b"].reply_to == "12" and out["z"].reply_to is None
    order = [r.comment_id for r in sorted(out.values(), key=lambda r: r.ordinal)]
    assert order == [*map(str, range(1, 41)), "z", "12b"]
    assert {(r.parent, r.cursor) for r in ingest.spiegel_more(pages_).collect()} == {("12", "c12"), (None, "top")}


def test_stories_and_text_vectors(spark):
    articles = spark.createDataFrame([(1, "https://taz.de/1"), (2, "https://faz.net/2")], "id long, url string")
    listed = spark.createDataFrame([("a", ["https://m.faz.net/2#c", "https://no.org/", "https://taz.de/1"]), ("none", [])], "title string, sources array<string>")
    assert {r.title: [s.id for s in r.sources] for r in src.stories(listed, articles).collect()} == {"a": [2, None, 1], "none": []}
    known = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 2.0]), ("zero", [0.0, 0.0])], "word string, embedding array<double>")
    texts = spark.createDataFrame([(1, "a b\nb  unknown zero"), (2, ""), (3, None)], "id long, text string")
    got = {r.id: r.embedding for r in vectors.sentence_vectors(texts, known, 2).collect()}
    assert got[1] == pytest.approx([0.2, 2.8 / 3]) and got[2] == got[3] == [0.0, 0.0]
    df = spark.createDataFrame([("The Äpfel, 3x_y!",), (None,)], "t string")
    assert [r.x for r in df.select(tx.preprocess(F.col("t"), stop_words=["the"]).alias("x")).collect()] == [["äpfel", ",", "3x_y", "!"], []]


def test_steps_are_kept_in_the_shared_folder_and_deleted(spark):
    from pathlib import Path

    from threadgraph import storage

    kept = storage.materialise(spark.range(3), "probe")
    assert kept.count() == 3 and storage.steps_dir(spark).startswith(storage.shared_dir(spark))
    folder = Path(storage.steps_dir(spark).removeprefix("file://"))
    assert any(p.name.startswith("probe-") for p in folder.iterdir())
    storage.delete_steps(spark)
    assert not folder.exists()

    class Cluster:  # a session on a cluster without a shared folder
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master, applicationId = "yarn", "x"
            getConf = staticmethod(lambda: Cluster.conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Cluster)


def test_crawl_reaches_chains_cycles_and_replies(spark):
    """Three pages in a chain, one of replies behind them, a cycle back, one named by two, one that isn't there, one that none names."""
    import json

    def page(ids, after=None, replies=None):
        nodes = [{"id": i, "user": {"username": "u", "id": "1"}, "body": i} for i in ids] + [None]
        if replies:
            nodes[0]["replies"] = {"nodes": [], "hasNextPage": True, "endCursor": replies}
        return json.dumps({"nodes": nodes, "hasNextPage": after is not None, "endCursor": after})

    rows = [
        ("u", None, None, 0, page(["a", "b"], "1", "r")),
        ("u", None, "1", 1, page(["c"], "2")),
        ("u", None, "2", 2, page(["d"], "3")),
        ("u", None, "3", 3, page(["e"], "1", "gone")),
        ("u", "a", "r", 0, page(["f"], "1")),
        ("u", "a", "1", 1, page(["g"])),
        ("u", None, "x", 9, page(["no"])),
        ("v", None, "1", 1, page(["no"])),
    ]
    table = spark.createDataFrame(rows, "url string, parent string, cursor string, page int, payload string")
    found = ingest.crawled(table, "cursor is null", ingest.spiegel_more, ["url", "parent", "cursor"])
    assert found.columns == table.columns
    assert sorted((r.comment_id, r.reply_to) for r in ingest.spiegel(found).collect()) == [("a", None), ("b", None), ("c", None), ("d", None), ("e", None), ("f", "a"), ("g", "a")]
    assert ingest.crawled(table.limit(0), "cursor is null", ingest.spiegel_more, ["url", "parent", "cursor"]).count() == 0


def test_payload_problems(spark):
    deep = '{"a":' * 200_000 + "1" + "}" * 200_000
    rows = [("a", 1, "{}"), ("b", 2, None), ("c", 3, "{"), ("d", 4, "[1]"), ("e", 5, deep)]
    found = ingest.payload_problems(spark.createDataFrame(rows, "url string, page int, payload string")).collect()
    assert sorted((r.url, r.page, r.problem) for r in found) == [("b", 2, "no payload"), ("c", 3, "no JSON"), ("d", 4, "no object"), ("e", 5, "nested too deeply")]

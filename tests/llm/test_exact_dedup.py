import hashlib
import random
from collections import defaultdict

from threadgraph.llm import exact_dedup

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(UPPER)].append(doc_id)
    best = {n: max((d for d in g if d is not None), default=None) for n, g in groups.items()}
    return {(d, best[n], len(g), d == best[n], hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for d in g}


def test_groups(docs_of, odd_texts):
    texts = odd_texts + ["É", "é", "HOT"] + ["hot"] * 200
    got = exact_dedup.exact_groups(docs_of(texts), max_depth=4, capacity=10)
    assert {tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()} == brute(enumerate(texts))


def test_dedup_keeps_columns_and_repeated_rows_once(docs_of):
    docs = docs_of(["a", "A", "b", None, ""])
    out = exact_dedup.exact_dedup(docs.union(docs))
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 4]


def test_shared_and_null_ids_lose_no_text(spark):
    rng = random.Random(4)
    ids, texts = [None, None, None, 5, 5, 6, 7], ["A", "a", "B", "c", "C", "d", None, "HOT", "hot", "hoT"]
    rows = [(5, "A"), (5, "C"), (5, "B"), (9, "b"), *((rng.choice(ids), rng.choice(texts)) for _ in range(150)), *[(None, "hot")] * 90]
    for capacity in (4, 4096):
        for own in (rows, rows[:4], [(5, "B"), (5, "A"), (9, "b")]):
            docs = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
            got = exact_dedup.exact_groups(docs, capacity=capacity)
            assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(next(b for b in brute(own) if (b[0], b[4]) == (d, digest(t)))) for d, t in own)
            kept = [(r.doc_id, digest(r.text)) for r in exact_dedup.exact_dedup(docs, capacity=capacity).collect()]
            assert len(kept) == len(set(kept)) and set(kept) == {(b[1], b[4]) for b in brute(own)}


def digest(text):
    return hashlib.sha256((text or "").translate(UPPER).encode()).hexdigest()


def test_index_is_what_results_are_read_from(docs_of, monkeypatch):
    docs = docs_of([f"text {k % 60}" for k in range(300)] + ["hot"] * 100)
    seen = []
    plain = exact_dedup.materialise
    monkeypatch.setattr(exact_dedup, "materialise", lambda df, name: seen.append((name, plain(df, name))) or seen[-1][1])
    exact_dedup.exact_groups(docs, capacity=8)
    index = dict(seen)["exact-index"]
    assert index.count() == 400 and index.select("_bucket").distinct().count() > 20
    # A bucket is a range of keys; the hot text is dealt into parts.
    spans = sorted((r.lo, r.hi) for r in index.selectExpr("_bucket", "_key - (-9223372036854775807 - 1) as k", "shiftrightunsigned(_key, 1) as u").groupBy("_bucket").agg({"u": "min"}).join(index.selectExpr("_bucket", "shiftrightunsigned(_key, 1) as u").groupBy("_bucket").agg({"u": "max"}), "_bucket").toDF("b", "lo", "hi").collect())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert index.where("_parts > 1").select("_part").distinct().count() > 8


def test_names_of_the_index_may_be_taken(spark):
    docs = spark.createDataFrame([(1, "a", "x", 6, True), (2, "A", "y", 8, False)], "doc_id long, text string, _kept_id string, _KEY int, _bucket boolean")
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(2, "A", "y", 8, False)]


def test_clashing_columns_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", 5, 6, True), (2, "A", 7, 8, False)], "doc_id long, text string, _key int, group_size int, kept boolean")
    assert [tuple(r) for r in exact_dedup.exact_dedup(docs).collect()] == [(2, "A", 7, 8, False)]
    assert exact_dedup.exact_groups(docs.where("false")).count() == 0


def test_directory_doubles_only_where_full():
    depth, directory = exact_dedup.build_directory({0: 50, 1: 50, 12: 3}, 4, 60)
    assert depth == 4 and len(directory) == 16
    assert directory[0] != directory[1] and len(set(directory[8:])) == 1
    assert exact_dedup.build_directory({3: 10}, 4, 60) == (0, [0])
    depth, directory = exact_dedup.build_directory({5: 1000}, 4, 60)
    assert depth == 4 and directory.count(directory[5]) == 1


def test_rows_without_an_id(spark):
    rows = [(None, "a"), (None, "A"), (None, "b"), (3, "B"), (None, None)]
    out = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in out.collect()) == [(0, ""), (0, "a"), (3, "b")]

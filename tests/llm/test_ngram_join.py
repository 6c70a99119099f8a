import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadgraph.llm import ngram_join as nj
from threadgraph.operators.components import connected_components

from .conftest import words

UPPER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = [shingle_set(t) for t in texts]
    above = list(range(len(texts)))

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                x, y = find(a), find(b)
                above[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in enumerate(sets)}


class Links:
    def __init__(self, n):
        self.above = list(range(n))

    def find(self, x):
        while self.above[x] != x:
            x = self.above[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.above[max(a, b)] = min(a, b)


def edited(rng, text, rate):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < rate else w for w in text.split(" "))


@pytest.fixture(scope="module")
def texts(odd_texts):
    rng = random.Random(8)
    bases = [words(rng, rng.randint(20, 160), 900) for _ in range(8)]
    passage = words(rng, 60, 900)
    out = [*odd_texts, "one two", "One  TWO", "one two three four five", "one two three four five six"]
    for k in range(130):
        out.append(edited(rng, bases[k % 8], rng.choice([0, 0.005, 0.02, 0.03, 0.04, 0.06])))
    out += [passage + " " + words(rng, rng.randint(3, 90), 900) for _ in range(40)]
    chain = words(rng, 100, 900).split(" ")
    out += [" ".join(chain[k : k + 60]) for k in range(0, 40, 4)]  # neighbours link, ends don't
    return out


def test_against_brute_force(docs_of, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.jaccard_components(docs_of(texts)).collect()}
    want = brute(texts)
    assert got == want
    assert sum(c != k for k, (_, c) in want.items()) > 80


def test_thresholds_at_the_border(docs_of):
    w = [f"w{k}" for k in range(40)]
    rows = []
    for n, cut in ((11, 8), (11, 9), (18, 14), (18, 15), (25, 20), (25, 21)):  # prefixes: exactly and just under 75 %
        rows += [" ".join(f"{n}{cut}{x}" for x in w[:n]), " ".join(f"{n}{cut}{x}" for x in w[:cut])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.jaccard_components(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_trees_against_all_pairs_and_blocks():
    rng = random.Random(3)
    for _ in range(150):
        base = [sorted(rng.sample(range(80), rng.randint(1, 30))) for _ in range(3)]
        sets, sizes = [], []
        for _ in range(rng.randint(2, 25)):
            s = set(rng.choice(base))
            for _ in range(rng.randint(0, 5)):
                s.symmetric_difference_update({rng.randrange(80)})
            own = rng.randint(0, 2)  # elements of no other set
            if s:
                sets.append(np.array(sorted(s), np.int32))
                sizes.append(len(s) + own)
        split = rng.choice([None, len(sets) // 2])
        links = nj.link_group(sets, sizes, split)
        plain = Links(len(sets))
        for a in range(len(sets)):
            for b in range(a):
                i = len(np.intersect1d(sets[a], sets[b]))
                if 100 * i >= 75 * (sizes[a] + sizes[b] - i) and (split is None or (b < split <= a)):
                    plain.join(a, b)
        assert links.tolist() == [plain.find(k) for k in range(len(sets))]


def test_large_groups_in_blocks(docs_of, texts, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.jaccard_components(docs_of(texts)).collect()}
    assert got == brute(texts)


def test_copies_as_hubs_of_their_batch(spark, docs_of, texts):
    rng = random.Random(11)
    base = words(rng, 120, 900)
    near = base + " a near copy"

    def components(rows, parts, size):
        sets = nj.sets_of(docs_of(rows))
        own = {r.doc_id: r for r in sets.collect()}
        # Rows are numbered here as they are in the list.
        dealt = spark.sparkContext.parallelize([[(k, *own[k][1:]) for k in part] for part in parts], len(parts)).flatMap(lambda x: x)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found = {r.id: r.component for r in nj.components_of(spark.createDataFrame(dealt, sets.schema)).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {k: found.get(k, k) for k in own} == {k: c for k, (_, c) in brute(rows).items()}

    components([base, base, near], [[0], [1, 2]], 2)  # the copy is the hub of the near copy
    components([base, base, near], [[0], [1], [2]], 1)
    components([near, base, base, near + " too"], [[1], [2, 3], [0]], 2)
    mixed = list(range(len(texts)))
    rng.shuffle(mixed)
    components(texts, [mixed[k::9] for k in range(9)], 4)


def test_shared_items_give_a_forest():
    """Documents that share many items, in whatever order, give fewer rows than there are documents, and the same components."""
    import pyarrow as pa

    rng = random.Random(6)
    rows = [(item, doc, None) for item in range(300) for doc in range(item % 3, 90, 3) if rng.random() < 0.7]
    rows += [(10**6 + doc, doc, doc % 3) for doc in range(60, 90)]
    names, kinds = ["item", "doc", "hub"], [pa.int64()] * 3
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[k : k + 50], strict=True), kinds, strict=True)], names=names) for k in range(0, len(rows), 50)]
    pairs = [(r["u"], r["v"]) for b in nj._meet(batches) for r in b.to_pylist()]
    links = Links(90)
    for u, v in pairs:
        links.join(u, v)
    assert [links.find(k) for k in range(90)] == [k % 3 for k in range(90)]
    assert len(pairs) == 87 < len({(d, i) for i, d, _ in rows}) / 50


def test_one_of_each_nulls_repeats_and_empty(spark, docs_of):
    rng = random.Random(2)
    a, b, c = (words(rng, 50, 900) for _ in range(3))
    rows = [(4, a, 1), (3, a.upper(), 1), (3, a.upper(), 1), (9, b, 1), (None, b, 1), (6, "", 1), (7, None, 1), (None, c, 1), (None, c + " x", 2), (None, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component int")
    key = lambda r: (r.doc_id is not None, r.doc_id or 0)
    out = sorted((*key(r), r.n_shingles, r.component_id or 0) for r in nj.jaccard_components(docs).collect())
    assert out == [(False, 0, 0, 0), (False, 0, 46, 0), (False, 0, 46, 9), (False, 0, 47, 0), (True, 3, 46, 3), (True, 3, 46, 3), (True, 4, 46, 3), (True, 6, 0, 6), (True, 7, 0, 7), (True, 9, 46, 9)]
    kept = nj.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((*key(r), (r.text or "")[:5]) for r in kept.collect()) == [(False, 0, ""), (False, 0, c[:5]), (True, 3, a[:5].upper()), (True, 6, ""), (True, 7, ""), (True, 9, b[:5])]
    assert nj.jaccard_components(docs.where("false")).count() == 0 == nj.one_of_each(docs.where("false")).count()


def test_rows_that_share_an_id_do_not_bridge(spark):
    rng = random.Random(9)
    a, b, c = (words(rng, 80, 900) for _ in range(3))
    for shared in (None, 7):
        docs = spark.createDataFrame([(1, a + " e1"), (2, b + " e2"), (shared, a), (shared, b), (shared, c)], "doc_id long, text string").withColumn("_doc", F.lit(5)).withColumn("_MARK", F.lit(6))
        got = sorted((r.doc_id or 0, r.component_id or 0) for r in nj.jaccard_components(docs).collect())
        own = shared or 0
        assert got == sorted([(1, 1), (2, 2), (own, 1), (own, 2), (own, own)])
        kept = nj.one_of_each(docs)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(1, a + " e1"), (2, b + " e2"), (own, c)])


def test_counting_a_bucket_in_ranges(docs_of, texts, monkeypatch):
    rng = random.Random(1)
    hashes, owner = np.array([rng.randrange(1 << 41) for _ in range(500)], np.uint64).repeat(2), np.arange(1000) % 40
    import pyarrow as pa

    docs = np.zeros(40, nj.ROW)
    rows = [*nj._pack(0, docs, hashes, owner, 1), *nj._pack(40, docs, hashes[::3], owner[::3], 1)]
    names = [f.split()[0] for f in nj.PACKED.split(", ")]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
    batch = pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names=names)
    found = []
    for limit in (10**9, 60):
        monkeypatch.setattr(nj, "RANGE_ITEMS", limit)
        out = [r for b in nj._count([batch]) for r in b.to_pylist() if r["docs"] is None]
        assert (limit == 60) == (len(out) > 2)
        found.append({(r["slice"], o, i, s) for r in out for o, i, s in zip(np.frombuffer(r["owner"], "<u4").tolist(), [r["item"][k : k + 5] for k in range(0, len(r["item"]), 5)], np.frombuffer(r["spread"], "<u2").tolist())})
    assert found[0] == found[1] and len(found[0]) > 900


def test_shared_shingles_stay_in_their_slice(spark, docs_of, texts, monkeypatch):
    """Whatever number of documents a slice deals out as a number only, sets are the same."""
    found = []
    for hot in (1 << 40, 16, 3, 2):
        monkeypatch.setattr(nj, "HOT", hot)
        rng = np.random.default_rng(2)
        hashes = np.concatenate([rng.integers(0, 400, 3000, dtype=np.uint64) << np.uint64(33), rng.integers(0, 1 << 63, 500, dtype=np.uint64)])
        owner = rng.integers(0, 90, len(hashes))
        rows = [r for k in range(3) for r in nj._pack(1000 * k, np.zeros(90, nj.ROW), hashes[k::3], owner[k::3], 4)]
        rows.sort(key=lambda r: r["bucket"])
        back = [r for limit in (10**9,) for b in nj._count(_batches(rows, nj.PACKED)) for r in b.to_pylist()]
        back.sort(key=lambda r: r["slice"])
        sets = [r for b in nj._assemble(_batches(back, nj.BACK)) for r in b.to_pylist()]
        found.append([(r["id"], r["n"], r["items"], r["spread"], r["same"]) for r in sets])
    assert all(f == found[0] for f in found) and sum(r[2] is not None for r in found[0]) > 50


def _batches(rows, schema):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return [pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows[k : k + 7]], kinds[t]) for n, t in fields], names=[n for n, _ in fields]) for k in range(0, len(rows), 7)]


def test_a_shingle_of_all_documents(spark):
    """What a shingle puts into its bucket doesn't grow with the documents that have it."""
    held, n = [], 100_000
    for docs in (1000, n):
        texts = [b"one very common passage of words %d" % k for k in range(docs)]
        hashes, owner = nj.shingles(texts)
        rows = list(nj._pack(0, np.zeros(docs, nj.ROW), hashes, owner, 256))
        shared = [r for r in rows[1:] if r.get("owner") is None]
        held.append([(len(r["low"]), len(r["sizes"])) for r in shared])
        assert sum(int(np.frombuffer(r["sizes"], "<u4").sum()) for r in shared) == 2 * docs
    assert held[0] == held[1]
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("one very common passage of words "), F.col("id"), F.lit(" and "), F.col("id") * 7 + 1, F.lit(" x y z "), F.col("id")).alias("text"))
    got = nj.jaccard_components(docs).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("component_id") == F.col("doc_id")).cast("int")).alias("own"), F.min("n_shingles").alias("a"), F.max("n_shingles").alias("b")).first()
    assert tuple(got) == (n, n, 9, 9)  # 13 words


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(60)] + [(1000, rng.randrange(1001, 1100)) for _ in range(80)] + [(rng.randrange(2000, 2080), rng.randrange(2000, 2080)) for _ in range(50)] + [(7, 7)]
    above = {}

    def find(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            above[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(above)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_sizes_count_all_bits_of_a_hash():
    """Hashes that agree in bucket and low bits count one by one in a document's size, whatever their order, and repeats don't."""
    rng = np.random.default_rng(4)
    for _ in range(50):
        low = rng.integers(0, 6, 60, dtype=np.uint64) * np.uint64(977)
        hashes = low | rng.integers(0, 3, 60, dtype=np.uint64) << np.uint64(60)  # bits that neither bucket nor place in it has
        owner = np.sort(rng.integers(0, 5, 60)).astype(np.int32)
        rows = list(nj._pack(0, np.zeros(5, nj.ROW), hashes, owner, 256))
        want = [len(set(hashes[owner == k].tolist())) for k in range(5)]
        assert np.frombuffer(rows[0]["sizes"], "<i4").tolist() == want
        kept = sum(len(r["low"]) // 4 for r in rows[1:])
        assert kept == len(set(zip(owner.tolist(), low.tolist(), strict=True)))

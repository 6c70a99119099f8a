import hashlib
import random

import numpy as np
import pytest

from threadgraph.llm import induced_sort
from threadgraph.llm import suffix_dedup as sd
from threadgraph.llm.induced_sort import permuted_common_prefixes, suffix_array

from .conftest import words


def brute(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[doc] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.fixture(scope="module")
def texts(odd_texts):
    rng = random.Random(6)
    passages = [words(rng, 60, 500) for _ in range(4)]
    out = [*odd_texts, "ab" * 400, "abc" * 300 + "x" + "abc" * 300, "\0" * 300, "é" * 250 + "z" + "é" * 250]
    for k in range(60):
        p = passages[k % 4]
        cut = rng.randint(0, 60)
        out.append(words(rng, rng.randint(0, 40), 500) + " " + p[cut : cut + rng.randint(80, 300)] + " " + words(rng, rng.randint(0, 40), 500))
    base = words(rng, 200, 500)
    out += [base[:k] + "#" + base[k + 1 :] for k in (3, 99, 100, 101, 350, 700)]
    return out


def test_against_brute_force(docs_of, texts):
    got = {r.doc_id: tuple(r)[1:] for r in sd.digests(docs_of(texts)).collect()}
    assert got == brute(list(enumerate(texts)))


def test_small_slices_and_deferred_groups(docs_of, texts, monkeypatch, spark):
    monkeypatch.setattr(sd, "SLICE_BYTES", 700)  # in the driver; the workers get the functions below by value
    rows = [(k, t) for k, t in enumerate(texts)]
    import pyarrow as pa

    def frames(schema, found):
        return [b for b in found if b.num_rows]

    def sort(batches, keys):
        t = pa.Table.from_batches(batches)
        t = t.sort_by([(k, "ascending") for k in keys])
        return t.combine_chunks().to_batches(max_chunksize=97)

    docs = pa.RecordBatch.from_pydict({"doc": [k for k, _ in rows], "tag": [-k for k, _ in rows], "text": [t or "" for _, t in rows]})
    scanned = frames(None, sd._scan([docs.slice(0, 30), docs.slice(30)]))
    met = frames(None, sd._meet(sort(scanned, sd.KEYS)))
    found = pa.Table.from_batches(met).to_pylist()
    raw = {k: (t or "").encode() for k, t in rows}
    assert all(r["tag"] == -r["doc"] for r in found)
    pieces = [(r["h"], r["doc"], r["tag"], r["lo"], raw[r["doc"]][r["lo"] : r["hi"]]) for r in found if r["kind"] == 1]
    assert pieces
    names = ["h", "doc", "tag", "lo", "piece"]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pieces), (pa.int64(),) * 4 + (pa.binary(),))], names=names)
    results = []
    for limit in (sd.GROUP_BYTES, 300):
        monkeypatch.setattr(sd, "GROUP_BYTES", limit)
        settled = pa.Table.from_batches(frames(None, sd._settle(sort([batch], ["h", "doc", "tag", "lo"])))).to_pylist()
        seen, gone = set(), {k: np.zeros(len(v), bool) for k, v in raw.items()}
        for r in sorted((r for r in settled if r["piece"] is not None), key=lambda r: (r["piece"], r["doc"], r["lo"])):
            if r["piece"] in seen:
                gone[r["doc"]][r["lo"] : r["hi"]] = True
            seen.add(r["piece"])
        assert (limit == 300) == bool(seen)
        for r in [*(r for r in found if r["kind"] == 0), *(r for r in settled if r["piece"] is None)]:
            gone[r["doc"]][r["lo"] : r["hi"]] = True
        results.append({k: int(g.sum()) for k, g in gone.items()})
    assert results[0] == results[1] == {k: v[1] for k, v in brute(rows).items()}


def test_repeated_rows_null_ids_and_empty(spark, docs_of):
    rng = random.Random(1)
    a, b = words(rng, 80, 500), words(rng, 80, 500)
    rows = [(5, a), (5, a), (None, b), (7, a + b), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as doc", "1 as lo", "2 as h")
    got = sorted((r.doc_id is not None, r.doc_id, r.n_removed) for r in sd.digests(docs).collect())
    assert got == [(False, None, 0), (True, 2, 0), (True, 5, 0), (True, 5, 0), (True, 7, len(a) + len(b))]
    assert sd.digests(docs.where("false")).count() == 0
    data = {r.doc_id: bytes(r.data) for r in sd.remove_repeats(docs).collect()}
    assert data[7] == b"" and data[5] == a.encode()


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rng = random.Random(3)
    x, y, z = (words(rng, 60, 500) for _ in range(3))
    texts = {None: [x + x, y, "q" * 400, z + x, "short", y], 7: [z, "tiny", z + y, "q" * 250], 9: [x[:150] + "!" + y, z]}
    rows = [(k, t) for k, own in texts.items() for t in own]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tag = {(r.doc_id, r.text): r.tag for r in sd._documents(docs).collect()}
    # Documents in order: by doc_id (null first), then by hash; equal rows once.
    ordered = sorted(tag, key=lambda k: (k[0] is not None, k[0] or 0, tag[k]))
    by_place = brute(list(enumerate(t for _, t in ordered)))
    want = {key: by_place[k] for k, key in enumerate(ordered)}
    got = sd.remove_repeats(docs).collect()
    found = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.data).hexdigest()) for r in got)
    assert found == sorted((k is not None, k or 0, *want[k, t]) for k, t in rows)


def test_equal_windows_dealt_by_salt(spark):
    rows = [(d, 0, lo, lo + 100, p) for p in (b"a" * 100, b"b" * 100) for d in range(120) for lo in (0, 7)]
    rows += [(3, 0, 0, 100, b"a" * 100), (500, 0, 1, 101, b"c" * 100)]
    windows = spark.createDataFrame(rows, sd.SETTLED)
    later = {(bytes(r.piece), r.doc, r.lo) for r in sd._later_windows(windows).collect()}
    assert later == {(p, d, lo) for d, _, lo, _, p in rows if (d, lo) != (0, 0) and p != b"c" * 100}


def test_suffix_array_and_prefixes(monkeypatch):
    rng = random.Random(0)
    for k in range(900):
        monkeypatch.setattr(induced_sort, "WAVE", (1, 4, 10**9)[k % 3])
        n, k = rng.randint(1, 60), rng.choice([1, 2, 3, 5])
        text = np.array([rng.randrange(k) for _ in range(n)], np.int16)
        if rng.random() < 0.3:
            text = np.tile(text[: max(1, n // 4)], 4)
        plain = text.tolist()
        order = suffix_array(text)
        assert order.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
        for barrier in (-1, 0):
            common = permuted_common_prefixes(text, order, barrier)
            for j in range(1, len(order)):
                x, y = plain[order[j - 1] :], plain[order[j] :]
                m = next((i for i in range(min(len(x), len(y))) if x[i] != y[i] or x[i] == barrier), min(len(x), len(y)))
                assert common[order[j]] == m


def test_suffix_array_recurses_on_long_texts():
    rng = np.random.default_rng(5)
    part = rng.integers(0, 4, 3000).astype(np.int16)
    for text in (np.tile(part, 5), rng.integers(0, 2, 20_000), np.tile([0, 1], 9000), np.zeros(5000, np.int64)):
        order = suffix_array(np.asarray(text, np.int16))
        raw = bytes(text.astype(np.uint8))
        assert sorted(order.tolist()) == list(range(len(raw)))
        assert all(raw[a:] < raw[b:] for a, b in zip(order[:-1:37].tolist(), order[1::37].tolist()))

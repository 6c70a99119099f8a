import random
import zlib

import numpy as np

from threadgraph.llm import quality

from .conftest import words


def corpus(n=600):
    rng, rows, labels = random.Random(2), [], []
    for k in range(n):
        good = k % 4 != 0
        text = ". ".join(words(rng, 9, 300) for _ in range(rng.randint(2, 12)))
        if not good:
            text = {0: text.upper().replace(" ", "!! "), 1: text.replace(" ", "### "), 2: (words(rng, 1) + " ") * 60}[k % 3]
        rows.append(text)
        labels.append((k, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_folds(spark, docs_of):
    texts, labels = corpus()
    docs = docs_of(texts)
    out = quality.score(docs, quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in out if r.held_out]
    assert len(held) > 50
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in held]) > 0.97


def test_held_out_labels_are_not_learned(spark, docs_of):
    texts, labels = corpus(200)
    docs = docs_of(texts)
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, t) for d, q, t in labels]
    a, b = (quality.fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert np.allclose(a.weights, b.weights) and np.allclose(a.levels, b.levels)


def test_odd_texts_no_labels_and_filter(spark, docs_of, odd_texts):
    none = spark.createDataFrame([(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(odd_texts)
    model = quality.fit(docs, none)
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}
    kept = quality.keep_good(docs.withColumnRenamed("lang", "score"), model)
    assert kept.columns == ["doc_id", "text", "score", "source", "n_chars"] and kept.count() == len(odd_texts)
    texts, labels = corpus(100)
    model = quality.fit(docs_of(texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = quality.score(docs, model).collect()
    assert len(out) == len(odd_texts) and len({r.score for r in out if r.doc_id in (0, 1, 2)}) == 1
    assert quality.score(docs.where("false"), model).count() == 0


def test_isotonic_is_monotone_and_pools():
    knots, levels = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert levels.tolist() == [0.0, 0.5, 1.0] and np.all(np.diff(knots) > 0)


def plain_statistics(text):
    """The statistics, a character at a time."""
    from math import log1p

    if not text:
        return [0.0] * 17
    raw = text.encode()
    n = len(raw)
    share = lambda ok: sum(map(ok, raw))
    lower, upper, digit = share(lambda b: 97 <= b <= 122), share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57)
    wide, mark = share(lambda b: b >= 128), share(lambda b: 33 <= b < 127 and not chr(b).isalnum())
    words, lines = text.split(), text.split("\n")
    w = max(len(words), 1)
    of = lambda chars: sum(text.count(c) for c in chars) / w
    twice = sum(a == b for a, b in zip(words, words[1:]))
    return [
        log1p(n), log1p(len(words)), min(n / w, 40) / 5, lower / n, upper / max(lower + upper + wide, 1), digit / n, mark / n, wide / n,
        of("!?"), of(".,"), of("|"), of("#$%&*@"), len(set(words)) / w, twice / w, log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), of("<>{}="),
    ]


def test_against_a_plain_ridge_and_isotonic_fit(spark, docs_of):
    import struct

    import xxhash

    texts, labels = corpus(400)
    texts[5], texts[9] = None, ""
    got = {r.doc_id: r.score for r in quality.score(docs_of(texts), quality.fit(docs_of(texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()}
    x = np.array([plain_statistics(t) for t in texts])
    y = np.array([q for _, q, _ in labels], float)
    hashed = lambda k: xxhash.xxh64(struct.pack("<i", 11), seed=xxhash.xxh64(struct.pack("<q", k), seed=42).intdigest()).intdigest()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    learned = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5]
    held = [k for k in learned if signed(hashed(k)) % 3 == 0]
    fitted = [k for k in learned if k not in set(held)]
    # The features: scaled statistics, random directions and phases of the seed.
    rng = np.random.default_rng(11)
    scaled = np.clip((x - x[learned].mean(0)) / (x[learned].std(0) + 1e-3), -6, 6)
    directions = rng.standard_normal((17, quality.FEATURES)) / np.sqrt(17)
    phases = rng.uniform(0, 2 * np.pi, quality.FEATURES)
    z = np.column_stack([np.sqrt(2 / quality.FEATURES) * np.cos(scaled @ directions + phases), np.ones(400)])
    # Ridge as least squares of an augmented system.
    rows = np.vstack([z[fitted], np.sqrt(quality.RIDGE) * np.eye(z.shape[1])])
    weights = np.linalg.lstsq(rows, np.append(y[fitted], np.zeros(z.shape[1])), rcond=None)[0]
    raw = z @ weights
    # Isotonic fit by its min-max formula.
    order = sorted(held, key=lambda k: raw[k])
    s, t = raw[order], y[order]
    n = len(s)
    mean = lambda a, b: t[a : b + 1].mean()
    level = np.array([max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])
    pools = [np.flatnonzero(np.isclose(level, v, atol=1e-12)) for v in sorted(set(np.round(level, 12)))]
    want = np.interp(raw, [s[p].mean() for p in pools], [level[p[0]] for p in pools])
    assert np.allclose([got[k] for k in range(400)], want, atol=1e-5)


def test_repeated_ids_stay_within_the_bound(spark, docs_of, monkeypatch):
    monkeypatch.setattr(quality, "MAX_LABELLED", 50)
    texts, labels = corpus(120)
    docs = docs_of(texts)
    repeated = docs.union(docs).union(docs.selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars"))
    seen = []
    plain = quality.materialise
    monkeypatch.setattr(quality, "materialise", lambda df, name: seen.append(plain(df, name)) or seen[-1])
    model = quality.fit(repeated, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert seen[0].count() == 50
    out = quality.score(repeated, model).collect()
    assert len(out) == 360 and all(0 <= r.score <= 1 for r in out) and sum(r.doc_id is None for r in out) == 120
    assert not any(r.held_out for r in out if r.doc_id is None)

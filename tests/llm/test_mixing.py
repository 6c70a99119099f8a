import random
import re
import struct
from collections import defaultdict

import pytest
import xxhash

from threadgraph.llm import mixing

from .conftest import words


def table_of(spark, n=900):
    rng = random.Random(4)
    rows = [(k, words(rng, rng.randint(0, 40)) + (" | " if k % 7 == 0 else ""), ["en", "en", "en", "de", "fr", None][k % 6], "big" if k % 3 else f"s{k % 5}") for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_marginals_budget_and_sampling(spark):
    out = mixing.mix(table_of(spark), {"lang": {"en": 0.4, "de": 0.4, "fr": 0.1, "xx": 0.3}}, budget=0.3).collect()
    assert len(out) == 900
    total = sum(r.n_tokens for r in out)
    expected = sum(r.n_tokens * r.probability for r in out)
    assert expected == pytest.approx(0.3 * total, rel=1e-6)
    mass = defaultdict(float)
    for r in out:
        mass[r.lang] += r.n_tokens * r.weight
        assert 0 <= r.probability <= 1
    # the given targets add up to over 1: what has none gets nothing; the absent language is spread over the others
    assert mass["de"] / total == pytest.approx(0.4 / 0.9, rel=1e-6) and mass["(null)"] == 0
    sampled = sum(r.n_tokens for r in out if r.sampled)
    assert abs(sampled - expected) < 0.15 * total


def test_rake_against_plain_ipf():
    rng = random.Random(1)
    cells = {(a, b, c): rng.randint(1, 50) for a in "xyz" for b in "pq" for c in "mn"}
    targets = [{"x": 0.2, "y": 0.5, "z": 0.3}, {"p": 0.6, "q": 0.4}, {"m": 0.1, "n": 0.9}]
    share = mixing.rake({k: float(v) for k, v in cells.items()}, targets)
    for axis, target in enumerate(targets):
        for name, wanted in target.items():
            assert sum(v for k, v in share.items() if k[axis] == name) == pytest.approx(wanted, abs=1e-7)
    # raked shares keep the odds ratios of the cells
    odds = lambda t: t["x", "p", "m"] * t["y", "q", "m"] / (t["x", "q", "m"] * t["y", "p", "m"])
    assert odds(share) == pytest.approx(odds(cells))


def test_probabilities_fill_up():
    chance = mixing.probabilities({("a",): 10.0, ("b",): 90.0, ("c",): 0.0}, {("a",): 0.5, ("b",): 0.5}, 0.5)
    assert chance == {("a",): 1.0, ("b",): pytest.approx(40 / 90), ("c",): 1.0}


def test_odd_and_empty(spark, docs_of, odd_texts, monkeypatch):
    docs = docs_of(odd_texts)
    assert mixing.mix(docs).count() == len(odd_texts)
    assert mixing.mix(docs.where("false")).count() == 0
    renamed = docs.withColumn("probability", docs.doc_id).withColumn("weight", docs.lang)
    kept = mixing.sampled(renamed, budget=1.0)
    assert kept.columns == renamed.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in mixing.mix(docs, budget=1.0).collect() if r.sampled)
    assert [tuple(r) for r in kept.select("probability", "weight").collect()] == [tuple(r) for r in kept.select("doc_id", "lang").collect()]
    monkeypatch.setitem(mixing.MAX_NAMES, "source", 1)
    out = mixing.mix(docs, budget=0.5).collect()
    assert len(out) == len(odd_texts) and all(r.probability is not None for r in out)


def test_more_sources_than_the_driver_rakes(spark):
    rng = random.Random(6)
    n = mixing.MAX_NAMES["source"] + 30
    rows = [(k, words(rng, rng.randint(1, 30)) + (" | x" if k // n % 2 else ""), ["en", "de"][k // (2 * n) % 2], f"s{k % n}") for k in range(4 * n)]
    rows += [(4 * n + k, words(rng, 30), ["en", "de"][k % 2], f"s{k % 5}") for k in range(60)] + [(4 * n + 60, "", "fr", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {f"s{n - 1}": 0.2, "s7": 0.1, "s8": 0.0, "absent": 0.1}, "lang": {"en": 0.7, "de": 0.3}}
    out = mixing.mix(docs, targets, budget=0.5).collect()
    assert len(out) == len(rows)

    cells = defaultdict(float)
    for r in out:
        cells[r.source, r.lang, r.topic] += r.n_tokens
    total = sum(cells.values())
    wanted = [defaultdict(float), targets["lang"], defaultdict(float)]
    for c, tokens in cells.items():
        wanted[0][c[0]] += tokens
        wanted[2][c[2]] += tokens
    wanted = [{k: v**0.5 for k, v in w.items() if v} if w is not targets["lang"] else w for w in wanted]
    others = {k: v for k, v in wanted[0].items() if k not in targets["source"]}
    wanted[0] = targets["source"] | {k: 0.6 * v / sum(others.values()) for k, v in others.items()}
    share = mixing.rake(dict(cells), wanted)
    chance = mixing.probabilities(dict(cells), share, 0.5)
    assert any(p == 1 for c, p in chance.items() if cells[c]) and 0 in chance.values()
    for r in out:
        c = r.source, r.lang, r.topic
        assert r.probability == pytest.approx(chance[c], rel=1e-6, abs=1e-9)
        assert r.weight == pytest.approx(share[c] * total / cells[c] if cells[c] else 1.0, rel=1e-6, abs=1e-9)
    mass = defaultdict(float)
    for r in out:
        mass[r.source] += r.n_tokens * r.weight / total
    assert mass[f"s{n - 1}"] == pytest.approx(0.2 / 0.9, rel=1e-6) and mass["s8"] == 0
    kept = mixing.sampled(docs, targets, budget=0.5)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out if r.sampled)


def plain_topic(text):
    if "@" in text:
        return "contact"
    if re.search("licen[sc]e|copyright", text, re.IGNORECASE):
        return "licence"
    if " | " in text:
        return "table"
    return "shouting" if "!!" in text else "note" if len(text) < 600 else "prose"


def plain_mix(rows, targets, temperature, budget, seed):
    """Plain raking and sampling: weights and probabilities by document."""
    cell_of = {}
    tokens = {}
    for k, (_, text, lang, source) in enumerate(rows):
        cell_of[k] = ("(null)" if source is None else source, "(null)" if lang is None else lang, plain_topic(text or ""))
        tokens[k] = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    cells = sorted(set(cell_of.values()))
    n = {c: sum(tokens[k] for k in tokens if cell_of[k] == c) for c in cells}
    total = sum(n.values())
    table = {c: n[c] / total for c in cells}
    wanted = []
    for axis, name in enumerate(mixing.AXES):
        sums = {}
        for c in cells:
            sums[c[axis]] = sums.get(c[axis], 0) + n[c]
        raw = {v: s**temperature for v, s in sums.items() if s} if name not in targets else {v: t for v, t in targets[name].items() if sums.get(v)}
        wanted.append({v: t / sum(raw.values()) for v, t in raw.items()})
    for _ in range(3000):
        for axis in range(3):
            for v in {c[axis] for c in cells}:
                held = sum(table[c] for c in cells if c[axis] == v)
                for c in cells:
                    if c[axis] == v and held:
                        table[c] *= wanted[axis].get(v, 0) / held
    # The scale at which capped probabilities take the budget, by bisection.
    low, high = 0.0, 1e6
    for _ in range(200):
        scale = (low + high) / 2
        taken = sum(min(n[c], scale * table[c] * total) for c in cells)
        low, high = (scale, high) if taken < budget * total else (low, scale)
    out = []
    for k, row in enumerate(rows):
        c = cell_of[k]
        p = min(1.0, low * table[c] * total / n[c]) if n[c] else 1.0
        h = 42
        if row[0] is not None:
            h = xxhash.xxh64(struct.pack("<q", row[0]), seed=h).intdigest()
        h = xxhash.xxh64(struct.pack("<i", seed), seed=h).intdigest()
        out.append((row[0], tokens[k], *c, table[c] * total / n[c] if n[c] else 1.0, p, (h >> 11) / 2**53 < p))
    return out


def test_against_plain_raking_and_sampling(spark):
    rng = random.Random(21)
    extras = ["", " write a@b.cd", " | cell", " Copyright 2001", " wow!!", " word" * 200]
    rows = [(k, words(rng, rng.randint(0, 30)) + rng.choice(extras), rng.choice(["en", "en", "de", "fr", None, "(null)"]), rng.choice(["big"] * 6 + ["s1", "s2", "(other)", None])) for k in range(700)]
    rows += [(None, "a b c", "en", "big"), (3, None, None, None), (3, None, None, None), (701, "", "it", "s9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"lang": {"en": 0.4, "de": 0.3, "fr": 0.2, "(null)": 0.1, "xx": 0.5}}
    want = plain_mix(rows, targets, 0.5, 0.4, 17)
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:5]))
    got = sorted((tuple(r) for r in mixing.mix(docs, targets, budget=0.4).select("doc_id", "n_tokens", "source", "lang", "topic", "weight", "probability", "sampled").collect()), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-6, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-6, abs=1e-9) and a[7] == b[7]
    assert 100 < sum(r[7] for r in got) < 600


def test_targets_that_cannot_be_met_warn():
    cells = {("a", "p", "m"): 5.0, ("b", "q", "m"): 5.0}
    with pytest.warns(UserWarning, match="did not settle"):
        share = mixing.rake(cells, [{"a": 0.2, "b": 0.8}, {"p": 0.7, "q": 0.3}, {"m": 1.0}])
    assert sum(share.values()) == pytest.approx(1)


def test_columns_named_like_the_operators_own(spark):
    rows = [(k, words(random.Random(k), 20), "en", f"s{k % 3}", "q", "r", 7, True) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _source string, __mix_lang string, _of_probability int, probability boolean")
    kept = mixing.sampled(docs, budget=0.5)
    assert kept.columns == docs.columns
    out = {tuple(r) for r in kept.collect()}
    assert out and out < set(rows)
    assert sorted(r[0] for r in out) == sorted(r.doc_id for r in mixing.mix(docs, budget=0.5).collect() if r.sampled)

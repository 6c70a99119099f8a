import random
import re
import zlib
from collections import Counter

import pytest

from threadgraph.llm import spelling

UPPER = {c: c + 32 for c in range(65, 91)}
NAMES = ["word", "form", "root", "n", "n_near", "form_n"]


def dictionary(rows, drop_every, least_letters, least_count):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % drop_every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least_letters:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, drop_every=199, least_letters=6, least_count=5, ratio=5):
    words = dictionary(rows, drop_every, least_letters, least_count)
    form, out = {}, {}
    for w, n in words.items():
        beside = [v for v in words if near(w, v)]
        best = min(beside, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = (n, len(beside), words[form[w]] if form[w] else None)
    def root(w):
        return root(form[w]) if form[w] else w
    return {(w, form[w], root(w), *out[w]) for w in words}


def got(docs, **options):
    return [tuple(r) for r in spelling.variants(docs, **options).select(*NAMES).collect()]


@pytest.mark.parametrize("block", [2, 64])
def test_equals_brute_force(spark, block):
    """Words with few letters of their own, so that blocks are crowded; null and shared ids, empty texts, ties, clashing columns."""
    rng = random.Random(block)
    pool = ["".join(rng.choice("abé") for _ in range(rng.choice([5, 6, 6, 6, 7]))) for _ in range(140)] + ["wonderful", "wonderfull", "wondrful", "Wonderful", "x" * 300, "x" * 299]
    weights = [rng.choice([1, 1, 4, 30]) for _ in pool]
    rows = [(rng.choice([None, 7, k]), " ".join(rng.choices(pool, weights, k=80)) + "! 12×÷a") for k in range(60)] + [(1, None), (2, ""), (3, "\n"), (None, None)]
    rows += rows[:10]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, word string, n long").repartition(3)
    found = got(docs, block=block, drop_every=7)
    assert len(found) == len(set(found)) and set(found) == brute(rows, drop_every=7)
    assert any(r[1] for r in found) and len({r[4] for r in found}) > 3


def test_one_block_with_most_words(spark):
    """A prefix and a suffix that all words share: blocks are subdivided down to one letter, and every pair is found once."""
    rng = random.Random(1)
    words = sorted({"interna" + "".join(rng.choice("abc") for _ in range(rng.choice([4, 5]))) + "tionally" for _ in range(400)})
    own = spark.createDataFrame([(w, 5 + k) for k, w in enumerate(words)], "word string, n long")
    rows = spelling.dictionaries(own, block=8)
    sizes = {(r["block"], r["m"] - r["p"] - r["q"]): r["size"] for r in rows.groupBy("block", "m", "p", "q").count().withColumnRenamed("count", "size").collect()}
    assert all(size <= 8 or gap == 1 for (_, gap), size in sizes.items()) and max(sizes.values()) <= 3 + 9
    found = [(r.word, r.other) for r in spelling.near_pairs(own, block=8).collect()]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a in words for b in words if near(a, b)}


def test_chain_and_empty(spark):
    text = " ".join(["aaaaaa"] * 5 + ["aaaaab"] * 25 + ["aaaabb"] * 125 + ["aaabbb"] * 625 + ["qqqqqq"] * 4)
    docs = spark.createDataFrame([(4, text)], "doc_id long, text string")
    found = {r[0]: r for r in got(docs, drop_every=1 << 40)}
    assert found["aaaaaa"] == ("aaaaaa", "aaaaab", "aaabbb", 5, 1, 25) and found["aaabbb"] == ("aaabbb", None, "aaabbb", 625, 1, None)
    assert "qqqqqq" not in found and got(docs.limit(0)) == []

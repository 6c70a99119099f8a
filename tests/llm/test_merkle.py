import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from threadgraph.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    out = []
    for v in (doc_id, source, lang, None if n_chars is None else n_chars + more, text):
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return h(*out)


def tower(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + fanout]) for k in range(0, len(levels[-1]), fanout)])
    return levels


def path(levels, at, fanout):
    out = []
    for nodes in levels[:-1]:
        first = at - at % fanout
        run = nodes[first : first + fanout]
        out.append((run[: at - first], run[at - first + 1 :]))
        at //= fanout
    return out


def brute(rows, fanout):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    towers, ordered = {}, {}
    for lang in langs:
        own = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        ordered[lang], towers[lang] = own, tower([leaf(r) for r in own], fanout)
    top = tower([towers[x][-1][0] for x in langs], fanout)
    out = []
    for k, lang in enumerate(langs):
        for at, r in enumerate(ordered[lang]):
            proof = path(towers[lang], at, fanout) + path(top, k, fanout)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            acc = leaf(r, int(changed))
            for left, right in proof:
                acc = h(*left, acc, *right)
            out.append((r[0], leaf(r), towers[lang][-1][0], top[-1][0], h(*[d for left, right in proof for d in (*left, *right)]), acc, acc == top[-1][0]))
    return sorted(out, key=repr)


def got(docs, fanout):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in merkle.manifest(docs, fanout).select(*names).collect()), key=repr)


def rows_of(rng, n, langs):
    return [(rng.choice([None, k, k, k, 7]), rng.choice([None, "", "s"]), rng.choice(langs), rng.choice([None, 3, 10]), rng.choice([None, "", "é🙂", "x" * 3000, "a:b-"])) for k in range(n)]


@pytest.mark.parametrize(("n", "fanout", "levels"), [(170, 2, 2), (90, 3, 1), (40, 2, 6)])
def test_equals_brute_force(spark, monkeypatch, n, fanout, levels):
    """Nulls, ties, repeated rows, clashing columns, pages of several levels, and one language with most rows."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rng = random.Random(n)
    rows = rows_of(rng, n, [None, "", "de", "de", "de", "éa", "zz"]) + [(5, "s", "one", 1, "lone")]
    rows += rows[:20]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA).repartition(5)
    assert got(docs, fanout) == brute(rows, fanout)


def test_small_and_empty(spark):
    for rows in ([], [(0, "s", "en", 1, "a")], [(0, "s", "en", 1, "a"), (1, "s", None, 1, "a")], [(k, "s", "en", 1, "a") for k in range(3)]):
        docs = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)
        assert got(docs, 2) == brute(rows, 2)


def test_tampering_is_found_and_only_there(spark):
    rows = [(k, "s", "en", k, f"t{k}") for k in range(200)]
    out = {r[0]: r[6] for r in got(spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA), 2)}
    assert out == {k: zlib.crc32(str(k).encode()) % 7 != 0 for k in range(200)}

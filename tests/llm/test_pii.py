import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from threadgraph.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@pytest.fixture(scope="module")
def texts(odd_texts):
    rng = random.Random(9)
    own = ["a@b.c_d@e.f x..y@z-.q.r. @@ a@b", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.0004 1.2.3 0.0.0.0 10.0.0.00 256.0.0.1 0255.255.1.000", "4111 1111 1111 1111, 4111-1111-1111-1112 0000000000000", "+1 (555) 010-9999. +12 +123456789012345678 ++49 30 1234567-", "🙂é +49 (30) 123-4567 🙂 mail: x@y.de", "5500005555555559" * 3]
    for _ in range(250):
        own.append("".join(rng.choice(["1", "23", "4111111111111111", ".", "@", "a", "é", " ", "-", "+", "(", ")", "_", "255", "\n", "b.c"]) for _ in range(rng.randint(1, 60))))
    return [*odd_texts, *own, "9" * 3000 + "@" + ".a" * 3000, "1 " * 3000]


def test_base_spans(docs_of, texts):
    out = {r.doc_id: r for r in pii.find(docs_of(texts)).collect()}
    assert len(out) == len(texts)
    for k, text in enumerate(texts):
        want = base(text or "")
        assert [(pii.KINDS[c.kind], c.s, c.e) for c in out[k].base] == want, text
        assert set(want) <= {(pii.KINDS[c.kind], c.s, c.e) for c in out[k].spans}
        assert [(c.kind, c.s) for c in out[k].spans] == sorted((c.kind, c.s) for c in out[k].spans)


def test_query_columns(spark, tmp_path, docs_of, texts):
    docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
    for r in pii.query(spark, str(tmp_path)).collect():
        want = base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in pii.KINDS[:4]]
        assert r.n_spans == len([x for x in r.spans.split(",") if x]) >= len(want)


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark)


def test_model_adds_other_forms_and_leaves_clean_texts(docs_of, model):
    seen = ["write to a.b@c.org now", "card 4111 1111 1111 1112 no", "call +1 (555) 010-9999 now", "call +1 2 now", "999.1.1.1"]
    extra = ["mail jo [at] site [dot] org please", "host 10[.]0[.]0[.]1", "card 4111.1111.1111.1111", "phone (555) 010-9999 today", 'token = "04dbebab91ab85687d33eeaaf9ac699e11883344"']
    clean = ["just 5 words and 12 numbers", "section 1.2.3 of 2024", "at 10:30 (at) noon", "order 4111.1111.1111.1112", "part 555-010-9999 in stock", "token = required", "number 9807915762804491 there", "look at it. dot the i"]
    docs = docs_of([*seen, *extra, *clean])
    out = {r.doc_id: [pii.KINDS[c.kind] for c in r.spans] for r in pii.find(docs, model).collect()}
    assert [out[k] for k in range(5)] == [["email"], [], ["phone"], [], []]
    assert [out[len(seen) + k] for k in range(5)] == [["email"], ["ip"], ["card"], ["phone"], ["secret"]]
    assert [out[len(seen) + 5 + k] for k in range(len(clean))] == [[]] * len(clean)
    text = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert text[0] == "write to [email] now" and text[2] == "call [phone] now" and text[len(seen)] == "mail [email] please"


@pytest.fixture(scope="module")
def measured(spark, model):
    """Candidates in a maker's lines that neither trees nor thresholds have seen."""
    held = pii.labelled_candidates(pii.plants(spark, 6000, seed=99, makers=pii.MEASURE))
    at_even = pii.Model(model.start, model.trees, (0.0,) * len(pii.KINDS))
    row = F.struct(*pii.FEATURES)
    scored = held.withColumn("base_span", F.col("base") & (F.col("valid") == 1)).withColumn("accepted", model.accepts(row)).withColumn("at_even", at_even.accepts(row))
    return scored.select("doc_id", "_kind", "_personal", "kind", "valid", "base", "base_span", "accepted", "at_even", "positive").collect()


def test_recall_and_precision_on_a_maker_not_seen(model, measured):
    rest = [r for r in measured if not r.base_span]
    for k, kind in enumerate(pii.KINDS):
        # A planted item is found if any of its candidates is; of the forms that no base rule reads, the model has to find them.
        items = {r.doc_id for r in measured if r._kind == k and r._personal}
        found = {r.doc_id for r in measured if r.positive and (r.base_span or r.accepted) and r.kind == k}
        hard = items - {r.doc_id for r in measured if r.positive and r.base_span and r.kind == k}
        right = [bool(r.positive) for r in rest if r.accepted and r.kind == k]
        print(kind, "threshold", model.thresholds[k], "recall", len(found) / len(items), "without base forms", len(found & hard) / len(hard), "precision", sum(right) / len(right))
        assert len(found) >= 0.85 * len(items) and sum(right) >= pii.PRECISION * len(right)
    # What decides is not the check: candidates that pass theirs are turned down, in numbers.
    assert sum(bool(r.valid) and not r.accepted for r in rest) > 100
    assert model.trees and len({t.feature for t in model.trees}) > 1


def test_calibration_decides(model, measured):
    assert all(t != 0.0 for t in model.thresholds)
    assert sum(r.accepted != r.at_even for r in measured if not r.base_span) > 0
    counts = [{**dict.fromkeys(pii.FEATURES, 0), "digits": d, "n": 100, "positive": p} for d, p in ((1, 99), (2, 80), (3, 55), (4, 3))]
    steps = [pii.Tree("digits", cut, 1.0, 0.0) for cut in (1, 2, 3)]
    assert pii.calibrate(counts, 0.0, steps)[0] == 2.5  # 99 of 100; with the next score's, 179 of 200 are too few
    assert pii.calibrate(counts[3:], 0.0, steps)[0] == float("inf")


def test_every_plant_is_proposed_and_as_it_says(spark):
    makers = tuple(range(pii.MAKERS))
    rows = pii.plants(spark, 4000, seed=5, makers=makers).collect()
    found = {(r.doc_id, r.kind) for r in pii.labelled_candidates(pii.plants(spark, 4000, seed=5, makers=makers)).collect() if r.positive}
    for r in rows:
        assert 0 < r.s < r.e <= len(r.text)
        assert not r.personal or (r.doc_id, r.kind) in found, r.text
    assert {(r.maker, r.kind, r.personal) for r in rows} == {(m, k, p) for m in makers for k in range(5) for p in (0, 1)}


def test_rows_without_or_with_shared_ids_keep_their_own_spans(spark, model):
    rows = [(None, "write a@b.cd x", 1), (None, "nothing", 2), (7, "host 1.2.3.4", 3), (7, "call +1 (555) 010-9999 or a@b.cd", 4), (7, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found int").withColumn("_text", F.lit(1)).withColumn("spans", F.lit("x"))
    assert sorted(r.text for r in pii.redact(docs, model).collect()) == sorted(["write [email] x", "nothing", "host [ip]", "call [phone] or [email]", ""])
    assert sorted(len(r.spans) for r in pii.find(docs, model).collect()) == [0, 0, 1, 1, 2]


def test_many_matches_and_a_long_text(docs_of, model):
    texts = ["a@b.cd " * 3001, "1.2.3.4 " * 101, ("x" * 999 + " ") * 2000 + "a@b.cd"]
    out = {r.doc_id: r for r in pii.find(docs_of(texts), model).collect()}
    for k, text in enumerate(texts):
        assert [(pii.KINDS[c.kind], c.s, c.e) for c in out[k].base] == base(text)


def test_trees_column_equals_value(spark):
    rest = {"before": 0, "cue": 0, "marks": 0, "length": 0, "kind": 0}
    counts = [{**rest, "digits": d, "groups": g, "valid": v, "after": a, "n": 10, "positive": 10 * (v and d > 2)} for d in range(6) for g in range(4) for v in range(2) for a in range(2)]
    start, trees = pii.boost(counts)
    df = spark.createDataFrame([{k: r[k] for k in pii.FEATURES} for r in counts]).select(F.struct(*pii.FEATURES).alias("c"))
    for r in df.select("c", sum((t.column(F.col("c")) for t in trees), F.lit(start)).alias("s")).collect():
        want = start + sum(t.value(r.c.asDict()) for t in trees)
        assert r.s == pytest.approx(want) and (want > 0) == bool(r.c.valid and r.c.digits > 2)


def test_empty(docs_of, model):
    assert pii.find(docs_of(["x"]).where("false"), model).count() == 0
    assert [r.spans for r in pii.find(docs_of([None, "", "nothing"]), model).collect()] == [[], [], []]

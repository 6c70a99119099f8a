import hashlib
import random

import pytest

import corpus_pipeline as cp
from threadgraph.llm import byte_bpe, mixing

from .conftest import words
from .test_exact_dedup import brute as exact
from .test_ngram_join import brute as near
from .test_ngram_join import edited

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    texts, labels = [], []
    base = ". ".join(words(rng, 12, 400) for _ in range(12))
    for k in range(400):
        text = ". ".join(words(rng, 9, 400) for _ in range(rng.randint(3, 12)))
        good = k % 5 != 0
        if not good:
            text = text.upper().replace(" ", "!! ") if k % 2 else text.replace(" ", "### ")
        elif k % 11 == 1:
            text = edited(rng, base, 0.004)
        elif k % 13 == 2:
            text = base.upper()
        texts.append(text)
        labels.append((k, int(good), 0))
    texts[7] = None
    where = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(k, t, "en", f"s{k % 4}", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, texts, labels


def test_stages_and_run(spark, corpus):
    where, texts, labels = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns = docs.columns
    stages = dict(cp.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]

    def step(name, docs):
        out = stages[name](spark, docs, where)
        path = f"{where}/{name}.parquet"
        out.write.parquet(path)
        return spark.read.parquet(path)

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    good = step("quality", docs)
    kept = set(ids(good))
    wrong = [k for k, q, _ in labels if (k in kept) != bool(q) and k != 7]
    assert good.columns == columns and len(wrong) <= 4
    one = step("exact_dedup", good)
    assert one.columns == columns
    assert ids(one) == sorted(d for d, _, _, stays, _ in exact([(r.doc_id, r.text) for r in good.collect()]) if stays)
    far = step("near_dedup", one)
    rows = sorted(((r.doc_id, r.text) for r in one.collect()))
    groups = near([t for _, t in rows])
    assert far.columns == columns and ids(far) == [rows[k][0] for k, (_, c) in groups.items() if c == k]
    assert len(ids(far)) < len(rows) < len(kept)
    mixed = step("mixing", far)
    assert mixed.columns == columns and ids(mixed) == sorted(r.doc_id for r in mixing.mix(far).collect() if r.sampled)
    last = {r.doc_id: r for r in step("byte_bpe", mixed).collect()}
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.parse_ranks(file.read()), special_tokens={})
    assert sorted(last) == ids(mixed)
    for k, r in last.items():
        assert list(r.ids) == own.encode_ordinary(texts[k] or "") and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256((texts[k] or "").encode()).hexdigest()
    assert sorted(r.doc_id for r in cp.run(spark, where).collect()) == sorted(last)


def test_stages_on_rows_that_share_ids(spark, corpus):
    """No text is lost by the stages that remove copies, whatever ids rows have."""
    rng = random.Random(31)
    a, b, c = (words(rng, 70, 900) for _ in range(3))
    rows = [(5, a), (5, b), (5, c), (9, b.upper()), (None, a), (None, c + " x"), (None, None), (11, a + " y")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(cp.STAGES)
    one = stages["exact_dedup"](spark, docs, corpus[0])
    key = lambda r: (r.doc_id or 0, (r.text or "").lower())
    assert one.columns == docs.columns
    assert sorted(map(key, one.collect())) == sorted([(5, a), (9, b), (5, c), (0, c + " x"), (0, ""), (11, a + " y")])
    far = stages["near_dedup"](spark, one, corpus[0])
    assert far.columns == docs.columns
    assert sorted(map(key, far.collect())) == sorted([(5, a), (9, b), (5, c), (0, "")])

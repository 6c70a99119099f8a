import itertools
import random

import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from threadgraph.llm import token_counts as tc  # noqa: E402

VOCAB = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    with open(VOCAB, "rb") as file:
        return tc.parse_model(file.read())


@pytest.fixture(scope="module")
def reference(pieces):
    own = tokenizers.Tokenizer(tokenizers.models.Unigram([(p, s) for p, s, _ in pieces], unk_id=0, byte_fallback=True))
    own.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement=tc.MARK, prepend_scheme="always", split=True)
    return own


def test_counts_equal_the_tokenizer(docs_of, odd_texts, reference):
    texts = [*odd_texts, " a", "  a  b ", "▁x▁", "naïve café 中文字 🙂 x", "กข tab\tnew\nline"]
    got = {r.doc_id: r.n_tokens for r in tc.token_counts(docs_of(texts), VOCAB).collect()}
    assert got == {k: len(reference.encode(t, add_special_tokens=False).ids) if t else 0 for k, t in enumerate(texts)}


def test_score_and_tie_rule_by_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        vocab = {"▁": -1.0, "a": -2.0, "b": -2.0}
        for _ in range(6):
            vocab["".join(rng.choice("ab▁") for _ in range(rng.randint(2, 3)))] = -float(rng.randint(1, 5))
        word = "▁" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))
        unknown = min(vocab.values()) - 10

        def ways(end, word=word, vocab=vocab, unknown=unknown):
            """Best (score, count) up to end; starts from the left, strictly better only."""
            if end == 0:
                return 0.0, 0
            found = None
            for start in range(end):
                piece = word[start:end]
                if piece in vocab or (len(piece) == 1 and piece not in vocab):
                    score, n = ways(start)
                    score, n = (score + vocab[piece], n + 1) if piece in vocab else (score + unknown, n + len(piece.encode()))
                    if found is None or score > found[0]:
                        found = score, n
            return found

        score, n = ways(len(word))
        assert tc.Counter([(p, s, 1) for p, s in vocab.items()]).word(word) == (n, score)
        cuts = [[0, *c, len(word)] for k in range(len(word)) for c in itertools.combinations(range(1, len(word)), k)]
        assert score == max(sum(vocab.get(word[a:b], unknown if b - a == 1 else float("-inf")) for a, b in itertools.pairwise(c)) for c in cuts)


def test_empty_table_and_nulls(docs_of):
    docs = docs_of(["x", None])
    assert tc.token_counts(docs.where("false"), VOCAB).count() == 0
    assert {tuple(r) for r in tc.token_counts(docs.where("text is null"), VOCAB).collect()} == {(1, 0, 0.0)}


def test_null_and_shared_ids_and_clashing_columns(spark, reference):
    rows = [(None, "a b", 1, "i"), (None, None, 2, "j"), (3, "a b", 3, "k"), (3, "word", 4, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, pieces string")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in tc.token_counts(docs, VOCAB).collect())
    alone = {r.doc_id: r.n_tokens for r in tc.token_counts(spark.createDataFrame([(1, "a b"), (2, ""), (4, "word")], "doc_id long, text string"), VOCAB).collect()}
    assert got == sorted([(0, alone[1]), (0, alone[2]), (3, alone[1]), (3, alone[4])])

import base64
import hashlib
import random
import struct

import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from threadgraph.llm import byte_bpe  # noqa: E402

VOCAB = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(VOCAB, "rb") as file:
        ranks = byte_bpe.parse_ranks(file.read())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_digests_equal_tiktoken(docs_of, odd_texts, reference):
    got = {r.doc_id: r for r in byte_bpe.digests(docs_of(odd_texts), VOCAB, P.PATTERN).collect()}
    assert len(got) == len(odd_texts)
    for k, text in enumerate(odd_texts):
        ids = reference.encode_ordinary(text or "")
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_encode_then_decode_is_the_text(docs_of, odd_texts):
    ids = byte_bpe.encode(docs_of(odd_texts), VOCAB, P.PATTERN)
    got = {r.doc_id: bytes(r.data).decode() for r in byte_bpe.decode(ids, VOCAB).collect()}
    assert got == {k: t or "" for k, t in enumerate(odd_texts)}


def test_leftmost_pair_and_long_words(reference):
    with open(VOCAB, "rb") as file:
        own = byte_bpe.Codec(file.read(), P.PATTERN)
    for text in ("a" * 997, "ab" * 300 + "c", "一" * 200, "".join(map(chr, range(32, 1500))), "=" * 77):
        ids = reference.encode_ordinary(text)
        assert own.encode([text])[0] == struct.pack(f"<{len(ids)}I", *ids)


def test_spaces_and_classes_of_all_code_points(reference):
    with open(VOCAB, "rb") as file:
        own = byte_bpe.Codec(file.read(), P.PATTERN)
    points = [c for c in range(0, 0x3100) if not 0xD800 <= c < 0xE000]
    text = "".join(f"a{chr(c)} b{chr(c)}1" for c in points)
    ids = reference.encode_ordinary(text)
    assert own.encode([text])[0] == struct.pack(f"<{len(ids)}I", *ids)


def test_empty_table(docs_of):
    assert byte_bpe.digests(docs_of(["x"]).where("false"), VOCAB, P.PATTERN).count() == 0


def long_pieces(size):
    rng = random.Random(size)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    return {
        "letters": pick("abcdefghijklmnopqrstuvwxyz", size),
        "words": pick(["the", "ing", "tion", "er", "a", "and", "pre", "con"], size // 3),
        "marks": pick('!"#$%&()*+,-./:;<=>?@[]^_{|}~', size),
        "run": "=" * size,
        "cycle": "abcab" * (size // 5),
        "cjk": pick([chr(c) for c in range(0x4E00, 0x9FFF)], size // 3),
        "common cjk": pick("的一是不了人我在有他这为之大来以个中上们", size // 3),
    }


def test_long_pieces_equal_tiktoken(reference):
    with open(VOCAB, "rb") as file:
        own = byte_bpe.Codec(file.read(), P.PATTERN)
    for size in (510, 514, 1500, 40_000, 200_000):
        for text in long_pieces(size).values():
            ids = reference.encode_ordinary(text)
            assert own.encode([text])[0] == struct.pack(f"<{len(ids)}I", *ids)


def test_a_piece_of_two_megabytes(docs_of, reference):
    texts = [long_pieces(2_000_000)["run"], "x" * 1_000_000, long_pieces(600_000)["common cjk"], "short"]
    got = {r.doc_id: r for r in byte_bpe.digests(docs_of(texts), VOCAB, P.PATTERN).collect()}
    for k, text in enumerate(texts):
        assert got[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    # The library itself is quadratic in a piece's length, so the longest are compared by their round trip.
    for k in (2, 3):
        ids = reference.encode_ordinary(texts[k])
        assert got[k].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_tokens_that_no_contraction_reaches():
    """A part that is a token as a whole, but isn't reached by contractions, isn't one inside a longer word."""
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"ab", b"abc" * 200]
    data = b"\n".join(base64.b64encode(t) + b" " + str(k).encode() for k, t in enumerate(tokens))
    own = byte_bpe.Codec(data, r"\w+")
    plain = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks=byte_bpe.parse_ranks(data), special_tokens={})
    for text in ("abc" * 200, "abc" * 400, "x" + "abc" * 400, "abc" * 171):
        ids = plain.encode_ordinary(text)
        assert own.encode([text])[0] == struct.pack(f"<{len(ids)}I", *ids)


def test_null_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "a b", 1, "i"), (None, None, 2, "j"), (3, "a b", 3, "k")], "doc_id long, text string, n_tokens int, ids string")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in byte_bpe.digests(docs, VOCAB, P.PATTERN).collect())
    assert got == [(0, 0), (0, 2), (3, 2)]
    assert sorted((r.doc_id or 0, len(r.ids)) for r in byte_bpe.encode(docs, VOCAB, P.PATTERN).collect()) == got

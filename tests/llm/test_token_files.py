import glob
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from threadgraph.llm import token_files
from threadgraph.storage import shared_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def encode():
    own = token_files.Encoder(open(TOKENIZER, encoding="utf-8").read())
    assert own.fast
    return lambda text: np.frombuffer(own.text(text), "<u2").tolist()


def test_every_character_of_the_fast_way(library, encode):
    for c in [*range(0x300), 0x3A3, 0x301, 0x1E9E, 0x2028, 0x3000]:
        for text in (chr(c), f"a{chr(c)}b", f"A{chr(c)} {chr(c)}7's", f"!{chr(c)}!", f"{chr(c)}{chr(c)}"):
            assert encode(text) == library.encode(text, add_special_tokens=False).ids, (hex(c), text)


def test_random_texts(library, encode, odd_texts):
    rng = random.Random(3)
    parts = ["don't", "WE'LL", "x's", "''s", "1234", "é", "é", " ́", "<|endoftext|>", "<|STARTOFTEXT|>", "<|", "a<|endoftext|>b", "İ", "Straße", "日本", "\x1c", "\x85", "\n", "  ", "...", "-", "ΑΣ", "🙂", "½", "x" * 90]
    texts = ["".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randrange(40))) for _ in range(300)] + [t or "" for t in odd_texts]
    assert [encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_memo_turns_over(library, monkeypatch):
    monkeypatch.setattr(token_files, "MEMO_CHUNKS", 5)
    own = token_files.Encoder(open(TOKENIZER, encoding="utf-8").read())
    texts = [f"word{k % 9} other{k % 4}, {'z' * 80}" for k in range(50)]
    assert [np.frombuffer(own.text(t), "<u2").tolist() for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("bits", [1, 7, 8, 11, 16, 17, 24, 31])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint32)
    packed = token_files.pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8) and (token_files.unpack(packed, bits, 1001) == ids).all()


def test_random_access_reads_only_its_blocks():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 49_408, n).astype(np.uint32) for n in (0, 5, 9000, 1, 30_000, 4096)]
    writer = token_files.Writer(3, 17, 4)
    rows = [r for k, t in enumerate(texts) for r in writer.add(None if k == 1 else k, t.tobytes())] + writer.close()

    class Counting(io.BytesIO):
        bytes_read = 0

        def read(self, n=-1):
            out = super().read(n)
            self.bytes_read += len(out)
            return out

    source = Counting(b"".join(r + b"\n" for r in rows))
    own = token_files.TokenFile(source)
    assert own.nulls.tolist() == [k == 1 for k in range(6)]
    for k, t in enumerate(texts):
        assert own.document(k).tolist() == t.tolist()
    source.bytes_read = 0
    assert own.ids(20_000, 20_010).tolist() == np.concatenate(texts)[20_000:20_010].tolist()
    assert source.bytes_read == 4096 * 17 // 8 + 1
    broken = bytearray(source.getvalue())
    broken[100] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_files.TokenFile(io.BytesIO(bytes(broken))).ids(0, 10)


def test_files_equal_library(spark, library, odd_texts):
    """Several files and blocks, null and shared ids, clashing columns."""
    texts = odd_texts * 3 + ["plain words " * 2000]
    rows = [(None if k % 7 == 0 else k // 2, t, "x", k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place string, number int").repartition(3)
    path = shared_path(spark, "token-files")
    files = token_files.write_tokens(docs, path, TOKENIZER, file_bytes=20_000)
    found = sorted((r.asDict() for r in token_files.read_documents(spark, path, files).collect()), key=lambda r: r["start"])
    assert len({r["file"] for r in found}) > 3 and len(found) == len(rows)
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    want = []
    for doc_id, text, *_ in rows:
        own = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_tokens"], r["ids_crc32"])) for r in found)
    names = glob.glob(path.removeprefix("file://") + "/*.txt")
    first = min((token_files.TokenFile(open(n, "rb")) for n in names if open(n, "rb").read(1)), key=lambda f: f.number)
    assert first.nulls[0] and first.document(0)[-1] == 2


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = shared_path(spark, "token-files")
    assert token_files.read_documents(spark, path, token_files.write_tokens(docs, path, TOKENIZER)).count() == 0
    one = docs.union(spark.createDataFrame([(5, None)], docs.schema))
    path = shared_path(spark, "token-files")
    assert [tuple(r)[:3] for r in token_files.read_documents(spark, path, token_files.write_tokens(one, path, TOKENIZER)).collect()] == [(5, 0, 1)]

"""Byte-level BPE encoding and decoding with DuckDB recursive queries in each partition.

Each Arrow batch is cut into slices of bounded size. The pieces that the split pattern finds are collected once per slice;
those not seen before by the worker go to DuckDB. One recursive step lays each word's tokens out as position rows, joins
neighbours with the merge table and contracts, in every word, the leftmost pair of least rank; a word leaves the recursion
when no pair of it is in the table. A recursion runs at most ``ROUNDS`` steps before its state is written down and a new one
starts from there, so what is kept for long words stays bounded. Decoding joins the ids of each document with the
vocabulary and concatenates their bytes by an ordered aggregation.

A piece of more than ``LONG`` bytes is put together from parts of that size, so that no recursion sees a long word. Tokens side by
side are the encoding of their bytes exactly if every two neighbours are the encoding of theirs: contractions within the two
happen in the same order as in the whole, so the first one to cross their border in the whole would do so in the pair. Where two
parts meet in a pair that isn't, the tokens around the border are encoded anew, more of them to either side until both ends are
such pairs again.

The task has no shuffle, no state beyond a bounded memo of words, and can be rerun on any executor.

Defined results: a null text counts as empty; an empty text has no tokens, and both digests are those of no bytes; texts of
any length are encoded whole; repeated rows give repeated results; a null doc_id stays null; an empty table gives an empty
result; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty
from .hashing import give_back

ROUNDS = 24  # steps of one recursion
SLICE_CHARS = 1_500_000  # text that a slice holds, but for a longer document, which is a slice of its own
FRESH_BYTES = 500_000  # bytes of new words that one seed holds
MEMO_WORDS = 250_000  # words in each of the two generations that a worker remembers
LONG = 512  # bytes of a word from which on it is put together from parts
BORDER = 6  # tokens to either side of a border that are encoded anew at first
DECODE_TOKENS = 400_000  # rows of one decoding query

CONTRACT = f"""
WITH RECURSIVE step(w, toks, n) AS (
  SELECT w, toks, 0 FROM seed
  UNION ALL
  (WITH pairs AS (
     SELECT w, unnest(toks[:-2]) AS a, unnest(toks[2:]) AS c, generate_subscripts(toks[:-2], 1) AS p FROM step WHERE len(toks) > 1 AND n < {ROUNDS}
   ), best AS (
     SELECT w, min(m * 4294967296 + p) AS b FROM pairs JOIN merges USING (a, c) GROUP BY w
   )
   SELECT w, list_concat(toks[: b % 4294967296 - 1], [b // 4294967296], toks[b % 4294967296 + 2 :]), n + 1 FROM step JOIN best USING (w))
)
SELECT w, max(n) AS n, arg_max(toks, n) AS toks FROM step GROUP BY w
"""

DECODE = """
SELECT d, string_agg(h, '' ORDER BY p) AS hex FROM ids JOIN vocab USING (t) GROUP BY d
"""


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a tiktoken file: base64 of a token's bytes and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Codec:
    """Encoder and decoder of one worker; holds an in-memory DuckDB connection."""

    def __init__(self, data: bytes, pattern: str):
        import duckdb
        import numpy as np
        import pyarrow as pa
        import regex

        self.ranks = parse_ranks(data)
        self.tokens = {m: t for t, m in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the generation before; what is used again moves to memo
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        merges, rank = array("q"), self.ranks.get
        for t, m in self.ranks.items():
            for i in range(1, len(t)):
                if (left := rank(t[:i])) is not None and (right := rank(t[i:])) is not None:
                    merges.extend((left, right, m))
        a, c, m = np.frombuffer(merges, np.int64).reshape(-1, 3).T if merges else (np.zeros(0, np.int64),) * 3
        self.db.register("_m", pa.table({"a": a, "c": c, "m": m}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM _m")
        self.db.register("_v", pa.table({"t": np.fromiter(self.ranks.values(), np.int64), "h": [t.hex() for t in self.ranks]}))
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM _v")
        give_back()

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        import numpy as np
        import pyarrow as pa

        done = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        tokens = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        seed = pa.table({"w": np.arange(len(words)), "toks": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), tokens)})
        while len(seed):
            self.db.register("seed", seed)
            out = self.db.sql(CONTRACT).to_arrow_table().combine_chunks()
            lists = out["toks"].chunk(0) if out.num_rows else pa.array([], pa.list_(pa.int64()))
            ends = lists.offsets.to_numpy()
            ids = lists.values.to_numpy().astype("<u4").tobytes()
            n = out["n"].to_numpy()
            for k, word in enumerate(out["w"].to_pylist()):
                if n[k] < ROUNDS:
                    done[word] = ids[4 * ends[k] : 4 * ends[k + 1]]
            seed = out.filter(pa.array(n >= ROUNDS)).select(["w", "toks"])
        return done

    def words(self, wanted: list[bytes], lookup: bool = True) -> list[bytes]:
        """Ids of each short word: contracted, ``FRESH_BYTES`` of words at a time; with ``lookup``, those of the vocabulary are one id."""
        out: list[bytes] = []
        pending: list[bytes] = []
        place: list[int] = []
        held = 0

        def flush():
            for k, ids in zip(place, self.contract(pending), strict=True):
                out[k] = ids

        for word in wanted:
            whole = self.ranks.get(word) if lookup else None
            out.append(b"" if whole is None else whole.to_bytes(4, "little"))
            if whole is None and word:
                place.append(len(out) - 1)
                pending.append(word)
                held += len(word)
                if held >= FRESH_BYTES:
                    flush()
                    pending, place, held = [], [], 0
        if pending:
            flush()
        return out

    def long_word(self, raw: bytes) -> bytes:
        """Ids of a word of any length, by its parts."""
        import numpy as np

        known: dict[bytes, list[int]] = {}

        def learn(strings):
            fresh = sorted({x for x in strings if x not in known})
            known.update(zip(fresh, (np.frombuffer(ids, "<u4").tolist() for ids in self.words(fresh, lookup=False)), strict=True))

        def bytes_of(ids):
            return b"".join(map(self.tokens.__getitem__, ids))

        def pair(a, b):  # whether two tokens side by side stay as they are
            both = bytes_of((a, b))
            learn([both])
            return known[both] == [a, b]

        cuts = [raw[k : k + LONG] for k in range(0, len(raw), LONG)]
        learn(cuts)
        parts = [known[x] for x in cuts]
        # What most borders need, in three queries: their pairs; where these aren't encodings, the tokens around; their ends' pairs.
        borders = list(zip(parts, parts[1:], strict=False))
        learn(bytes_of((a[-1], b[0])) for a, b in borders)
        borders = [(a, b) for a, b in borders if not pair(a[-1], b[0])]
        learn(bytes_of(a[-BORDER:] + b[:BORDER]) for a, b in borders)
        middles = [known[bytes_of(a[-BORDER:] + b[:BORDER])] for a, b in borders]
        learn(bytes_of((a[-BORDER - 1], m[0])) for (a, _), m in zip(borders, middles, strict=True) if len(a) > BORDER)
        learn(bytes_of((m[-1], b[BORDER])) for (_, b), m in zip(borders, middles, strict=True) if len(b) > BORDER)
        done = list(parts[0])
        for part in parts[1:]:
            rest = part
            while rest and not pair(done[-1], rest[0]):
                left = right = BORDER
                while True:
                    right = min(right, len(rest))
                    around = bytes_of(done[-left:] + rest[:right])
                    learn([around])
                    middle = known[around]
                    if left < len(done) and not pair(done[-left - 1], middle[0]):
                        left *= 2
                    elif right < len(rest) and right < 8 * BORDER and not pair(middle[-1], rest[right]):
                        right *= 2
                    else:
                        break
                # On the right the ends may still differ: the border then has moved on.
                del done[-left:]
                done += middle
                rest = rest[right:]
            done += rest
        return np.array(done, "<u4").tobytes()

    def learn(self, fresh: list[str]) -> None:
        short = [x for x in fresh if len(x) <= LONG and len(x.encode()) <= LONG]
        self.memo.update(zip(short, self.words([x.encode() for x in short]), strict=True))
        for piece in set(fresh).difference(short):
            whole = self.ranks.get(piece.encode())
            self.memo[piece] = self.long_word(piece.encode()) if whole is None else whole.to_bytes(4, "little")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        pieces = [self.find(t) for t in texts]
        memo, old = self.memo, self.old
        absent = {x for own in pieces for x in own if x not in memo}
        if len(memo) + len(absent) > MEMO_WORDS and memo:
            memo, old = self.memo, self.old = {}, memo
            absent = {x for own in pieces for x in own}
        if absent:
            found = {x: old[x] for x in absent if x in old}
            memo.update(found)
            self.learn(sorted(absent.difference(found)))
        get = memo.__getitem__
        return [b"".join(map(get, own)) for own in pieces]

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids."""
        import numpy as np
        import pyarrow as pa

        parts: list[list[bytes]] = [[] for _ in encoded]
        group: list[tuple[int, object]] = []
        held = 0

        def flush():
            sizes = [len(x) for _, x in group]
            d = np.repeat(np.arange(len(group)), sizes)
            self.db.register("ids", pa.table({"d": d, "p": np.arange(len(d)), "t": np.concatenate([x for _, x in group]).astype(np.int64)}))
            for d, text in self.db.execute(DECODE).fetchall():
                parts[group[d][0]].append(bytes.fromhex(text))

        for k, ids in enumerate(encoded):
            ids = np.frombuffer(ids, "<u4")
            for at in range(0, len(ids), DECODE_TOKENS):
                group.append((k, ids[at : at + DECODE_TOKENS]))
                held += len(group[-1][1])
                if held >= DECODE_TOKENS:
                    flush()
                    group, held = [], 0
        if group:
            flush()
        return [b"".join(x) for x in parts]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data, pattern)
    return _codecs[key]


def slices(ids: list, texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[list, list[str]]]:
    start, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= most:
            yield ids[start : k + 1], texts[start : k + 1]
            start, held = k + 1, 0
    if start < len(texts):
        yield ids[start:], texts[start:]


def _run(docs: DataFrame, vocabulary: str, pattern: str, schema, fields: Callable[[Codec, list, list[str]], dict]) -> DataFrame:
    with open(vocabulary, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary file: its size doesn't depend on the corpus

    def run(batches):
        import pyarrow as pa

        own = codec(ranks.value, pattern)
        for batch in batches:
            for ids, texts in slices(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_pydict(fields(own, ids, texts))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of long)."""

    def fields(own, ids, texts):
        import numpy as np
        import pyarrow as pa

        arrays = [np.frombuffer(x, "<u4").astype(np.int64) for x in own.encode(texts)]
        return {"doc_id": pa.array(ids, pa.int64()), "ids": pa.array(arrays, pa.list_(pa.int64()))}

    return _run(docs, vocabulary, pattern, "doc_id long, ids array<long>", fields)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, data (binary) of a table with doc_id and ids (array of long; null: empty)."""
    with open(vocabulary, "rb") as file:
        ranks = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = codec(ranks.value, r"\z")
        for batch in batches:
            ids = [np.array(x or [], "<u4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "data": pa.array(own.decode(ids), pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each text, then decodes its ids."""

    def fields(own, ids, texts):
        import pyarrow as pa

        encoded = own.encode(texts)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return {
            "doc_id": pa.array(ids, pa.int64()),
            "n_tokens": pa.array([len(x) // 4 for x in encoded], pa.int64()),
            "ids_sha256": pa.array(map(sha, encoded), pa.string()),
            "decoded_sha256": pa.array(map(sha, own.decode(encoded)), pa.string()),
        }

    return _run(docs, vocabulary, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", fields)


def tokens(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), decoded_sha256: the ids of each text, and what they decode to."""

    def fields(own, ids, texts):
        import numpy as np
        import pyarrow as pa

        encoded = own.encode(texts)
        arrays = [np.frombuffer(x, "<u4").astype(np.int32) for x in encoded]
        return {
            "doc_id": pa.array(ids, pa.int64()),
            "n_tokens": pa.array([len(x) for x in arrays], pa.int64()),
            "ids": pa.array(arrays, pa.list_(pa.int32())),
            "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in own.decode(encoded)], pa.string()),
        }

    return _run(docs, vocabulary, pattern, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string", fields)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

"""Token counts by a count-only Viterbi search over a unigram vocabulary.

The vocabulary is a SentencePiece model file: each normal piece with its score; pieces are matched as a unigram tokenizer
matches them, whatever algorithm made the file. Spaces become ``▁``, one is put before the text unless it starts with one, and
the text is cut before each ``▁``; every word is searched by itself. An Aho-Corasick automaton lists all pieces that end at a
place, the longest first; dynamic programming carries the best score and its piece count, never the segmentation.

Tie rules, as in the tokenizer: scores add up in double precision from the word's start; a candidate replaces the one found so
far only if its score is strictly greater, and candidates come by their start, leftmost first, so of equal scores the longest
last piece wins. A character without a piece of its own may be read as unknown, at the least score less 10, and then counts
one token for each UTF-8 byte (byte fallback).

Words are remembered by the worker in two bounded generations. There is no shuffle. Defined results: null and empty texts
have no tokens and score 0; whole texts of any length are counted; a null doc_id stays null; an empty table gives an empty
result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MEMO_WORDS = 400_000
NORMAL, USER_DEFINED = 1, 4


def _fields(data: bytes):
    """(field number, value) of a protobuf message; varints as int, others as bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


def parse_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) of each entry of a SentencePiece model, in order of ids."""
    pieces = []
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
    return pieces


class Counter:
    def __init__(self, pieces: list[tuple[str, float, int]]):
        import ahocorasick

        usable = {p: s for p, s, kind in pieces if kind in (NORMAL, USER_DEFINED) and p}
        self.unknown = min(usable.values(), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in usable.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.memo: tuple[dict[str, int], dict[str, float]] = ({}, {})
        self.old: tuple[dict[str, int], dict[str, float]] = ({}, {})

    def word(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation of one word."""
        n, unknown = len(word), self.unknown
        best, pieces = [float("-inf")] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        at, single = 0, False  # the end that is open, and whether a piece of one character ends there

        def close(end: int) -> None:
            if (score := best[end] + unknown) > best[end + 1]:
                best[end + 1] = score
                pieces[end + 1] = pieces[end] + len(word[end].encode())

        for end, (length, own) in self.automaton.iter(word):
            while at < end:
                if not single:
                    close(at)
                at, single = at + 1, False
            if length == 1:
                single = True
            start = end + 1 - length
            if (score := best[start] + own) > best[end + 1]:
                best[end + 1] = score
                pieces[end + 1] = pieces[start] + 1
        while at < n:
            if not single:
                close(at)
            at, single = at + 1, False
        return pieces[n], best[n]

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        words = text.replace(" ", MARK).split(MARK)
        if not words[0] and len(words) > 1:
            del words[0]
        counts, scores = self.memo
        absent = {x for x in words if x not in counts}
        if absent:
            if len(counts) + len(absent) > MEMO_WORDS and counts:
                self.old, self.memo = self.memo, ({}, {})
                counts, scores = self.memo
                absent = set(words)
            old_counts, old_scores = self.old
            for x in absent:
                if x in old_counts:
                    counts[x], scores[x] = old_counts[x], old_scores[x]
                else:
                    counts[x], scores[x] = self.word(MARK + x)
        return sum(map(counts.__getitem__, words)), sum(map(scores.__getitem__, words))


_counters: dict[str, Counter] = {}


def counter(data: bytes) -> Counter:
    key = hashlib.sha256(data).hexdigest()
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(parse_model(data))
    return _counters[key]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, best_score of each text; ``vocabulary``: path of a SentencePiece model, read by the driver."""
    with open(vocabulary, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary file: its size doesn't depend on the corpus

    def run(batches):
        import pyarrow as pa

        own = counter(model.value)
        for batch in batches:
            found = [own.text(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "n_tokens": pa.array([x[0] for x in found], pa.int64()),
                    "best_score": pa.array([float(x[1]) for x in found], pa.float64()),
                }
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, best_score double")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

"""Vectors of texts, and similarity of dense vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS_AT_ONCE = 65_536  # of a matrix of cosines, so that sums stay in the cache


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """A missing vector is unlike any; two zero vectors are alike; a zero vector is unlike others."""
    norm_a, norm_b = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    return (
        F.when(a.isNull() | b.isNull(), 0.0)
        .when((norm_a == 0) & (norm_b == 0), 1.0)
        .when((norm_a == 0) | (norm_b == 0), 0.0)
        .otherwise(dot(a, b) / (norm_a * norm_b))
    )


def cosine_blocks(left: tuple, right: tuple) -> Iterator[tuple[int, np.ndarray]]:
    """``cosine`` of every vector of ``left`` with every one of ``right``, as blocks of (first row, matrix).

    Both are what ``packed`` gives. Products are added up dimension by dimension, so that each value is the one that the expression
    gives, to the last bit, wherever in a block a pair stands; no value (NaN) where the expression has none.
    """
    (len_a, at_a, by_a), (len_b, at_b, by_b) = left, right
    norm_a, norm_b = lengths_of(left), lengths_of(right)
    at_once = max(1, CELLS_AT_ONCE // max(1, len(len_b)))
    for start in range(0, len(len_a), at_once):
        rows = slice(start, start + at_once)
        own_len, own_at, own_norm = len_a[rows], at_a[rows], norm_a[rows]
        cos = np.full((len(own_len), len(len_b)), np.nan)
        for size in np.intersect1d(own_len[own_len >= 0], len_b):
            r, c = np.flatnonzero(own_len == size), np.flatnonzero(len_b == size)
            a, b = by_a[size][own_at[r]], by_b[size][at_b[c]]
            total = np.zeros((len(r), len(c)))
            for k in range(size):
                total += np.multiply.outer(a[:, k], b[:, k])
            with np.errstate(divide="ignore", invalid="ignore"):
                cos[np.ix_(r, c)] = total / np.multiply.outer(own_norm[r], norm_b[c])
        zero_a, zero_b = own_norm == 0, norm_b == 0
        cos[zero_a, :] = 0.0
        cos[:, zero_b] = 0.0
        cos[np.ix_(zero_a, zero_b)] = 1.0
        cos[own_len < 0, :] = 0.0
        cos[:, len_b < 0] = 0.0
        yield start, cos


def cosines_of(left: tuple, right: tuple, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The values of ``cosine_blocks`` for some pairs, of blocks that ``units`` takes."""
    (size, at_a, by_a), (_, at_b, by_b) = left, right
    a, b = by_a[size[0]], by_b[size[0]]
    norm_a, norm_b = lengths_of(left)[rows], lengths_of(right)[columns]
    rows, columns = at_a[rows], at_b[columns]
    total = np.zeros(len(rows))
    for k in range(size[0]):
        total += a[rows, k] * b[columns, k]
    with np.errstate(divide="ignore", invalid="ignore"):
        cos = total / (norm_a * norm_b)
    cos[(norm_a == 0) | (norm_b == 0)] = 0.0
    cos[(norm_a == 0) & (norm_b == 0)] = 1.0
    return cos


def units(vectors: tuple) -> np.ndarray | None:
    """Vectors of length 1 (or 0), if all are there, of one size, and neither tiny nor huge."""
    size, place, by_size = vectors
    if len(by_size) != 1 or (size < 1).any():
        return None
    norm = lengths_of(vectors)
    if not ((norm == 0) | (norm > 1e-100) & (norm < 1e100)).all():
        return None
    return by_size[size[0]][place] / np.where(norm == 0, 1.0, norm)[:, None]


def packed(embeddings: pa.ChunkedArray) -> tuple:
    """Length of each vector (-1: missing), its place among those of this length, and a matrix for each length."""
    one = embeddings.combine_chunks()
    size = pc.fill_null(pc.list_value_length(one), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    place, by_size = np.zeros(len(size), dtype=np.int64), {}
    for n in np.unique(size[size >= 0]):
        rows = np.flatnonzero(size == n)
        place[rows] = np.arange(len(rows))
        values = one.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        by_size[n] = values.reshape(len(rows), n)
    return size, place, by_size


def lengths_of(vectors: tuple) -> np.ndarray:
    size, place, by_size = vectors
    out = np.full(len(size), np.nan)
    for n, matrix in by_size.items():
        squares = np.zeros(len(matrix))
        for k in range(n):
            squares += matrix[:, k] * matrix[:, k]
        rows = size == n
        out[rows] = np.sqrt(squares)[place[rows]]
    return out


def sentence_vectors(texts: DataFrame, word_vectors: DataFrame, size: int, key: str = "id", text: str = "text") -> DataFrame:
    """key, embedding: the mean of the unit vectors of a text's words; words that are unknown, or whose vector is 0, don't count.

    ``word_vectors`` has word and embedding (``size`` numbers). Words are what white space separates, and count as often as they
    occur. They are counted by text before they meet their vectors, and sums are combined before the shuffle. A text without
    known words has a zero vector.
    """
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+", -1), lambda w: w != "")
    counted = texts.select(F.col(key).alias("_k"), F.explode(words).alias("word")).groupBy("_k", "word").agg(F.count(F.lit(1)).alias("_n"))
    length = norm(F.col("embedding"))
    known = word_vectors.where(length > 0).select("word", F.transform("embedding", lambda x: x.cast("double") / length).alias("_v"))
    joined = counted.join(known, "word")
    sums = [F.sum(F.col("_n") * F.get("_v", F.lit(k))) for k in range(size)]
    means = joined.groupBy("_k").agg(F.sum("_n").alias("_all"), F.array(*sums).alias("_sum")).select("_k", F.transform("_sum", lambda x: x / F.col("_all")).alias("_mean"))
    zero = F.array_repeat(F.lit(0.0), size)
    return texts.select(F.col(key)).join(means, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("_mean", zero).alias("embedding"))

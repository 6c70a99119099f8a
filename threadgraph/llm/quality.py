"""Quality classifier: random Fourier features over document statistics, ridge regression and isotonic calibration.

Fitting uses at most ``MAX_LABELLED`` labelled rows, picked by a hash of their doc_id (the one bounded sample here, whatever ids repeat). Their
statistics go to a table in the shared folder; each partition sums its part of the normal equations, the driver adds the sums,
solves them, and calibrates the scores of the rows set aside for that by pooling adjacent violators. Scoring is one pass over all
texts without a shuffle.

Only the text enters a score. Defined results: a null text counts as empty; an empty text has all statistics 0 and is scored
like any other; without labelled rows every score is 0.5; labels that are null, or of null doc_id, are not learned; repeated
rows get equal scores; an empty table gives an empty result; further columns are ignored, or passed on by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table, text_or_empty
from .hashing import give_back

MAX_LABELLED = 20_000  # rows to learn from, at most
FEATURES = 256  # random Fourier features
RIDGE = 1e-3
CALIBRATION_SHARE = 3  # one in so many labelled rows calibrates
THRESHOLD = 0.3
PARTS = 16  # partitions that sum the normal equations


def _classes() -> np.ndarray:
    """0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 mark, 6 byte of a longer character."""
    out = np.zeros(256, np.int64)
    out[33:127] = 5
    out[97:123], out[65:91], out[48:58] = 1, 2, 3
    out[[9, 10, 11, 12, 13, 32]] = 4
    out[128:] = 6
    return out


CLASSES = _classes()
N_STATISTICS = 17


def statistics(text: str) -> list[float]:
    """Numbers that describe a text; all between 0 and about 12."""
    if not text:
        return [0.0] * N_STATISTICS
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    kinds = np.bincount(CLASSES, counts, 7)
    n = float(counts.sum())
    words = text.split()
    n_words = max(len(words), 1)
    lines = text.split("\n")
    n_lines = len(lines)
    letters = max(kinds[1] + kinds[2] + kinds[6], 1)
    return [
        np.log1p(n),
        np.log1p(len(words)),
        min(n / n_words, 40) / 5,
        kinds[1] / n,
        kinds[2] / letters,
        kinds[3] / n,
        kinds[5] / n,
        kinds[6] / n,
        (counts[33] + counts[63]) / n_words,  # ! and ?
        (counts[46] + counts[44]) / n_words,  # . and ,
        counts[124] / n_words,  # |
        (counts[35:39].sum() + counts[42] + counts[64]) / n_words,  # # $ % & * @
        len(set(words)) / n_words,
        sum(map(eq, words, islice(words, 1, None))) / n_words,
        np.log1p(n / n_lines),
        1 - len(set(lines)) / n_lines,
        (counts[60] + counts[62] + counts[123] + counts[125] + counts[61]) / n_words,  # < > { } =
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Features whose products approximate a Gaussian kernel, and a constant."""
        z = np.sqrt(2 / len(self.phases)) * np.cos(((x - self.mean) / self.scale).clip(-6, 6) @ self.directions + self.phases)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        return np.interp(self.raw(x), self.knots, self.levels)


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the non-decreasing fit of labels by scores (pooled adjacent violators)."""
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []  # sum of labels, rows, sum of scores
    for s, y in zip(scores[order], labels[order], strict=True):
        pools.append([float(y), 1.0, float(s)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def _statistics_of(batch_texts) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in batch_texts], np.float64).reshape(-1, N_STATISTICS)


def _summed(df: DataFrame, columns: list[str], function) -> list[np.ndarray]:
    """Sum over all partitions of what ``function`` makes of a batch (a list of arrays)."""

    def run(batches):
        import pickle

        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, N_STATISTICS)
                own = function(x, np.array(batch.column(1).to_pylist(), np.float64))
                total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([pickle.dumps(total)], pa.binary())})

    import pickle

    total = None
    for row in df.select(*columns).coalesce(PARTS).mapInArrow(run, "sums binary").toLocalIterator():
        own = pickle.loads(row["sums"])
        total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
    return total


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", seed: int = 11) -> Model:
    """Learn from labelled rows whose crc32(doc_id as text) mod 5 isn't 0."""
    labelled = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("double").alias("_y")).dropna()
    learned = labelled.where(F.crc32(F.col("_id").cast("string").cast("binary")) % 5 != 0)
    picked = learned.orderBy(F.xxhash64("_id"), "_id", "_y").limit(MAX_LABELLED)  # bounded, so it may be broadcast
    joined = docs.select(F.col("doc_id").cast("long").alias("_id"), text_or_empty().alias("_text")).join(F.broadcast(picked), "_id")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = _statistics_of(batch.column(1))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "y": batch.column(2), "x": pa.array(list(x), pa.list_(pa.float64()))})

    # Documents may repeat a doc_id, so the bound is set again on what was joined.
    described = joined.mapInArrow(run, "id long, y double, x array<double>")
    known = materialise(described.orderBy(F.xxhash64("id"), "id", "y", "x").limit(MAX_LABELLED), "quality-labelled")
    known = known.withColumn("calibrates", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(CALIBRATION_SHARE)) == 0)
    rng = np.random.default_rng(seed)
    moments = _summed(known, ["x", "y"], lambda x, y: [np.array(float(len(x))), x.sum(0), (x * x).sum(0)])
    directions = rng.standard_normal((N_STATISTICS, FEATURES)) / np.sqrt(N_STATISTICS)
    phases = rng.uniform(0, 2 * np.pi, FEATURES)
    none = np.zeros(0)
    if moments is None:
        return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), directions, phases, np.zeros(FEATURES + 1), none, none)
    mean = moments[1] / moments[0]
    scale = np.sqrt(np.maximum(moments[2] / moments[0] - mean**2, 0)) + 1e-3
    model = Model(mean, scale, directions, phases, np.zeros(FEATURES + 1), none, none)

    def normal(x, y, model=model):
        z = model.expand(x)
        return [z.T @ z, z.T @ y]

    sums = _summed(known.where(~F.col("calibrates")), ["x", "y"], normal) or _summed(known, ["x", "y"], normal)
    model.weights = np.linalg.solve(sums[0] + RIDGE * np.eye(FEATURES + 1), sums[1])
    rest = known.where("calibrates").select("x", "y").collect() or known.select("x", "y").collect()  # MAX_LABELLED rows at most
    x, y = np.array([r["x"] for r in rest], np.float64), np.array([r["y"] for r in rest])
    model.knots, model.levels = isotonic(model.raw(x), y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(model.score(_statistics_of(batch.column(1))), pa.float64())})
        give_back()

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score is at least the threshold."""
    place = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(place).fill_null("")
            yield batch.filter(pa.array(model.score(_statistics_of(texts)) >= threshold))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))

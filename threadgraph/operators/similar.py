"""SIMILARITY between comments without its pairs: sums over them, worked out from blocks of vectors each time they are asked for."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .bundles import ALL, Bundles, Pairs, bundle, sentences_of
from .edges import _cosines, _known, _tiles, reach_of, tied_similar


@dataclass(frozen=True)
class SimilarPairs:
    """What ``pairs_similarity`` bundles, which is most pairs of comments: the vectors, and nodes that a filter takes of its edges.

    ``known``: c_idx, embedding, n (number of sentences). ``taken``: c_idx, n of the nodes of which ``both`` ends, or one, are.
    """

    known: DataFrame
    reach: tuple
    max_similarity: float
    base: float
    taken: DataFrame | None = None
    both: bool = True

    @staticmethod
    def of(comments: DataFrame, nodes: DataFrame, vectors: DataFrame, max_similarity: float, base: float) -> SimilarPairs:
        if max_similarity == 1:
            raise ZeroDivisionError("a similarity of 1 leaves no room for a weight")
        known = materialise(_known(comments, vectors, sentences_of(nodes)), "similar-vectors")
        return SimilarPairs(known, reach_of(known), max_similarity, base)

    def holds_for_all(self, kind: str) -> bool:
        return kind == "SIMILARITY"

    def at(self, nodes: DataFrame, both: bool) -> SimilarPairs:
        return replace(self, taken=sentences_of(nodes), both=both)

    def _sums(self, rows: DataFrame, work, schema: str) -> DataFrame:
        return _tiles(rows, None, work, schema, self.reach)

    def _along(self, rows: DataFrame, column: str, forward: bool, name: str) -> DataFrame:
        """c_idx, ``name``: for each comment the sum of weight times ``column`` of those before it (``forward``) or behind it."""
        max_similarity, base = self.max_similarity, self.base

        def work(left, right, same):
            own, other = (side[2][column].to_numpy() for side in (left, right))
            sums, met = [np.zeros(len(own)), np.zeros(len(other))], [np.zeros(len(own), bool), np.zeros(len(other), bool)]
            at = 0
            for ids, columns, wanted, weight in _cosines(left, right, same, max_similarity, base):
                part = slice(at, at + len(ids))
                at += len(ids)
                turned = not same and ids[-1] > columns[0]
                for ordered in (True, False) if turned else (True,):
                    here = wanted & ((ids[:, None] < columns[None, :]) == ordered) if turned else wanted
                    w = np.where(here, weight, 0.0)
                    if forward == ordered:
                        sums[1] += own[part] @ w
                        met[1] |= here.any(axis=0)
                    else:
                        sums[0][part] += w @ other
                        met[0][part] |= here.any(axis=1)
            for side, s, some in zip((left, right), sums, met, strict=True):
                if some.any():
                    yield pa.RecordBatch.from_pydict({"c_idx": pa.array(side[0][some]), name: pa.array(s[some])})

        return self._sums(rows, work, f"c_idx long, {name} double").groupBy("c_idx").agg(F.sum(name).alias(name))

    def given(self) -> DataFrame:
        """c_idx, _out: all weight that a sentence gives to those of later comments."""
        return self._along(self.known.withColumn("n", F.col("n").cast("double")), "n", False, "_out")

    def received(self, handed: DataFrame) -> DataFrame:
        """c_idx, in: what sentences get of the z that earlier comments (c_a) hand out."""
        rows = self.known.join(handed.select(F.col("c_a").alias("c_idx"), "z"), "c_idx", "left").withColumn("z", F.coalesce("z", F.lit(0.0)))
        return self._along(rows, "z", True, "in")

    def counts(self, tests: list[tuple[float, bool]]) -> list[int]:
        """How many pairs of comments have a weight at or over each threshold, or at or under it."""
        max_similarity, base = self.max_similarity, self.base

        def work(left, right, same):
            n = np.zeros(len(tests), np.int64)
            for _, _, wanted, weight in _cosines(left, right, same, max_similarity, base):
                n += [np.count_nonzero(wanted & (weight <= t if smaller else weight >= t)) for t, smaller in tests]
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(n)), pa.int64()), "n": pa.array(n)})

        found = {r["k"]: r["n"] for r in self._sums(self.known, work, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}  # a row for each test
        return [found.get(k, 0) for k in range(len(tests))]

    def edges(self, filtered: list[SimilarPairs]) -> list[int]:
        """Numbers of edges of all sentences, and of each of ``filtered``, in one go over the pairs.

        Sentences p of a comment that a filter takes have p times p edges with both ends taken, and those n - p that it doesn't take have
        the edges with none.
        """
        max_similarity, base = self.max_similarity, self.base
        rows, names = self.known, ["n"]
        for k, own in enumerate(filtered):
            if own.taken is not None:
                names.append(f"n{k}")
                rows = rows.join(own.taken.select("c_idx", F.col("n").alias(f"_{k}")), "c_idx", "left")
                p = F.coalesce(f"_{k}", F.lit(0))
                rows = rows.withColumn(f"n{k}", p if own.both else F.col("n") - p).drop(f"_{k}")

        def work(left, right, same):
            own, other = (np.column_stack([side[2][x].to_numpy() for x in names]).astype(np.float64) for side in (left, right))
            total, at = np.zeros(len(names), np.int64), 0
            for ids, _, wanted, _ in _cosines(left, right, same, max_similarity, base):
                total += (own[at : at + len(ids)] * (wanted.astype(np.float64) @ other)).sum(axis=0).astype(np.int64)  # whole numbers
                at += len(ids)
            yield pa.RecordBatch.from_pydict({"name": pa.array(names), "n": pa.array(total)})

        found = {r["name"]: r["n"] for r in self._sums(rows, work, "name string, n long").groupBy("name").agg(F.sum("n").alias("n")).collect()}  # a row for each filter
        every = found.get("n", 0)
        out = [every]
        for k, own in enumerate(filtered):
            n = found.get(f"n{k}", 0)
            out.append(every if own.taken is None else n if own.both else every - n)
        return out

    def forest(self, threshold: float, smaller_as: bool) -> Bundles:
        """As ``for_forest`` of the bundles."""
        vectors = self.known.where("embedding is not null").select(F.col("c_idx").alias("vec_id"), "embedding")
        found = tied_similar(self.known, vectors, lambda w: w <= threshold if smaller_as else w >= threshold, self.max_similarity, self.base)
        own = materialise(found, "similar-forest")
        n = self.known.select("c_idx", "n")
        for side in ("a", "b"):
            own = own.join(n.withColumnRenamed("c_idx", f"c_{side}").withColumnRenamed("n", f"n_{side}"), f"c_{side}")
        return bundle(n, [Pairs(own, "SIMILARITY", ALL)])

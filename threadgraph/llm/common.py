"""Helpers shared by the corpus operators: inputs and text normalisation; shared storage is the library's."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, shared_dir, shared_path

__all__ = ["WORD_PATTERN", "fresh_names", "join_hot", "lower_ascii", "materialise", "shared_dir", "shared_path", "table", "text_or_empty"]

WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh_names(taken: list[str], *wanted: str) -> dict[str, str]:
    """A column name for each wanted one that is none of those taken, in whatever case."""
    known, out = {t.lower() for t in taken}, {}
    for name in wanted:
        own = f"_{name}"
        while own.lower() in known:
            own = f"_{own}"
        known.add(own.lower())
        out[name] = own
    return out


def join_hot(rows: DataFrame, ones: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of ``rows`` with ``ones``, which has one row for each ``key``, and with it the ``count`` of rows that have the key.

    Keys of over a thousandth of the ``total``, or 1,000 rows, are 1,000 at most: they are broadcast, so that no task gets all rows
    of one. The others meet in a shuffle. Keys aren't null.
    """
    most = max(1_000, -(-total // 1_000))
    ones = materialise(ones, "join-ones")
    hot = ones.where(F.col(count) > most).drop(count)
    rest = ones.drop(count)
    if hot.isEmpty():
        return rows.join(rest, key, "left")
    there = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, "left")
    return there.unionByName(others)

"""Prefix search over an inverted index, ranked by TF-IDF (V1-V5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stem import porter_stem
from ..functions.stem import stem as stem_word

SEPARATOR = r"[^a-zа-яё0-9\-']+"  # fixed value: anything but Latin and Cyrillic letters, digits, - and '


def sanitized(text: Column, case_sensitive: bool = False) -> Column:
    return F.trim(text) if case_sensitive else F.lower(F.trim(text))


def words(text: Column, case_sensitive: bool = False) -> Column:
    pattern = "(?i)" + SEPARATOR
    return F.filter(F.split(sanitized(text, case_sensitive), pattern), lambda t: t != "")


def expansions(token: Column, strategy: str = "prefix") -> Column:
    """What a token is found by: its prefixes, all its substrings, or itself."""
    n = F.length(token)
    if strategy == "exact":
        return F.array(token)
    if strategy == "prefix":
        return F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(token, F.lit(1), k))
    starts = F.sequence(F.lit(1), n)
    return F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(1), n - s + 1), lambda k: F.substring(token, s, k))))


def answers(token: Column, terms: list[str], strategy: str = "prefix") -> Column:
    """Whether a token is found by any of the terms."""
    matches = {"exact": lambda t: token == t, "prefix": lambda t: token.startswith(t)}.get(strategy, lambda t: token.contains(t))
    return reduce(lambda a, b: a | b, [matches(t) for t in terms], F.lit(False))


def token_counts(docs: DataFrame, doc: str = "id", text: str = "text", stem: bool = True, stop_words: list[str] | None = None, case_sensitive: bool = False, keep=None) -> DataFrame:
    """doc, token, n: occurrences. Words are counted first, and only distinct ones stemmed. ``keep`` tells which tokens count;
    without stemming the others are left out before the shuffle."""
    counted = docs.select(F.col(doc).alias("doc"), F.explode(words(F.col(text), case_sensitive)).alias("token"))
    if stop_words:
        counted = counted.where(~F.col("token").isin(stop_words))
    if keep is not None and not stem:
        counted = counted.where(keep(F.col("token")))
    counted = counted.groupBy("doc", "token").agg(F.count(F.lit(1)).alias("n"))
    if not stem:
        return counted
    stems = counted.select("token").distinct().withColumn("stem", porter_stem("token"))
    if keep is not None:
        stems = stems.where(keep(F.col("stem")))
    return counted.join(stems, "token").groupBy("doc", F.col("stem").alias("token")).agg(F.sum("n").alias("n"))


def build_index(docs: DataFrame, strategy: str = "prefix", query: str | None = None, **options) -> DataFrame:
    """term, doc, tf: how often a word of the document begins with the term (or holds it, or is it).

    With a ``query``, only what that query asks for: an index for one search, whose other words are never spread.
    """
    asked = None if query is None else sorted(set(query_tokens(query, options.get("stem", True))))
    counted = token_counts(docs, keep=None if asked is None else lambda token: answers(token, asked, strategy), **options)
    spread = counted.select("doc", "n", F.explode(expansions(F.col("token"), strategy)).alias("term"))
    if asked is not None:
        spread = spread.where(F.col("term").isin(asked))
    return spread.groupBy("term", "doc").agg(F.sum("n").alias("tf"))


def query_tokens(query: str, stem: bool = True) -> list[str]:
    import re

    found = [t for t in re.split(SEPARATOR, query.strip().lower()) if t]
    return [stem_word(t) for t in found] if stem else found


def search(index: DataFrame, n_docs: int | DataFrame, query: str, stem: bool = True, ranked: bool = True) -> DataFrame:
    """doc, score of the documents that have every token of the query, best first; none for an empty query."""
    asked = query_tokens(query, stem)
    spark = index.sparkSession
    if not asked:
        return spark.createDataFrame([], "doc long, score double")
    distinct = sorted(set(asked))
    hits = index.where(F.col("term").isin(distinct))
    spread = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = n_docs.agg(F.count(F.lit(1)).alias("n_docs")) if isinstance(n_docs, DataFrame) else spark.range(1).select(F.lit(n_docs).alias("n_docs"))
    times = F.create_map(*[x for t in distinct for x in (F.lit(t), F.lit(asked.count(t)))])
    weighted = hits.join(F.broadcast(spread), "term").crossJoin(F.broadcast(total))  # as many rows as the query has tokens; one row
    part = F.col("tf") * (1 + F.log(F.col("n_docs") / (1 + F.col("df")))) * times[F.col("term")]
    found = weighted.groupBy("doc").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("k")).where(F.col("k") == len(distinct)).select("doc", "score")
    return found.orderBy(F.desc("score"), "doc") if ranked else found


def triggered(query: str) -> bool:
    """Searches begin with two characters."""
    return len(query) >= 2


def highlight(text: Column, terms: list[str], tag: str = "mark") -> Column:
    """Words of the text that begin with a term, set in tags."""
    import re

    pattern = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?i)\b({pattern})", f"<{tag}>$1</{tag}>") if terms else text

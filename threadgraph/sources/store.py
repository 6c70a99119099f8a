"""Articles, comments and graphs as versioned Parquet tables: append, delete, graphs by articles, read-through (K1-K5, K7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ARTICLES, COMMENTS
from .versions import Version, Versions

GRAPHS = "id long, article_ids string, graph string"
SCHEMAS = {"articles": ARTICLES, "comments": COMMENTS, "graphs": GRAPHS}


def without_articles(articles: DataFrame, comments: DataFrame, graphs: DataFrame, ids: DataFrame, recursive: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables after a deletion; a recursive one takes the articles' comments, and graphs with any of them, along."""
    gone = ids.select(F.col("id").alias("_gone"))
    left = articles.join(gone, articles["id"] == F.col("_gone"), "left_anti")
    if not recursive:
        return left, comments, graphs
    return left, comments.join(gone, comments["article_id"] == F.col("_gone"), "left_anti"), without_graphs_of(graphs, ids)


def without_graphs_of(graphs: DataFrame, ids: DataFrame) -> DataFrame:
    has = graphs.select("id", F.explode(F.from_json("article_ids", "array<bigint>")).alias("_a")).join(ids.select(F.col("id").alias("_a")), "_a", "left_semi").select("id")
    return graphs.join(has, "id", "left_anti")


def rows_of(name: str, rows: DataFrame) -> DataFrame:
    """Rows in the table's columns; what they lack is null, other columns go."""
    fields = [f.split() for f in SCHEMAS[name].split(", ")]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def graph_id(graphs: DataFrame, article_ids: list[int]) -> DataFrame:
    """Graphs of exactly these articles."""
    import json

    return graphs.where(F.col("article_ids") == json.dumps(sorted(int(a) for a in article_ids))).select("id")


def graph_ids(graphs: DataFrame, asked: DataFrame, column: str) -> DataFrame:
    """Rows of ``asked`` with the ``id`` of the graphs of exactly the articles in ``column`` (an array of ids); null where there is none."""
    ids = F.array_sort(F.col(column).cast("array<bigint>"))
    key = F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]"))
    return asked.withColumn("_key", key).join(graphs.select("id", F.col("article_ids").alias("_key")), "_key", "left").drop("_key")


class Store:
    """The three tables under one path, in versions: what is read stays as it was, whatever is committed afterwards, and a change of
    several tables is seen whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)

    def read(self, name: str, version: Version | None = None) -> DataFrame:
        """The table as of a version, by default the newest."""
        return self.versions.read(version or self.versions.current(), name, SCHEMAS[name])

    def append(self, name: str, rows: DataFrame) -> None:
        self.add({name: rows})

    def add(self, rows: dict[str, DataFrame]) -> Version:
        """Rows of several tables in one commit."""
        return self.versions.add({name: rows_of(name, df) for name, df in rows.items()})

    def _without(self, base: Version, ids: DataFrame, recursive: bool) -> dict[str, list[str]]:
        ids = ids.select("id").distinct()

        def of(column: str, how: str):
            return lambda df: df.join(ids.select(F.col("id").alias("_gone")), F.col(column) == F.col("_gone"), how)

        left = {"articles": self.versions.without(base, "articles", of("id", "left_semi"), of("id", "left_anti"), ARTICLES)}
        if recursive:
            left["comments"] = self.versions.without(base, "comments", of("article_id", "left_semi"), of("article_id", "left_anti"), COMMENTS)
            left["graphs"] = self._graphs_without(base, ids)
        return base.tables | left

    def _graphs_without(self, base: Version, ids: DataFrame) -> list[str]:
        def hit(df: DataFrame) -> DataFrame:
            return df.join(without_graphs_of(df, ids).select("id"), "id", "left_anti")

        return self.versions.without(base, "graphs", hit, lambda df: without_graphs_of(df, ids), GRAPHS)

    def delete_articles(self, ids: DataFrame, recursive: bool = True) -> Version:
        """A recursive deletion takes the articles' comments, and graphs with any of them, along."""
        return self.versions.commit(lambda base: self._without(base, ids, recursive))

    def delete_comments(self, article_ids: DataFrame) -> Version:
        """All comments of the articles (ids)."""
        gone = article_ids.select(F.col("id").alias("_gone")).distinct()

        def of(how: str):
            return lambda df: df.join(gone, df["article_id"] == F.col("_gone"), how)

        return self.versions.commit(lambda base: base.tables | {"comments": self.versions.without(base, "comments", of("left_semi"), of("left_anti"), COMMENTS)})

    def delete_graphs(self, article_ids: DataFrame) -> Version:
        """Graphs with any of the articles (ids)."""
        return self.versions.commit(lambda base: base.tables | {"graphs": self._graphs_without(base, article_ids)})

    def graph(self, article_ids: list[int]) -> DataFrame:
        """id, article_ids, graph of exactly these articles; no row where there is none."""
        own = self.read("graphs")
        return own.join(graph_id(own, article_ids), "id", "left_semi")

    def get_article(self, url: str, scrape, override_cache: bool = False, ignore_cache: bool = False) -> DataFrame:
        """The stored article, or what ``scrape(url)`` gives (articles, comments), stored first; even where the cache is ignored.

        What is overridden goes, and what is scraped comes, in one commit.
        """
        from .ingest import prepared_url

        own = self.spark.range(1).select(prepared_url(F.lit(url)).alias("u")).first()["u"] or url
        there = self.read("articles").where(F.col("url") == own)
        if not override_cache and not ignore_cache and not there.isEmpty():
            return there
        articles, comments = scrape(own)
        new = {name: self.versions.write(name, rows_of(name, df)) for name, df in (("articles", articles), ("comments", comments))}

        def change(base: Version) -> dict[str, list[str]]:
            old = self._without(base, self.read("articles", base).where(F.col("url") == own), True) if override_cache else base.tables
            return old | {name: [*old.get(name, []), folder] for name, folder in new.items()}

        return self.read("articles", self.versions.commit(change)).where(F.col("url") == own)

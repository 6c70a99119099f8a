"""Names and types of the graph tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_WEIGHTS = ("SIZE", "PAGERANK", "DEGREE_CENTRALITY", "RECENCY", "VOTES", "TOXICITY", "MERGE_ID", "CLUSTER_ID")
EDGE_WEIGHTS = ("REPLY_TO", "SAME_ARTICLE", "SIMILARITY", "SAME_GROUP", "SAME_COMMENT", "TEMPORAL")
NODE = ("c_idx", "s_idx")
ENDS = ("src_c", "src_s", "tgt_c", "tgt_s")

COMMENTS = (
    "id long, article_id long, comment_id string, username string, ts timestamp, text string, reply_to string, num_replies long, user_id string, "
    "upvotes long, downvotes long, love long, likes long, recommended long, child_count long, leseempfehlungen long, title string"
)
ARTICLES = "id long, url string, title string, subtitle string, summary string, author string, text string, published_time timestamp, scrape_time timestamp, scraper string"


class GraphError(ValueError):
    """A graph on which an operator isn't defined."""


@dataclass(frozen=True)
class Graph:
    """comments; nodes: (c_idx, s_idx) with their weights; edges: end points with their weights, and ``ord``, which orders them.

    ``bundles`` is what edges were spread from, if they were (``operators/bundles.py``).
    """

    comments: DataFrame
    nodes: DataFrame
    edges: DataFrame
    bundles: object = None

    def with_(self, **changes) -> Graph:
        if "edges" in changes:
            changes = {"bundles": None} | changes
        return replace(self, **changes)


def check_name(name: str, known: tuple[str, ...]) -> str:
    if name not in known:
        raise GraphError(f"{name} is none of {', '.join(known)}")
    return name


def dense_position(df: DataFrame, order: list[str], bucket, name: str) -> DataFrame:
    """``name``: place of each row by ``order``, from 0.

    ``bucket`` is a coarse, monotone function of the order. Rows are numbered within their bucket, and only the counts of
    buckets are summed up in one task, so no task sorts all rows.
    """
    from pyspark.sql import Window

    dealt = df.withColumn("_bucket", bucket)
    counts = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    return numbered.join(offsets, "_bucket").withColumn(name, F.col("_before") + F.col("_in") - 1).drop("_bucket", "_in", "_before")

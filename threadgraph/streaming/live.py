"""Running figures over streams of comments and votes, beyond what a single request sees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def comment_rate(comments: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """article_id, window_start, window_end, n: comments per article and window; later ones than ``late`` don't count."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = comments.withWatermark("ts", late).groupBy("article_id", window.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("article_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def running_votes(votes: DataFrame, late: str = "1 hour") -> DataFrame:
    """id, votes; every (vote_id, id) counts once, as long as its repetition comes within ``late``."""
    once = votes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["vote_id", "id"])
    return once.groupBy("id").agg(F.sum("vote").alias("votes"))


def sessions(comments: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """username, session start and end, n: bursts of a user's comments."""
    counted = comments.withWatermark("ts", late).groupBy("username", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("username", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")

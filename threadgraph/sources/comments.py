"""Comment tables: fixtures from the test tables, replies resolved, positions, articles with their comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COMMENTS, dense_position
from ..storage import ranked_position

EPOCH = 1_704_067_200_000_000
ID_BUCKET = 65_536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conform(df: DataFrame) -> DataFrame:
    """The comment columns, in order and with their types; missing ones are null."""
    fields = [f.split() for f in COMMENTS.split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def from_conversations(conversations: DataFrame) -> DataFrame:
    n = F.length("text")
    micros = F.lit(EPOCH) + (F.col("conv_id") * 600 + F.col("turn") * 137) * 1_000_000 + F.col("turn") * 250_000
    before = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") - 1).cast("string"))
    return conform(
        conversations.select(
            (F.col("conv_id") * 16 + F.col("turn") + 1).alias("id"),
            F.col("conv_id").alias("article_id"),
            F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("comment_id"),
            F.col("role").alias("username"),
            F.timestamp_micros(micros).alias("ts"),
            "text",
            F.when((F.col("turn") != 0) & (F.col("turn") % 3 != 2), before).alias("reply_to"),
            F.nullif(n % 7, F.lit(0)).alias("upvotes"),
            (n % 3).alias("downvotes"),
            F.when(F.col("role") == "assistant", n % 5).alias("likes"),
            F.nullif(F.col("turn") % 4, F.lit(0)).alias("recommended"),
        )
    )


def from_events(events: DataFrame) -> DataFrame:
    return conform(
        events.select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("article_id"),
            F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("comment_id"),
            F.col("event_type").alias("username"),
            F.col("ts").cast("timestamp").alias("ts"),
            (F.floor("value").cast("bigint") % 10).alias("upvotes"),
        )
    )


def resolve_replies(comments: DataFrame, article_ids: list | None = None) -> DataFrame:
    """``reply_to_id``: id of the comment that is answered, in the same article. What isn't an integer is no article id.

    A comment_id that an article has twice multiplies the rows that answer it.
    """
    own = comments
    if article_ids is not None:
        own = own.where(F.col("article_id").isin([a for a in article_ids if isinstance(a, int) and not isinstance(a, bool)]))
    answered = comments.select(F.col("id").alias("reply_to_id"), F.col("comment_id").alias("_cid"), F.col("article_id").alias("_aid"))
    return own.join(answered, (own["reply_to"] == F.col("_cid")) & (own["article_id"] == F.col("_aid")), "left").drop("_cid", "_aid")


def positions(comments: DataFrame) -> DataFrame:
    """``c_idx``: place of the comment by id.

    Ids that lie close together are numbered in buckets of ids. With sparse ones (hashes, say) there would be about as many
    buckets as rows, whose counts one task adds up; such tables are numbered in ranges of rows.
    """
    ends = comments.agg(F.count("id").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).first()
    if ends["n"] and (ends["b"] - ends["a"]) // ID_BUCKET > 1000 + ends["n"] // 1024:
        return ranked_position(comments, ["id"], "c_idx")
    return dense_position(comments, ["id"], F.floor(F.col("id") / ID_BUCKET), "c_idx")


def id_index(comments: DataFrame) -> DataFrame:
    """id, c_idx; of repeated ids the last place."""
    return comments.groupBy("id").agg(F.max("c_idx").alias("c_idx"))


def fixture(spark: SparkSession, sf_dir: str, source: str = "conversations") -> DataFrame:
    """Comments of a test table, ready for a graph."""
    made = from_conversations if source == "conversations" else from_events
    return positions(resolve_replies(made(table(spark, sf_dir, source))))


def nest(articles: DataFrame, comments: DataFrame) -> DataFrame:
    """Articles with an array of their comments, by id; without comments, an empty one."""
    fields = [c for c in comments.columns if c != "article_id"]
    own = comments.groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("comments"))
    joined = articles.join(own, articles["id"] == own["article_id"], "left").drop("article_id")
    return joined.withColumn("comments", F.coalesce("comments", F.array().cast(own.schema["comments"].dataType)))


def article_ids(articles: DataFrame, urls: DataFrame) -> DataFrame:
    """url, id of the articles asked for; an unknown url has a null id."""
    return urls.join(articles.select("url", "id"), "url", "left")


def stories(listed: DataFrame, articles: DataFrame) -> DataFrame:
    """title, sources (array of url, id) of stories (title, sources: array of urls), in the given order; unknown ones have a null id."""
    from .ingest import prepared_url

    each = listed.select("title", F.posexplode_outer("sources").alias("_at", "_source"))
    each = each.withColumn("url", F.coalesce(prepared_url(F.col("_source")), "_source"))
    known = article_ids(articles, each.select("url").where("url is not null").distinct()).groupBy("url").agg(F.min("id").alias("id"))
    found = each.join(known, "url", "left").withColumn("_s", F.when(F.col("_source").isNotNull(), F.struct("_at", "_source", "id")))
    listed_ = F.transform(F.array_sort(F.collect_list("_s")), lambda s: F.struct(s["_source"].alias("url"), s["id"].alias("id")))
    return found.groupBy("title").agg(listed_.alias("sources"))

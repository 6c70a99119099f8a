"""What the reader's screen shows: filter flags, histogram, brush, lasso, votes, clusters, links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EDGE_WEIGHTS, NODE, Graph

FILTERS = ("highlight", "timeRange", "search", "lasso")
HIDING = ("search", "lasso", "timeRange")
# Weights of the edge types in the strength of a link.
LINK_WEIGHTS = {"REPLY_TO": 1.0, "SAME_ARTICLE": 1.0, "SIMILARITY": 1.0, "SAME_GROUP": 1.0, "SAME_COMMENT": 1.0, "TEMPORAL": 1.0}


def with_filters(comments: DataFrame) -> DataFrame:
    return comments.withColumns({f"f_{n}": F.lit(False) for n in FILTERS})


def apply_filter(view: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """Set the flag of the comments whose id is in ``ids`` (column id), and clear it elsewhere."""
    own = ids.select(F.col("id").alias("_id")).distinct().withColumn("_in", F.lit(True))
    return view.join(own, view["id"] == own["_id"], "left").withColumn(f"f_{name}", F.col("_in").isNotNull()).drop("_id", "_in")


def clear_filters(view: DataFrame, names: list[str] | None = None) -> DataFrame:
    return view.withColumns({f"f_{n}": F.lit(False) for n in names or FILTERS})


def visible(view: DataFrame, active: list[str]) -> DataFrame:
    """``visible``: every filter that hides is off, or has the comment."""
    shown = reduce(lambda a, b: a & b, [F.col(f"f_{n}") for n in HIDING if n in active], F.lit(True))
    return view.withColumn("visible", shown)


def counter(view: DataFrame) -> DataFrame:
    return view.agg(F.count_if("visible").alias("n_visible"), F.count(F.lit(1)).alias("n_total"))


def chronological(comments: DataFrame) -> DataFrame:
    return comments.orderBy(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "id")


def time_bins(comments: DataFrame, width: int = 400, max_date: str | None = None) -> DataFrame:
    """id, bin: place in the time span, in steps of about five pixels, halves rounded up."""
    own = comments.select("id", F.unix_micros("ts").alias("_at")).where("_at is not null")
    if max_date is not None:
        own = own.where(F.col("_at") < F.unix_micros(F.lit(max_date).cast("timestamp")))
    span = own.agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    bins = int(width / 5 + 0.5)
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col("_at") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return own.crossJoin(F.broadcast(span)).select("id", F.floor(share * bins + 0.5).alias("bin"))  # one row


def time_histogram(comments: DataFrame, width: int = 400, max_date: str | None = None) -> DataFrame:
    return time_bins(comments, width, max_date).groupBy("bin").agg(F.count(F.lit(1)).alias("n")).orderBy("bin")


def brush(comments: DataFrame, low: int, high: int, width: int = 400) -> DataFrame:
    return time_bins(comments, width).where(F.col("bin").between(low, high)).select("id")


def inside(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd rule: an odd number of sides are crossed to the right of the point."""
    crossed = []
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if y1 != y2:
            crossed.append((((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)).cast("int"))
    return reduce(lambda a, b: a + b, crossed, F.lit(0)) % 2 == 1


def lasso(placed: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """id, selected: whether a sentence of the comment lies in the polygon; ``placed`` has id, x and y of each."""
    hit = inside(F.round("x"), F.round("y"), polygon)
    return placed.withColumn("_hit", hit).groupBy("id").agg(F.max("_hit").alias("selected"))


def vote_totals(votes: DataFrame, by_split: bool = False) -> DataFrame:
    """id (and s_idx), votes; and of all of them the least and the most. ``votes`` has a row (vote_id, id, s_idx, vote) for each
    sentence that is voted on at a time. A comment counts once each time, however many of its sentences were selected."""
    keys = ["id", "s_idx"] if by_split else ["id"]
    once = votes.select("vote_id", *keys, "vote").distinct()
    total = once.groupBy(*keys).agg(F.sum("vote").alias("votes"))
    span = total.agg(F.min("votes").alias("least"), F.max("votes").alias("most"))
    return total.crossJoin(F.broadcast(span))  # one row


def vote_colour(totals: DataFrame, default: float = 0.5) -> DataFrame:
    low = F.abs(F.col("least"))
    share = F.when((F.col("least") == 0) & (F.col("most") == 0), default).otherwise((F.col("votes") + low) / (low + F.col("most")))
    return totals.select("id", share.alias("colour"))


def rebucket_clusters(nodes: DataFrame, name: str = "CLUSTER_ID", least: int = 20, groups: int = 15, first: int = 4) -> DataFrame:
    """Sentences of small clusters go to one of ``groups`` others, by their place."""
    sizes = nodes.groupBy(name).agg(F.count(F.lit(1)).alias("_size"))
    other = ((F.col("c_idx") * 31 + F.col("s_idx")) % groups + first).cast("double")
    return nodes.join(sizes, name).withColumn(name, F.when(F.col("_size") < least, other).otherwise(F.col(name))).drop("_size")


def cluster_centroids(nodes: DataFrame, name: str = "CLUSTER_ID") -> DataFrame:
    """Of each cluster the first node with most edges."""
    best = F.min(F.struct((-F.col("DEGREE_CENTRALITY")).alias("d"), *NODE)).alias("_b")
    return nodes.groupBy(name).agg(best).select(name, F.col("_b.c_idx").alias("c_idx"), F.col("_b.s_idx").alias("s_idx"))


def link_strength(edges: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    weights = weights or LINK_WEIGHTS
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(w) * weights.get(w, 0.0), F.lit(0.0)) for w in EDGE_WEIGHTS])
    return edges.select("src_c", "src_s", "tgt_c", "tgt_s", total.alias("strength"))


def stroke(strength: Column) -> Column:
    return F.least(F.greatest(strength * 3, F.lit(1.0)), F.lit(1.0))


def radius(pagerank: Column, in_range: Column | None = None) -> Column:
    scale = F.lit(100.0) if in_range is None else F.when(in_range, 100.0).otherwise(50.0)
    return scale * F.sqrt(pagerank)


def group_index(comments: DataFrame, group: str = "grp_id") -> DataFrame:
    """group, ids (sorted); comments without a group form one."""
    return comments.groupBy(group).agg(F.sort_array(F.collect_list("id")).alias("ids"))


def index_map(comments: DataFrame) -> DataFrame:
    """One row with the map from place to id, as the API hands it out."""
    return comments.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("c_idx", "id")))).alias("idx2id"))


def source_counts(articles: DataFrame, comments: DataFrame, labels: dict[str, str]) -> DataFrame:
    """label, n_articles, n_comments of each source; an unknown scraper goes by its own name."""
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]) if labels else None
    label = F.coalesce(known[F.col("scraper")], F.col("scraper")) if known is not None else F.col("scraper")
    counts = comments.groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))
    joined = articles.join(counts, articles["id"] == counts["article_id"], "left")
    return joined.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n_articles"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_comments"))


def resolved_links(graph: Graph) -> DataFrame:
    """Edges with the comment ids of both ends."""
    own = graph.nodes.select(*NODE, "id")
    src = own.select(F.col("c_idx").alias("src_c"), F.col("s_idx").alias("src_s"), F.col("id").alias("src_id"))
    tgt = own.select(F.col("c_idx").alias("tgt_c"), F.col("s_idx").alias("tgt_s"), F.col("id").alias("tgt_id"))
    return graph.edges.join(src, ["src_c", "src_s"]).join(tgt, ["tgt_c", "tgt_s"])


def positions_fixture(nodes: DataFrame) -> DataFrame:
    """Deterministic places on the screen, for tests."""
    return nodes.select("c_idx", "s_idx", "id", (F.col("c_idx") * 37 % 100).cast("double").alias("x"), ((F.col("s_idx") * 53 + F.col("c_idx")) % 100).cast("double").alias("y"))


def last_state(events: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key."""
    by = Window.partitionBy(key).orderBy(F.col(order).desc())
    return events.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")

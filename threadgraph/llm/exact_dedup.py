"""Exact deduplication over an extendible-hash index kept on shared files (DataFrame functions only).

1. Every row gets a 64-bit key of its normalised text. The keys' leading bits are counted, and the directory is built: starting
   with one bucket, a bucket over ``capacity`` rows splits in two, which doubles the directory when the bucket is as deep as the
   directory. A bucket is thus a range of keys. What can't be split is a text (or a few) with more rows than a bucket holds;
   such keys are counted one by one, and their rows are dealt into salted parts of ``capacity`` rows.
2. Rows go to the owner task of their bucket and part. The owner sorts them by key and text: rows of equal keys are chained by a
   comparison of bytes, and a chain's largest id and length are written down with each of its entries (chains of a key differ by digest). This is the index: Parquet
   in the shared folder, in order of buckets.
3. Only the parts of a salted key remain to be put together: the first entry of each chain of a part carries the text, and these
   entries, one for each part, meet by text. All other results are read off the index.

The directory has ``2**MAX_DEPTH`` slots at most and is broadcast, 12 MB; from ``2**MAX_DEPTH / 4`` full buckets on, buckets are
larger than ``capacity``. Salted keys are fewer than buckets. An owner's sort spills.

Defined results: a null text counts as empty; empty texts are equal to one another; rows that repeat a doc_id count as rows
of their group, and are all marked alike by ``exact_groups``, whereas ``exact_dedup`` keeps one row of each text, whatever the
ids; a null doc_id is never the largest, and such a row is kept only if its group has no other id; an empty table gives an empty
result; other columns of the input, whatever their names, are not touched.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_names, lower_ascii, materialise, table, text_or_empty

CAPACITY = 4_096  # rows of a bucket
MAX_DEPTH = 20


def build_directory(histogram: dict[int, int], max_depth: int, capacity: int) -> tuple[int, list[int]]:
    """Directory of an extendible hash: (global depth, bucket of each slot).

    ``histogram`` counts rows by the leading ``max_depth`` bits of their key. Buckets that can't split further (one slot of
    the deepest directory) may stay over capacity.
    """
    prefix = [0]
    for slot in range(1 << max_depth):
        prefix.append(prefix[-1] + histogram.get(slot, 0))
    depth, directory, local = 0, [0], [0]  # local: depth of each bucket
    pending = [(0, 0)]  # (bucket, its leading bits)
    while pending:
        bucket, bits = pending.pop()
        span = max_depth - local[bucket]
        rows = prefix[(bits + 1) << span] - prefix[bits << span]
        if rows <= capacity or span == 0:
            continue
        if local[bucket] == depth:
            directory = [b for b in directory for _ in (0, 1)]
            depth += 1
        local[bucket] += 1
        local.append(local[bucket])
        new, new_bits = len(local) - 1, 2 * bits + 1
        width = 1 << (depth - local[bucket])
        directory[new_bits * width : (new_bits + 1) * width] = [new] * width
        pending += [(bucket, 2 * bits), (new, new_bits)]
    return depth, directory


def _key() -> Column:
    return F.xxhash64(lower_ascii(text_or_empty()))


def _slot(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth).cast("int") if depth else F.lit(0)


def _directory(docs: DataFrame, capacity: int, max_depth: int) -> tuple[int, DataFrame, DataFrame]:
    """Depth of the directory; (slot, bucket) of it; (key, parts) of the keys that are dealt into parts."""
    spark = docs.sparkSession
    keys = materialise(docs.select(_key().alias("key")), "exact-keys")
    n = keys.count()
    capacity = max(capacity, -(-4 * n // (1 << max_depth)))
    most = min(max_depth, max(0, (8 * n // capacity).bit_length()))  # a slot has an eighth of a bucket at this depth, or less
    slots = keys.groupBy(_slot(F.col("key"), most).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["slot"]: r["n"] for r in slots.collect()}  # 2**MAX_DEPTH rows at most
    depth, directory = build_directory(histogram, most, capacity)
    slot_rows = _values(spark, directory)
    crowded = _values(spark, sorted(s for s, k in histogram.items() if k > capacity)).select(F.col("value").alias("slot"))  # n / capacity at most
    held = keys.withColumn("slot", _slot(F.col("key"), most)).join(F.broadcast(crowded), "slot", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    parts = held.where(F.col("n") > capacity).select("key", F.ceil(F.col("n") / capacity).cast("int").alias("parts"))
    return depth, slot_rows, parts


def _values(spark: SparkSession, values: list[int]) -> DataFrame:
    """place, value of each of the values."""
    rows = F.from_json(F.lit(json.dumps(values)), "array<int>")
    return spark.range(1).select(F.posexplode(rows).alias("place", "value"))


def _index(docs: DataFrame, kept: list[str], capacity: int, max_depth: int, first_only: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """The index, as a table of entries: columns ``kept`` of the input, and those named by the second result:

    bucket, part, parts, key, sha, keep_id, size (of the chain in this part), nth (1: the row of the chain that stays), text (of
    the row that stays, where the key has several parts). ``first_only``: only rows that stay have an entry.
    """
    names = fresh_names(docs.columns, "bucket", "part", "parts", "key", "slot", "text", "sha", "keep_id", "size", "nth", "id")
    depth, directory, parts = _directory(docs, capacity, max_depth)
    c = {n: F.col(v) for n, v in names.items()}
    own = docs.select(*dict.fromkeys([*kept, "text"]), F.col("doc_id").alias(names["id"]), _key().alias(names["key"]))
    own = own.withColumn(names["slot"], _slot(c["key"], depth))
    own = own.join(F.broadcast(directory.toDF(names["slot"], names["bucket"])), names["slot"])  # 2**MAX_DEPTH rows at most
    own = own.join(F.broadcast(parts.toDF(names["key"], names["parts"])), names["key"], "left")  # fewer than buckets
    own = own.withColumn(names["parts"], F.coalesce(c["parts"], F.lit(1)))
    # Dealt by doc_id, which a task that runs again sees again; rows without one by their place in the table.
    place = F.coalesce(c["id"].cast("string"), F.monotonically_increasing_id().cast("string"))
    part = F.when(c["parts"] > 1, F.pmod(F.xxhash64(place), c["parts"])).otherwise(0).cast("int")
    dealt = own.withColumn(names["part"], part).drop(names["slot"]).repartition(names["bucket"], names["part"])
    # The owner's side: one sort by key, text and id.
    dealt = dealt.withColumn(names["text"], lower_ascii(text_or_empty()))
    chain = Window.partitionBy(names["bucket"], names["part"], names["key"], names["text"]).orderBy(c["id"].desc_nulls_last())
    whole = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chained = dealt.select(
        *[F.col(k) for k in kept],
        *[c[n] for n in ("bucket", "part", "parts", "key", "text")],
        F.first(c["id"]).over(whole).alias(names["keep_id"]),
        F.count(F.lit(1)).over(whole).alias(names["size"]),
        F.row_number().over(chain).alias(names["nth"]),
    )
    if first_only:
        chained = chained.where(c["nth"] == 1)
    head = F.when((c["nth"] == 1) & (c["parts"] > 1), c["text"])
    return materialise(chained.withColumns({names["sha"]: F.sha2(c["text"].cast("binary"), 256), names["text"]: head}), "exact-index"), names


def _together(index: DataFrame, names: dict[str, str]) -> DataFrame:
    """Of the chains of salted keys, a row for each part: bucket, part, key, sha, and keep_id, size and nth over all parts."""
    heads = index.where(F.col(names["text"]).isNotNull())
    whole = Window.partitionBy(names["bucket"], names["key"], names["text"])
    c = {n: F.col(v) for n, v in names.items()}
    return heads.select(
        *[c[n] for n in ("bucket", "part", "key", "sha")],
        F.max(c["keep_id"]).over(whole).alias(names["keep_id"]),
        F.sum(c["size"]).over(whole).alias(names["size"]),
        F.row_number().over(whole.orderBy(c["keep_id"].desc_nulls_last(), c["part"])).alias(names["nth"]),
    )


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    index, names = _index(docs, ["doc_id"], capacity, max_depth)
    c = {n: F.col(v) for n, v in names.items()}
    place = [names[n] for n in ("bucket", "part", "key", "sha")]
    salted = index.where(c["parts"] > 1).drop(names["keep_id"], names["size"]).join(_together(index, names).drop(names["nth"]), place)

    def result(rows):
        kept = F.col("doc_id").eqNullSafe(c["keep_id"])
        return rows.select("doc_id", c["keep_id"].alias("keep_id"), c["size"].alias("group_size"), kept.alias("kept"), c["sha"].alias("text_sha256"))

    return result(index.where(c["parts"] == 1)).union(result(salted))


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts, one with the largest doc_id."""
    index, names = _index(docs, docs.columns, capacity, max_depth, first_only=True)
    c = {n: F.col(v) for n, v in names.items()}
    place = [names[n] for n in ("bucket", "part", "key", "sha")]
    first = index.where(c["nth"] == 1)
    best = _together(index, names).where(c["nth"] == 1).select(*place)
    salted = first.where(c["parts"] > 1).join(best, place, "left_semi")
    return first.where(c["parts"] == 1).select(*docs.columns).union(salted.select(*docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""

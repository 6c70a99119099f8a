"""Shared storage: where lineage is cut and steps are written down."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Only a local session (tests) may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='threadgraph-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def steps_dir(spark: SparkSession) -> str:
    """Folder of the steps that this application writes down."""
    return f"{shared_dir(spark)}/threadgraph-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{steps_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete_steps(spark: SparkSession) -> None:
    """Delete all steps written down so far; results that weren't read to their end can't be read any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(steps_dir(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a table in the shared folder, which survives the loss of executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.step_path = path
    return out


def release(*steps: DataFrame) -> None:
    """Delete steps as ``materialise`` returned them; nothing may read them any more."""
    for df in steps:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.step_path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


ROW_BITS = 33  # of monotonically_increasing_id: the row within its partition


def ranked_position(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``name``: place of each row by ``order``, from 0, however its values are spread.

    Rows are range-partitioned, sorted and written down with their place in their range; the driver adds up a count for each
    range. Rows that are equal in all of ``order`` share a range, so it should tell most rows apart.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(dealt, "ranked")
    part = F.shiftright("_at", ROW_BITS)
    counts = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for k in sorted(counts):
        starts.append((k, total))
        total += counts[k]
    offsets = spark.createDataFrame(starts, "_part long, _before long")
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # a row for each range
    return joined.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)).select(*df.columns, name)

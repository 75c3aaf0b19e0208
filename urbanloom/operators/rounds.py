"""Cutting the lineage between the rounds of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def settled(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the folder of ``spark.checkpoint.dir``, read again. Where that is unset, a local master gets a folder of our own and any other an error."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="urbanloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``_b``, the number of their range in the given order, written once so that a lost executor can't move a row."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(df.repartitionByRange(parts, *order).withColumn("_b", F.spark_partition_id()))


def numbered(df: DataFrame, order: list[str], name: str = "id", first: int = 0) -> DataFrame:
    """The rows with gapless numbers in the given order: each range is numbered by itself, and the ranges' counts are added up."""
    rows = ranged(df, order)
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_s"))  # a row a range
    place = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return rows.withColumn("_p", place).join(F.broadcast(starts), "_b").withColumn(name, F.col("_s") + F.col("_p") - 1 + first).drop("_b", "_p", "_s")

"""Structured Streaming forms of dataset preparation and incremental jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from urbanloom.operators.adapters import STANDARD, keep_standard
from urbanloom.operators.rounds import numbered


def stream_dataset(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """A folder of Parquet files read file by file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def incremental_job(source: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str) -> None:
    """Transformed rows in ``out/rows`` and a row an id in ``out/status``; a rerun takes only new input, and ids done before are skipped.

    Both are partitioned by the number of the micro-batch, and a batch that runs again overwrites its own partitions, so a failure
    at any place between the two writes neither loses nor repeats a row. ``status`` is ``success`` for ids with a row in the
    result and ``empty`` for others; ids that come twice in a batch are transformed once each row, and done after it.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if _exists(spark, f"{out}/status"):
            done = spark.read.parquet(f"{out}/status").where(F.col("batch") < number).select(key)
            rows = rows.join(done, key, "left_anti")
        place = lambda df: df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch")
        result = transform(rows)
        place(result).parquet(f"{out}/rows")
        made = spark.read.schema(StructType([*result.schema.fields, StructField("batch", IntegerType())])).parquet(f"{out}/rows").where(F.col("batch") == number).select(key).distinct().withColumn("_made", F.lit(True))
        told = rows.select(key).distinct().join(made, key, "left")
        place(told.select(key, F.when(F.col("_made"), "success").otherwise("empty").alias("status"))).parquet(f"{out}/status")

    source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True


def buffer_shuffle(rows: DataFrame, size: int = 1000, seed: int = 0) -> DataFrame:
    """The rows of a table or stream in a shuffled order: each task holds ``size`` rows, and each row that comes takes the place of one drawn from them, which goes on.

    The draw is seeded by ``seed`` and the task's number; what is held at a task's end follows in shuffled order. No row moves between tasks.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng, held = np.random.default_rng((seed, TaskContext.get().partitionId())), None
        for part in parts:
            pool = pa.Table.from_batches([part] if held is None else [*held.to_batches(), part])
            kept = 0 if held is None else held.num_rows
            slots, out = list(range(min(size, pool.num_rows))), []
            for row in range(max(size, kept), pool.num_rows):
                k = int(rng.integers(0, size))
                out.append(slots[k])
                slots[k] = row
            held = pool.take(pa.array(slots, pa.int64())).combine_chunks()
            yield from pool.take(pa.array(out, pa.int64())).combine_chunks().to_batches()
        if held is not None:
            yield from held.take(pa.array(rng.permutation(held.num_rows))).combine_chunks().to_batches()

    return rows.mapInArrow(run, rows.schema)


def stream_preprocess(rows: DataFrame, prepare: Callable[[DataFrame], DataFrame], keep: tuple[str, ...] = ()) -> DataFrame:
    """Column functions on a stream or table, without foreachBatch: standard columns of the input are renamed ``__@<name>`` before ``prepare``, and those that it does not make itself get their names back.

    ``prepare`` gets the renamed rows and returns them with new columns; only standard columns and those named in ``keep`` stay.
    """
    out = prepare(rows.withColumnsRenamed({c: f"__@{c}" for c in STANDARD if c in rows.columns}))
    out = out.withColumnsRenamed({f"__@{c}": c for c in STANDARD if f"__@{c}" in out.columns and c not in out.columns})
    return keep_standard(out, keep)


def stream_counts(stream: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by event-time window and key, with a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"))


def take_split(source: DataFrame, out: str, checkpoint: str, key: str, take: int | None = None, ratio: float = 0.0) -> None:
    """The first ``take`` rows of a stream, in the order of micro-batches and the key within them: the first floor(take * ratio) as val, the rest as train.

    A batch that runs again overwrites its own part, so nothing is counted twice. A ratio between 0 and 1 needs ``take``.
    """
    if 0 < ratio < 1 and take is None:
        raise ValueError("a share for validation needs the number of rows to take")
    spark = source.sparkSession
    val = int((take or 0) * ratio) if ratio < 1 else take

    def run(batch: DataFrame, number: int) -> None:
        before = 0
        if _exists(spark, out):
            before = spark.read.parquet(out).where(F.col("batch") < number).count()
        rows = numbered(batch, [key], "_r", before)
        if take is not None:
            rows = rows.where(F.col("_r") < take)
        split = F.when(F.lit(ratio >= 1) | (F.col("_r") < (val or 0)), "val").otherwise("train")
        rows.withColumn("split", split).withColumn("batch", F.lit(number)).drop("_r").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

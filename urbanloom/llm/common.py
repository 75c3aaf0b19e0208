"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to numpy in runs of about so many characters, however many rows an Arrow batch has.
CHUNK_CHARS = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local master gets one of our own and any other an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="urbanloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut the lineage: the rows as a Parquet table in the shared folder, read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def text_runs(batches: Iterator[pa.RecordBatch], chars: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches whose second column is the text, cut into runs of about ``chars`` characters; with the texts as a list."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        start = held = 0
        for i, text in enumerate(texts):
            held += len(text) if text else 0
            if held >= chars:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, held = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def sampled(df: DataFrame, label: str, per_label: int, text: str = "text") -> DataFrame:
    """At most ``per_label`` distinct texts of each label, chosen by the hash of the text; a bounded sample for training.

    The first pass keeps the smallest hash of each (label, hash modulo ``per_label``), so the rows that
    leave a task are bounded and copies count once; the second fetches those texts.
    """
    hashed = df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(label, text, F.xxhash64(text).alias("_h"))
    picks = hashed.groupBy(label, F.pmod("_h", F.lit(per_label)).alias("_b")).agg(F.min("_h").alias("_h")).select(F.col(label).alias("_l"), F.col("_h").alias("_p"))
    joined = hashed.join(F.broadcast(picks), (F.col(label) == F.col("_l")) & (F.col("_h") == F.col("_p"))).select(label, text, "_h")
    return joined.groupBy(label, "_h").agg(F.min(text).alias(text)).orderBy(label, "_h")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int, max_chars: int = 50_000, id_col: str = "doc_id", text: str = "text") -> tuple[list[str], list[int], dict[int, int]]:
    """Texts and 0/1 labels of at most ``per_label`` training documents of each label, and how many rows have each label.

    Held-out documents, null labels and, for training only, texts over ``max_chars`` are passed over before the documents
    are chosen, by the hash of their ids; so at most ``2 * per_label`` ids are broadcast to fetch their texts.
    """
    usable = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(id_col))).select(F.col(label).cast("int").alias("_y"), F.col(id_col).alias("_id"), F.xxhash64(id_col).alias("_h"))
    counts = {r["_y"]: r["n"] for r in usable.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    usable = usable.join(docs.where(F.length(text) <= max_chars).select(F.col(id_col).alias("_id")), "_id", "left_semi")
    picks = usable.groupBy("_y", F.pmod("_h", F.lit(per_label)).alias("_b")).agg(F.min(F.struct("_h", "_id")).alias("_m")).select("_y", F.col("_m._id").alias("_id"))
    found = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t")).where(F.length("_t") <= max_chars).join(F.broadcast(picks), "_id")
    rows = found.groupBy("_id", "_y").agg(F.min("_t").alias("_t")).orderBy("_y", "_id").collect()
    return [r["_t"] for r in rows], [r["_y"] for r in rows], counts


def keep_rows(docs: DataFrame, model, keep, text: str = "text") -> DataFrame:
    """The rows, with all their columns, for which ``keep(model, texts)`` is true; decided where they are read, without a join.

    Each row is judged by its own text, so repeated rows and ids stay or go together; ``keep`` gets null and empty texts too, and very
    long ones whole. Columns may have any names, as only the text's is looked up. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    order = [text, *[c for c in docs.columns if c != text]]
    ordered = docs.select(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            start = 0
            for part, texts in text_runs(b.select([0, 0]) for b in (batch,)):
                mask = pa.array([bool(x) for x in keep(model, texts)], pa.bool_())
                yield batch.slice(start, part.num_rows).filter(mask)
                start += part.num_rows

    return ordered.mapInArrow(run, ordered.schema).select(*docs.columns)

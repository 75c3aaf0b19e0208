"""The corpus pipeline: quality, toxicity, near duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. The first four return the columns of their input; rows that they reject are gone. Models are fitted
on the labelled documents of the corpus itself, within the bounds that their operators state.

In all stages repeated rows are judged each by itself and stay or go together (near duplicates keep all rows of the id that
stays), null ids are judged as others, very long texts are taken whole, columns may have any other names, and an empty
table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from urbanloom.llm import byte_bpe, decontamination, jaccard_join, quality, toxicity
from urbanloom.llm.common import keep_rows, shared_dir

QUALITY_LIMIT, TOXIC_LIMIT = 0.7, 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7 stay, a tie at 0.7 with them. Null and empty texts are scored as one empty line. Without labels of both kinds all score 0.5 and go."""
    field = quality.train(docs, _table(spark, sf_dir, "labels"))
    return keep_rows(docs, field, lambda field, texts: field.score(texts) >= QUALITY_LIMIT)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of any toxic grade is under 0.5 stay. Null, empty and wordless texts stay; without labels of both kinds all do."""
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return keep_rows(docs, model, lambda model, texts: model.above(texts)[:, 0] < TOXIC_LIMIT)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id stays of each group that Jaccard links of 0.8 or more join. Null, empty and wordless texts stay."""
    return jaccard_join.keep_first(docs)


def leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item to the coverage or more go. Null, empty and wordless texts stay; an empty benchmark drops nothing."""
    return decontamination.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, lossless, ids) of every document that is left; null and empty texts have no ids."""
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", duplicates_stage),
    ("decontamination", leaks_stage),
    ("byte_bpe", tokens_stage),
]

#: The fitted models, links and tokens cannot be expressed in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each returns is written to the shared folder and read again by the next."""
    docs = _table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

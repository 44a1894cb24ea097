"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)``; what it returns is written as Parquet and read again
as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import block_naming, near_dedup, pieces, poisson_mix, quality
from earshot.llm.common import documents, stored
from earshot.llm.queries import piece_model


#: Rows in an Arrow batch: whole texts are long, and each task holds several batches.
BATCH_ROWS = 2_000


def small_batches(stage):
    """The stage, with Arrow batches of few rows from now on unless the session asks for fewer."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
            spark.conf.set(name, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below 0.3 go."""
    return quality.drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return block_naming.drop_copies(docs)


@small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word-shingle similarity 0.8 or more stays."""
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources have the same share of the characters."""
    return poisson_mix.poisson_mix(docs).drop("copy", "shuffle_key")


@small_batches
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they decode to."""
    out = pieces.encode_decode(docs, piece_model(), keep=("doc_id", "lang", "source"))
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", reject_poor),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mix sources", mix),
    ("sentencepiece", tokenize),
]

#: The classifier is learned, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

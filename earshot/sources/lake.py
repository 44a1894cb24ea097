"""The date-partitioned event lake, the raw history, and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from earshot.operators.events import with_event_date
from earshot.schemas import PLAY_LOG, conform

LAKE = StructType([*PLAY_LOG.fields, StructField("date_str", DateType(), True)])
_BATCH = StructField("batch_id", StringType(), True)


def read_lake(spark: SparkSession, path: str) -> DataFrame:
    """The lake with its declared schema; filters on ``date_str`` prune folders."""
    return spark.read.schema(StructType([*LAKE.fields, _BATCH])).parquet(path).drop("batch_id")


def write_lake(events: DataFrame, path: str, batch_id: str | None = None) -> None:
    """Add a batch of events to the lake, in folders by date and batch.

    A batch that is written again under its id replaces itself. Rows are dealt by date, and
    adaptive execution splits large dates by their size, so that a busy day is written by as many
    tasks as it needs and a quiet one to one file.
    """
    dated = with_event_date(events).drop("event_time").hint("rebalance", "date_str")
    (
        dated.withColumn("batch_id", F.lit(batch_id or f"load-{uuid.uuid4().hex}"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date_str", "batch_id")
        .parquet(path)
    )


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files of a folder; names starting with ``_`` or ``.`` are skipped."""
    return spark.read.parquet(path)


def sort_history(history: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Global time order over many partitions: written out, the files follow each other.

    The other columns break ties, so that rows of one moment can be split too.
    """
    order = [ts, *(c for c in history.columns if c != ts)]
    return history.repartitionByRange(*order).sortWithinPartitions(*order)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_table(df: DataFrame, path: str, schema: StructType, mode: str = "overwrite") -> None:
    """Parquet with exactly the given columns and types."""
    conform(df, schema).write.mode(mode).parquet(path)

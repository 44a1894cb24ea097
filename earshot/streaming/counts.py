"""Play counts from the event stream, each event counted once.

A micro-batch writes its counts into a folder named by its batch id. A replayed batch
overwrites its own folder, so nothing is added twice; a late event counts when it comes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from earshot.operators.counts import play_counts

EVERY_15_MINUTES = {"processingTime": "15 minutes"}


def write_deltas(batch: DataFrame, batch_id: int, target: str) -> None:
    play_counts(batch).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")


def count_stream(
    events: DataFrame, target: str, ckpt: str, trigger: dict | None = None
) -> StreamingQuery:
    return (
        events.writeStream.foreachBatch(lambda df, i: write_deltas(df, i, target))
        .option("checkpointLocation", ckpt)
        .trigger(**(trigger or EVERY_15_MINUTES))
        .start()
    )


def read_counts(
    spark: SparkSession, target: str, after: int = -1, upto: int | None = None
) -> DataFrame:
    """Plays per track of the batches after ``after``, for adding to the song counters.

    The batch id is a partition, so folders already added are not read again.
    """
    schema = "track_id string, plays long, batch_id long"
    deltas = spark.read.schema(schema).parquet(target).filter(F.col("batch_id") > after)
    if upto is not None:
        deltas = deltas.filter(F.col("batch_id") <= upto)
    return deltas.groupBy("track_id").agg(F.sum("plays").alias("plays"))

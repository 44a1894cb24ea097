"""Event stream to lake: parse, validate, date, land; bad events go to quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from earshot.operators.events import check_events, parse_events
from earshot.schemas import PLAY_LOG
from earshot.sources.lake import write_lake

# Start at the newest events and keep running when the broker has dropped old ones.
KAFKA_DEFAULTS = {"startingOffsets": "latest", "failOnDataLoss": "false"}
EVERY_MINUTE = {"processingTime": "1 minute"}


def read_event_stream(spark: SparkSession, fmt: str = "kafka", **opts: str) -> DataFrame:
    """The raw event stream: a ``value`` payload per event.

    ``fmt="kafka"`` takes ``kafka.bootstrap.servers`` and ``subscribe``. ``fmt="text"``
    reads files of JSON lines from ``path``.
    """
    if fmt == "kafka":
        opts = {**KAFKA_DEFAULTS, **opts}
    return spark.readStream.format(fmt).options(**opts).load()


def drop_repeats(checked: DataFrame, delay: str) -> DataFrame:
    """Optional: forget events sent twice within ``delay`` of event time; rejects all stay."""
    key = F.concat_ws("|", "user_id", "track_id", F.col("timestamp").cast("string"))
    own = F.when(F.col("reason").isNull(), key).otherwise(F.uuid())
    return (
        checked.withColumn("event_time", F.timestamp_millis("timestamp"))
        .withColumn("_key", own)
        .withWatermark("event_time", delay)
        .dropDuplicatesWithinWatermark(["_key"])
        .drop("event_time", "_key")
    )


def land(payloads: DataFrame, dedupe_within: str | None = None) -> DataFrame:
    """Checked events of a payload stream; ``reason`` is null for those that the lake takes."""
    arrival = F.unix_millis(F.current_timestamp())
    checked = check_events(parse_events(payloads), arrival).drop("_malformed")
    return checked if dedupe_within is None else drop_repeats(checked, dedupe_within)


def write_batch(
    batch: DataFrame, batch_id: int, path: str, quarantine: str, stream: str = "stream"
) -> None:
    """Write one micro-batch to the lake and to quarantine; a replay replaces what it wrote.

    Batch ids start at 0 with every checkpoint, so ``stream`` must differ between checkpoints that
    write to the same folders, and stay the same for one.
    """
    batch = batch.persist()
    valid = batch.filter(F.col("reason").isNull()).select(*PLAY_LOG.fieldNames())
    write_lake(valid, path, f"{stream}-{batch_id}")
    rejected = batch.filter(F.col("reason").isNotNull()).select("payload", "reason")
    rejected.write.mode("overwrite").parquet(f"{quarantine}/batch_id={stream}-{batch_id}")
    batch.unpersist()


def _stream_name(batch: DataFrame) -> str:
    """The running query's id, which Spark keeps in its checkpoint: a new one has a new id."""
    name = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not name:
        raise RuntimeError("a micro-batch without the id of its query")
    return f"stream-{name}"


def ingest_stream(
    payloads: DataFrame,
    path: str,
    quarantine: str,
    ckpt: str,
    trigger: dict | None = None,
    dedupe_within: str | None = None,
) -> StreamingQuery:
    """Start the one query that reads the events once and lands both kinds.

    Lake and quarantine see the same events from the same starting point. Each micro-batch is
    written under its checkpoint's and its own id, so that one which is replayed replaces itself,
    and streams with different checkpoints can share a lake.
    """
    return (
        land(payloads, dedupe_within)
        .writeStream.foreachBatch(lambda df, i: write_batch(df, i, path, quarantine, _stream_name(df)))
        .option("checkpointLocation", ckpt)
        .trigger(**(trigger or EVERY_MINUTE))
        .start()
    )

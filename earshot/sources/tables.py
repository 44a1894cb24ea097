"""Published tables: a new folder per version, and a log that names the current one.

A merge reads the current version and writes the next one, so no job overwrites what it
or another job is reading. A version counts only once its log file is there: a job that
dies before that leaves the table as it was. A log file is created once, so two writers get two
versions, and a writer that names the version it has read learns that another came first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.schemas import VECTORS, conform
from earshot.sources import commits
from earshot.sources.commits import Conflict

_DELTAS = "job_name string, after long, upto long, path string"
_MARKS = "job_name string, last_timestamp long"
#: Times that an update is made anew because another writer came first.
TRIES = 50


def _log(spark: SparkSession, root: str, folder: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{root}/{folder}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def log_folder(root: str) -> str:
    return f"{root}/_versions"


def current_version(spark: SparkSession, root: str) -> int:
    """The newest published version, 0 when there is none."""
    return commits.newest(spark, log_folder(root))


def read_entry(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """What the log says of a version, the newest unless one is given; empty before the first."""
    version = current_version(spark, root) if version is None else version
    return commits.entry(spark, log_folder(root), version) if version else {}


def publish(
    df: DataFrame,
    root: str,
    version: int | None = None,
    marks: dict[str, int] | None = None,
    base: int | None = None,
    partition_by: Sequence[str] = (),
) -> int:
    """Write ``df`` as the next version and make it current.

    Publishing a given version again replaces its data and changes nothing else, so a
    repeated job is harmless. ``marks`` says how far each job's work is in this version; the same
    log file commits both. Marks not given carry over from the version before. ``base`` is the version
    that ``df`` was made from: if it is no longer the newest, ``Conflict`` is raised.
    """
    spark, log = df.sparkSession, log_folder(root)
    path = f"{root}/data-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    while True:
        newest = current_version(spark, root)
        number = newest + 1 if version is None else version
        if number <= newest and version is not None:
            known = commits.entry(spark, log, number)
            commits.commit(spark, log, number, known | {"path": path}, replace=True)
            return number
        if base is not None and newest != base:
            raise Conflict(f"{root}: version {newest} came after {base}")
        known = read_marks(spark, root, newest) | (marks or {})
        if commits.commit(spark, log, number, {"path": path, "marks": known}):
            return number


def update(
    spark: SparkSession,
    root: str,
    change: Callable[[DataFrame], DataFrame],
    marks: dict[str, int] | None = None,
) -> int:
    """Publish ``change`` of the current version; anew on the newer one if another writer came first."""
    for _ in range(TRIES):
        base = current_version(spark, root)
        try:
            return publish(change(read_table(spark, root, base)), root, marks=marks, base=base)
        except Conflict:
            continue
    raise Conflict(f"{root}: {TRIES} times another writer came first")


def read_marks(spark: SparkSession, root: str, version: int | None = None) -> dict[str, int]:
    """How far each job's work is in a version, the current one unless given."""
    return read_entry(spark, root, version).get("marks", {})


def read_table(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    known = read_entry(spark, root, version)
    if not known:
        raise FileNotFoundError(f"no version published under {root}")
    return spark.read.parquet(known["path"])


def read_mark(spark: SparkSession, root: str, job: str) -> int:
    """The job's high-water mark in epoch milliseconds, 0 before its first run."""
    marks = _log(spark, root, "_marks", _MARKS).filter(F.col("job_name") == job)
    return marks.agg(F.max("last_timestamp")).first()[0] or 0


def advance_mark(spark: SparkSession, root: str, job: str, last_timestamp: int) -> None:
    """Append the new mark; marks only grow, so the largest one counts."""
    row = spark.createDataFrame([(job, last_timestamp)], _MARKS)
    row.coalesce(1).write.mode("append").parquet(f"{root}/_marks")


def append_delta(df: DataFrame, root: str, job: str, after: int, upto: int) -> None:
    """Keep what a job found in the range ``(after, upto]``; its log row is data and mark in one.

    A job that dies before the row is written has changed nothing: its folder is not read, and
    the next run covers the range again.
    """
    spark, path = df.sparkSession, f"{root}/deltas/{job}-{after}-{upto}"
    df.write.mode("overwrite").parquet(path)
    row = spark.createDataFrame([(job, after, upto, path)], _DELTAS)
    row.coalesce(1).write.mode("append").parquet(f"{root}/_deltas")


def delta_mark(spark: SparkSession, root: str, job: str) -> int:
    """The end of the job's last kept range, 0 before the first."""
    log = _log(spark, root, "_deltas", _DELTAS).filter(F.col("job_name") == job)
    return log.agg(F.max("upto")).first()[0] or 0


def read_deltas(spark: SparkSession, root: str, job: str, after: int = 0) -> DataFrame | None:
    """All that the job kept beyond ``after``, or None."""
    log = _log(spark, root, "_deltas", _DELTAS).filter(F.col("job_name") == job)
    paths = [r["path"] for r in log.filter(F.col("after") >= after).select("path").distinct().collect()]
    return spark.read.parquet(*paths) if paths else None


def checked_vectors(df: DataFrame, dim: int) -> DataFrame:
    """Vectors in the declared schema; a wrong length or a repeated id fails the job."""
    size = F.size("embedding")
    ok = F.col("id").isNotNull() & F.col("embedding").isNotNull() & (size == dim)
    checked = conform(df, VECTORS).select(
        "id",
        F.when(ok, F.col("embedding"))
        .otherwise(F.raise_error(F.lit(f"vector without id or not of length {dim}")).cast("array<float>"))
        .alias("embedding"),
    )
    grouped = checked.groupBy("id").agg(
        F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("_n")
    )
    single = F.when(F.col("_n") == 1, F.col("embedding")).otherwise(
        F.raise_error(F.concat(F.lit("repeated vector id "), F.col("id"))).cast("array<float>")
    )
    return grouped.select("id", single.alias("embedding"))


def load_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    return checked_vectors(spark.read.parquet(path), dim)


def write_vectors(df: DataFrame, root: str, dim: int, version: int | None = None) -> int:
    """Replace the vector table, written by executors."""
    return publish(checked_vectors(df, dim), root, version)


def append_vectors(new: DataFrame, existing: DataFrame, dim: int) -> DataFrame:
    """The vector table with the vectors added whose ids it lacks; a wrong length fails the job."""
    missing = new.select("id", "embedding").join(existing.select("id"), "id", "left_anti")
    return checked_vectors(existing.select("id", "embedding").unionByName(missing), dim)

"""Plays per track and day, kept as a table, and the trailing counts that follow from them.

The lake's folders tell which days have changed since the last version: only these are read again.
Yesterday's trailing counts become today's by adding the days that came, taking away those that left,
and replacing those that late events have changed.
"""

from __future__ import annotations

import hashlib
import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.operators.events import plays
from earshot.sources import commits
from earshot.sources.lake import read_lake
from earshot.sources.tables import TRIES, current_version, log_folder, read_entry

_DAY = "track_id string, plays long"


def day_marks(spark: SparkSession, lake: str, days: list[date]) -> dict[str, str]:
    """A fingerprint of the files of each day that the lake has: names, lengths and times of change.

    Only folders are listed, in the way of any scan; no data is read.
    """
    jvm, out = spark.sparkContext._jvm, {}
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for day in days:
        place = jvm.org.apache.hadoop.fs.Path(f"{lake}/date_str={day}")
        fs = place.getFileSystem(conf)
        if not fs.exists(place):
            continue
        files, seen = fs.listFiles(place, True), []
        while files.hasNext():
            f = files.next()
            if not f.getPath().getName().startswith(("_", ".")):
                seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
        out[str(day)] = hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()
    return out


def _read(spark: SparkSession, path: str | None) -> DataFrame:
    return spark.read.schema(_DAY).parquet(path) if path else spark.createDataFrame([], _DAY)


def refresh(spark: SparkSession, lake: str, root: str, as_of: date, days: int = 7) -> list[date]:
    """Publish the trailing counts of the ``days`` full days before ``as_of`` and of that day.

    Returns the days that were read from the lake: those of the window that are new or whose files
    have changed, by late events or a repeated load. A version names the counts of each day of the
    window and the trailing counts, so a run that dies changes nothing. If another writer comes first,
    the work is made anew on its version.
    """
    window = [as_of - timedelta(days=i) for i in range(days, -1, -1)]
    for _ in range(TRIES):
        base = current_version(spark, root)
        known = read_entry(spark, root, base)
        old = known.get("days", {})
        marks = day_marks(spark, lake, window)
        changed = [d for d in window if marks.get(str(d)) != old.get(str(d), {}).get("mark")]
        now = {str(d): old[str(d)] for d in window if str(d) in old and d not in changed}
        now |= _count(spark, lake, root, [d for d in changed if str(d) in marks], marks)
        trailing = _advance(spark, root, known.get("trailing"), old, now)
        entry = {"days": now, "trailing": trailing, "as_of": str(as_of), "marks": {}}
        if commits.commit(spark, log_folder(root), base + 1, entry):
            return changed
    raise commits.Conflict(f"{root}: {TRIES} times another writer came first")


def _count(spark: SparkSession, lake: str, root: str, days: list[date], marks: dict) -> dict[str, dict]:
    """Count the plays of some days; only their folders are read."""
    if not days:
        return {}
    path = f"{root}/days-{uuid.uuid4().hex}"
    log = read_lake(spark, lake).filter(F.col("date_str").isin(days))
    counts = plays(log).groupBy("track_id", F.col("date_str").cast("string").alias("day"))
    counts = counts.agg(F.count(F.lit(1)).alias("plays")).select("track_id", "plays", "day")
    counts.hint("rebalance", "day").write.partitionBy("day").parquet(path)
    found = {f.rsplit("=", 1)[1]: f for f in commits.listed(spark, path) if "/day=" in f}
    return {str(d): {"mark": marks[str(d)], "path": found.get(str(d))} for d in days}


def _advance(spark: SparkSession, root: str, trailing: str | None, old: dict, now: dict) -> str:
    """The trailing counts of the days ``now``, from those of the days ``old``."""
    parts = [_read(spark, trailing)]
    for day in sorted(set(old) | set(now)):
        was, then = old.get(day, {}).get("path"), now.get(day, {}).get("path")
        if was == then:
            continue
        if was:
            parts.append(_read(spark, was).withColumn("plays", -F.col("plays")))
        if then:
            parts.append(_read(spark, then))
    if trailing and len(parts) == 1:
        return trailing
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    path = f"{root}/trailing-{uuid.uuid4().hex}"
    summed = both.groupBy("track_id").agg(F.sum("plays").alias("plays"))
    summed.filter("plays <> 0").write.parquet(path)
    return path


def read_trailing(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """``(track_id, plays)`` of a version, the newest unless one is given."""
    known = read_entry(spark, root, version)
    if "trailing" not in known:
        raise FileNotFoundError(f"no trailing counts under {root}")
    return _read(spark, known["trailing"])

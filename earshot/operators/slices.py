"""Ordered per-key work, split into time slices so that no key needs one task.

A window over a whole key puts that key's rows into one task, however many there are.
Here rows are grouped by key *and* time slice. What a slice needs from its neighbours is
carried by a summary of one row per key and slice, built with partial aggregation; only
the summary is windowed by key, so its size follows elapsed time, not event volume.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from earshot.functions.time import bucket_of


# Width of a slice. One busy key over months of events then spreads over some hundred
# thousand groups, while an ordinary key has about one row per slice.
SLICE_MS = 60_000


def with_slice(df: DataFrame, ts: str, width_ms: int) -> DataFrame:
    return df.withColumn("_slice", bucket_of(F.col(ts), width_ms))


def summarise(df: DataFrame, key: str, aggs: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(key, "_slice").agg(*[c.alias(n) for n, c in aggs.items()])


def by_slice(*keys: str) -> WindowSpec:
    """Order of the slices of one key, for windows over a summary."""
    return Window.partitionBy(*keys).orderBy("_slice")


def all_slices(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


def in_slice(key: str, *order: Column | str) -> WindowSpec:
    """Order of the rows inside one slice."""
    return Window.partitionBy(key, "_slice").orderBy(*order)


def before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def upto(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, 0)


def after(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(1, Window.unboundedFollowing)


def attach(rows: DataFrame, summary: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    return rows.join(summary.select(key, "_slice", *cols), [key, "_slice"])

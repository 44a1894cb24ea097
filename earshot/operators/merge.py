"""Keyed merges, deletes and look-ups on plain tables.

A merge returns the new table as a frame; `earshot.sources.tables` publishes it as a
new version, so the version being read is never overwritten.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _latest(updates: DataFrame, key: str, cols: Sequence[str], order: Column | None) -> DataFrame:
    """One update per key: the last in ``order``, ties to the greatest values.

    An aggregate, not a window: copies of a hot key shrink before the shuffle.
    """
    row = F.struct(*[F.col(c) for c in cols])
    rank = F.struct((F.lit(0) if order is None else order).alias("o"), row.alias("r"))
    picked = updates.groupBy(key).agg(F.max(rank).alias("_last"))
    return picked.select(key, *[F.col("_last.r")[c].alias(f"_new_{c}") for c in cols])


def merge_set(
    target: DataFrame,
    updates: DataFrame,
    key: str,
    cols: Sequence[str],
    skip_null: Iterable[str] = (),
    order: Column | None = None,
) -> DataFrame:
    """Upsert by key that sets only ``cols`` and leaves every other column alone.

    A key without a row is created with nulls elsewhere. A null update overwrites,
    except in the ``skip_null`` columns.
    """
    keep_old = set(skip_null)
    fresh = _latest(updates, key, cols, order).withColumn("_hit", F.lit(True))
    joined = target.withColumn("_had", F.lit(True)).join(fresh, key, "full_outer")
    kinds = {f.name: f.dataType for f in target.schema.fields}
    out = []
    for name in dict.fromkeys([*target.columns, *cols]):
        if name == key or name not in cols:
            out.append(F.col(name))
            continue
        new = F.col(f"_new_{name}")
        if name not in kinds:
            out.append(new.alias(name))
            continue
        new = new.cast(kinds[name])
        if name in keep_old:
            out.append(F.coalesce(new, F.col(name)).alias(name))
        else:
            hit = F.coalesce(F.col("_hit"), F.lit(False))
            out.append(F.when(hit, new).otherwise(F.col(name)).alias(name))
    return joined.select(*out)


def merge_inc(target: DataFrame, deltas: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Upsert by key that adds to counters; a missing counter counts from 0.

    Repeated keys in ``deltas`` are summed first, before the shuffle.
    """
    sums = deltas.groupBy(key).agg(*[F.sum(c).alias(f"_add_{c}") for c in cols])
    joined = target.join(sums, key, "full_outer")
    kinds = {f.name: f.dataType for f in target.schema.fields}
    out = []
    for name in target.columns:
        if name in cols:
            old, add = F.coalesce(F.col(name), F.lit(0)), F.col(f"_add_{name}")
            total = F.when(add.isNull(), F.col(name)).otherwise(old + add)
            out.append(total.cast(kinds[name]).alias(name))
        else:
            out.append(F.col(name))
    return joined.select(*out)


def cascade_delete(keys: DataFrame, *tables: tuple[DataFrame, str]) -> tuple[DataFrame, ...]:
    """Remove ``keys`` (its first column) from every ``(table, key column)``."""
    name = keys.columns[0]
    out = []
    for table, key in tables:
        gone = keys.select(F.col(name).alias(key))
        out.append(table.join(gone, key, "left_anti"))
    return tuple(out)


def lookup(df: DataFrame, ids: DataFrame | str, key: str = "_id") -> DataFrame:
    """Rows of one id (pushed down to the scan) or of a table of ids (semi join)."""
    if isinstance(ids, str):
        return df.filter(F.col(key) == ids)
    return keep_known(df, ids.select(F.col(ids.columns[0]).alias(key)), key)


def keep_known(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def missing_vectors(songs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Songs that have no vector yet."""
    return songs.join(vectors.select(F.col("id").alias("_id")), "_id", "left_anti")


def profile_table(df: DataFrame) -> DataFrame:
    """One row per column: its type, how many rows have a value, and the row count.

    One pass over the data. The type is ``Null`` for a column without any value,
    ``Array`` or ``Object`` for nested ones.
    """
    named = {"array": "Array", "struct": "Object", "map": "Object"}
    fields = df.schema.fields
    once = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(F.col(f"`{f.name}`")).alias(f"_n{i}") for i, f in enumerate(fields)],
    )
    rows = [
        F.struct(
            F.lit(f.name).alias("field"),
            F.when(F.col(f"_n{i}") == 0, "Null")
            .otherwise(named.get(f.dataType.typeName(), f.dataType.simpleString()))
            .alias("type"),
            F.col(f"_n{i}").alias("n_values"),
        )
        for i, f in enumerate(fields)
    ]
    return once.select("n_rows", F.inline(F.array(*rows)))


def preview(df: DataFrame, n: int, key: str = "_id") -> DataFrame:
    """The first ``n`` rows by key."""
    return df.orderBy(key).limit(n)

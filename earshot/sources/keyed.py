"""Keyed tables in buckets of a key's hash: an update rewrites only the buckets that it hits.

The log of such a table names one folder for each bucket. A new version shares the folders of all
buckets that it does not change with the version before, so an update costs what it touches, not
the table. Writers that hit different buckets do not disturb each other; of two that hit the same,
the later one is made anew on top of the first.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from earshot.session import cut
from earshot.sources import commits
from earshot.sources.commits import Conflict
from earshot.sources.tables import TRIES, current_version, log_folder, read_entry

#: The driver holds one path and one small number for each bucket.
MAX_BUCKETS = 65_536


def _bucket(key: Column, kind: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast(kind)), F.lit(buckets)).cast("int")


def _kind(schema: StructType, key: str) -> str:
    return schema[key].dataType.simpleString()


def _write(df: DataFrame, root: str, key: str, buckets: int) -> dict[str, str]:
    """The folder of every bucket that ``df`` has rows in; large buckets become several files."""
    path = f"{root}/data-{uuid.uuid4().hex}"
    placed = df.withColumn("_bucket", _bucket(F.col(key), _kind(df.schema, key), buckets))
    placed.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(path)
    folders = (f for f in commits.listed(df.sparkSession, path) if "/_bucket=" in f)
    return {f.rsplit("=", 1)[1]: f for f in folders}


def _entry(df: DataFrame, key: str, buckets: int, files: dict[str, str], marks: dict) -> dict:
    return {"key": key, "buckets": buckets, "schema": df.schema.json(), "files": files, "marks": marks}


def create_keyed(
    df: DataFrame, root: str, key: str, buckets: int = 64, marks: dict[str, int] | None = None
) -> int:
    """Publish ``df`` as the first version of a keyed table, or as a whole new version of one."""
    if not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"{buckets} buckets")
    spark = df.sparkSession
    files = _write(df, root, key, buckets)
    while True:
        version = current_version(spark, root)
        known = read_entry(spark, root, version).get("marks", {}) | (marks or {})
        if commits.commit(spark, log_folder(root), version + 1, _entry(df, key, buckets, files, known)):
            return version + 1


def _read(spark: SparkSession, known: dict, only: set[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(known["schema"]))
    paths = [p for b, p in sorted(known["files"].items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _known(spark: SparkSession, root: str, version: int | None = None) -> dict:
    known = read_entry(spark, root, version)
    if "files" not in known:
        raise FileNotFoundError(f"no keyed table published under {root}")
    return known


def is_keyed(spark: SparkSession, root: str, version: int | None = None) -> bool:
    return "files" in read_entry(spark, root, version)


def _hit(keys: DataFrame, known: dict) -> set[str]:
    """The buckets of a table of keys: no more than there are buckets."""
    schema = StructType.fromJson(json.loads(known["schema"]))
    place = _bucket(F.col(known["key"]), _kind(schema, known["key"]), known["buckets"])
    return {str(r[0]) for r in keys.select(place.alias("b")).distinct().collect()}


def read_keyed(
    spark: SparkSession, root: str, keys: DataFrame | None = None, version: int | None = None
) -> DataFrame:
    """The table, or the rows of ``keys`` (a column named as the key) from the buckets that can hold them."""
    known = _known(spark, root, version)
    if keys is None:
        return _read(spark, known)
    wanted = keys.select(known["key"]).distinct()
    return _read(spark, known, _hit(wanted, known)).join(wanted, known["key"], "left_semi")


def update_keyed(
    changes: DataFrame,
    root: str,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    marks: dict[str, int] | None = None,
    base: int | None = None,
) -> int:
    """Publish ``merge(rows, changes)``, where rows are those of the buckets that ``changes`` hits.

    ``changes`` has a column named as the table's key, and ``merge`` returns what its buckets hold from
    now on: `merge_set`, `merge_inc`, an anti join. It may add columns, which are null in the other
    buckets, and must make no key that ``changes`` does not have. A job that dies leaves the old version.
    Changes without a row publish no version, unless there are marks to keep. With ``base``, the
    version that ``changes`` were made for, any other writer's version in between raises ``Conflict``.
    """
    spark, log = changes.sparkSession, log_folder(root)
    changes, fixed = cut(changes), base is not None
    base = current_version(spark, root) if base is None else base
    for _ in range(TRIES):
        known = _known(spark, root, base)
        hit = _hit(changes, known)
        if not hit and not marks:
            return base
        made = merge(_read(spark, known, hit), changes)
        files = _write(made, root, known["key"], known["buckets"])
        if not set(files) <= hit:
            raise ValueError("a merge made keys of other buckets than its changes")
        while True:
            newest = current_version(spark, root)
            if fixed and newest != base:
                raise Conflict(f"{root}: version {newest} came after {base}")
            now = known if newest == base else _known(spark, root, newest)
            if any(now["files"].get(b) != known["files"].get(b) for b in hit) or any(
                now[k] != known[k] for k in ("key", "buckets", "schema")
            ):
                base = newest
                break
            kept = {b: p for b, p in now["files"].items() if b not in hit} | files
            content = _entry(made, now["key"], now["buckets"], kept, now["marks"] | (marks or {}))
            if commits.commit(spark, log, newest + 1, content):
                return newest + 1
    raise Conflict(f"{root}: {TRIES} times another writer came first")


def delete_keyed(keys: DataFrame, root: str) -> int:
    """Publish the table without the rows of ``keys``, a column named as the key."""
    key = _known(keys.sparkSession, root)["key"]
    return update_keyed(
        keys.select(key).distinct(), root, lambda rows, gone: rows.join(gone, key, "left_anti")
    )

"""Version logs: one small JSON file for each version, which only one writer can create."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has published a version in between."""


def _at(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return context._jvm, place, place.getFileSystem(context._jsc.hadoopConfiguration())


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The full paths of what a folder holds, none if it is not there."""
    _, place, fs = _at(spark, folder)
    return sorted(f.getPath().toString() for f in fs.listStatus(place)) if fs.exists(place) else []


def newest(spark: SparkSession, folder: str) -> int:
    """The greatest version in a log, 0 in an empty one."""
    names = (path.rsplit("/", 1)[1] for path in listed(spark, folder))
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)


def _file(folder: str, version: int) -> str:
    return f"{folder.rstrip('/')}/{version:012d}.json"


def entry(spark: SparkSession, folder: str, version: int) -> dict:
    jvm, place, fs = _at(spark, _file(folder, version))
    stream = fs.open(place)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, folder: str, version: int, content: dict, replace: bool = False) -> bool:
    """Create the version's log file; False if it is there already.

    The file is written under another name first, so that no reader sees a part of it, and then
    gets its name: by a hard link on a local disk, by a rename that refuses to replace elsewhere.
    """
    jvm, place, fs = _at(spark, _file(folder, version))
    context = spark.sparkContext
    fs.mkdirs(place.getParent())
    text, mine = json.dumps(content, sort_keys=True), f"{folder.rstrip('/')}/_{uuid.uuid4().hex}"
    if fs.getUri().getScheme() == "file":
        _, draft, _ = _at(spark, mine)
        draft, final = draft.toUri().getPath(), place.toUri().getPath()
        with open(draft, "x", encoding="utf-8") as file:
            file.write(text)
        if replace:
            os.replace(draft, final)
            return True
        try:
            os.link(draft, final)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    _, draft, _ = _at(spark, mine)
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = context._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if replace else rename.NONE
    names = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
    try:
        names.rename(draft, place, how)
    except Exception:
        fs.delete(draft, False)
        if not replace and fs.exists(place):
            return False
        raise
    return True

"""Lenient loading of JSON-lines master files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from earshot.operators.catalogue import resolve_id
from earshot.schemas import conform

SONG_IDS = ("id", "_id")
USER_IDS = ("user_id", "_id", "id")


def read_master_jsonl(
    spark: SparkSession, path: str, schema: StructType, ids: tuple[str, ...] = SONG_IDS
) -> tuple[DataFrame, DataFrame]:
    """``(good, rejected)`` rows of a JSON-lines file.

    Blank lines are ignored. A line that is no JSON object, or has no id, is rejected with
    its text and a ``reason``. Scalars are read as text and cast to the schema, so numbers
    exported as text come back as numbers. The id is the first non-empty of ``ids``.
    """
    nested = ("array", "struct", "map")
    typed = {
        f.name: f.dataType.simpleString() if f.dataType.typeName() in nested else "string"
        for f in schema.fields
    }
    fields = {**{i: "string" for i in ids}, **typed, "_corrupt": "string"}
    ddl = ", ".join(f"`{name}` {kind}" for name, kind in fields.items())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    # Read as text first: the raw line is then at hand for a rejected row.
    lines = spark.read.text(path).filter(F.btrim("value", F.lit(" \t\r")) != "")
    parsed = lines.select(F.col("value").alias("line"), F.from_json("value", ddl, options).alias("r"))
    has_id = F.coalesce(*[F.nullif(F.col(f"r.{i}"), F.lit("")) for i in ids]).isNotNull()
    broken = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    reason = F.when(broken, "malformed").when(~has_id, "id missing")
    judged = parsed.withColumn("reason", reason)
    rejected = judged.filter(F.col("reason").isNotNull()).select("line", "reason")
    good = judged.filter(F.col("reason").isNull()).select("r.*").drop("_corrupt")
    return conform(resolve_id(good, *ids), schema), rejected

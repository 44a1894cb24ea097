"""Declared table schemas, value domains, and casting a frame to a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# The event vocabulary shared with every producer of play events.
ACTIONS = ("listen", "skip", "complete")
SOURCES = ("real_user", "simulation")
PLAY_ACTIONS = ("listen", "complete")

# Vector widths and the song length assumed when none is known.
ITEM_DIM = 64
CONTENT_DIM = 384
DEFAULT_DURATION = 300.0


def _struct(*fields: tuple[str, DataType]) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


VECTOR = ArrayType(FloatType())

PLAY_LOG = _struct(
    ("user_id", StringType()),
    ("track_id", StringType()),
    ("timestamp", LongType()),
    ("action", StringType()),
    ("source", StringType()),
    ("duration", DoubleType()),
    ("total_duration", DoubleType()),
)

SONGS = _struct(
    ("_id", StringType()),
    ("track_name", StringType()),
    ("artist_id", StringType()),
    ("artist_name", StringType()),
    ("image_url", StringType()),
    ("url", StringType()),
    ("duration", DoubleType()),
    ("plays_7d", IntegerType()),
    ("plays_cumulative", LongType()),
    ("release_date", DateType()),
    ("lrclib_plain_lyrics", StringType()),
    ("lrclib_synced_lyrics", StringType()),
)

# Columns that lyric enrichment adds to a song.
ENRICHMENT = _struct(
    ("lrclib_id", LongType()),
    ("lrclib_fetched", BooleanType()),
    ("lrclib_not_found", BooleanType()),
    ("release_date_checked", BooleanType()),
)

USERS = _struct(
    ("_id", StringType()),
    ("username", StringType()),
    ("latent_vector", VECTOR),
    ("signup_date", DateType()),
    ("image_url", StringType()),
)

VECTORS = _struct(("id", StringType()), ("embedding", VECTOR))

HISTORY = _struct(
    ("user_id", StringType()),
    ("timestamp", StringType()),
    ("musicbrainz_track_id", StringType()),
    ("track_name", StringType()),
    ("musicbrainz_artist_id", StringType()),
    ("artist_name", StringType()),
)

# What the front end shows of a song or a user.
SONG_SUMMARY = (
    "_id",
    "track_name",
    "artist_name",
    "artist_id",
    "image_url",
    "url",
    "duration",
    "plays_cumulative",
    "plays_7d",
    "release_date",
)
USER_SUMMARY = ("_id", "username", "image_url")


def safe_cast(col: Column | str, kind: DataType | str) -> Column:
    """Cast where an unreadable value becomes null instead of failing the job."""
    col = F.col(col) if isinstance(col, str) else col
    return col.try_cast(kind)


def conform(df: DataFrame, schema: StructType, **constants) -> DataFrame:
    """Select exactly ``schema``: cast what exists, fill ``constants``, null the rest."""
    have = dict(df.dtypes)
    cols = []
    for field in schema.fields:
        if field.name in constants:
            value = constants[field.name]
            col = value if isinstance(value, Column) else F.lit(value)
            col = col.cast(field.dataType)
        elif field.name not in have:
            col = F.lit(None).cast(field.dataType)
        elif have[field.name] == field.dataType.simpleString():
            col = F.col(field.name)
        else:
            col = safe_cast(field.name, field.dataType)
        cols.append(col.alias(field.name))
    return df.select(*cols)

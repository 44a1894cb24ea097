"""Scoring expressions: play scores, play classes, weights, repeatable random keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def action_score(action: Column) -> Column:
    """Implicit rating of one event: a full play counts 1, a partial one half."""
    return F.when(action == "complete", 1.0).when(action == "listen", 0.5).otherwise(0.0)


def safe_ratio(part: Column, total: Column) -> Column:
    return F.when(total > 0, part.cast("double") / total).otherwise(0.0)


def play_class(seconds: Column, total: Column, ended: Column) -> Column:
    """Action of a finished play, or null when it was too short to record."""
    ratio = safe_ratio(seconds, total)
    return (
        F.when(seconds < 2, F.lit(None).cast("string"))
        .when(F.coalesce(ended, F.lit(False)) | (ratio >= 0.9), "complete")
        .when(ratio < 0.5, "skip")
        .otherwise("listen")
    )


def popularity_weight(plays: Column) -> Column:
    return F.ln(F.coalesce(plays, F.lit(0)).cast("double") + 2.0)


def unit_scale(x: Column, low: Column, high: Column) -> Column:
    """Min-max scaling to [0, 1]; a flat list scales to 1."""
    return F.when(high == low, 1.0).otherwise((x - low) / (high - low))


def sample_hash(seed: int, *ids: Column) -> Column:
    """A 32-bit hash of the seed and the ids, equal on every run and every engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[i.cast("string") for i in ids])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def sample_key(hashed: Column, weight: Column) -> Column:
    """Exponential key of a weighted draw without replacement: the smallest keys win."""
    uniform = (hashed + 1) / F.lit(2**32 + 1)
    return -F.ln(uniform) / weight

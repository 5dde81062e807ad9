"""Frames of a signal and segments of a track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def starts(n: Column, frame: int, hop: int, exclusive: bool) -> Column:
    """Frame starts in a signal of n samples; the exclusive rule leaves out a frame that ends with the signal."""
    last = n - frame - (1 if exclusive else 0)
    return F.when(last >= 0, F.sequence(F.lit(0).cast("int"), last.cast("int"), F.lit(hop))).otherwise(F.array().cast("array<int>"))


def frames(signal: Column, frame: int, hop: int, exclusive: bool = False) -> Column:
    """The frames themselves; all have ``frame`` samples."""
    return F.transform(starts(F.size(signal), frame, hop, exclusive), lambda i: F.slice(signal, i + 1, F.lit(frame)))


def minute_segments(tracks: DataFrame, key: str, length: str, every: int = 60, take: int = 10, seed: int = 0, pick=None) -> DataFrame:
    """One sample of ``take`` seconds for each minute: the input columns, segment_num, segment_start.

    A minute with fewer than ``take`` seconds left gives none.  Starts are uniform from the minute's begin to
    ``every - take`` seconds later, or to the track's end less ``take``, and follow from key, segment and seed;
    ``pick(key, segment, width)`` replaces that hash.
    """
    pick = pick or (lambda k, s, width: F.pmod(F.xxhash64(k, s, F.lit(seed)), width.cast("bigint")))
    whole = F.floor(length).cast("int")
    minutes = F.when(whole > 0, F.sequence(F.lit(0), whole - 1, F.lit(every))).otherwise(F.array().cast("array<int>"))
    rows = tracks.select("*", F.explode(minutes).alias("__sec")).where(whole - F.col("__sec") >= take)
    high = F.least(F.col("__sec") + (every - take), whole - take)
    number = (F.col("__sec") / every).cast("int")
    start = F.col("__sec") + pick(F.col(key), number, high - F.col("__sec") + 1)
    return rows.select("*", number.alias("segment_num"), start.cast("int").alias("segment_start")).drop("__sec")

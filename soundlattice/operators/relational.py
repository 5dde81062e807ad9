"""Worklists: unions, distinct keys, exclusion, lookups and batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundlattice.functions import text as T
from soundlattice.session import scratch


def union_by_name(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; columns meet by name, missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_keys(*parts: DataFrame) -> DataFrame:
    """The distinct keys of all parts."""
    return union_by_name(*parts).distinct()


def distinct_on(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, nulls first; null keys are one key.  Rows combine before the shuffle."""
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__row"))
    return first.select("__row.*")


def exclude(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without an equal key in ``done``; a null key equals none, so its row stays."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def lookup(rows: DataFrame, catalogue: DataFrame, keys: list[str], order: list[Column | str], values: list[str], how: str = "left") -> DataFrame:
    """``values`` of the catalogue's first entry for each key; ``how='inner'`` drops rows without one."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = catalogue.withColumn("__nth", nth).where("__nth = 1").select(*keys, *values)
    return rows.join(first, keys, how)


def requeue_incomplete(progress: DataFrame, lists: tuple[str, ...] = ("pri_genres", "sec_genres", "pri_desc")) -> DataFrame:
    """Finished albums of which a list is missing, as work: clean_artist, clean_album."""
    missing = F.lit(False)
    for c in lists:
        missing = missing | T.is_missing(T.load_list(F.col(c)))
    return progress.where(missing).select("artist", "album").withColumnsRenamed({"artist": "clean_artist", "album": "clean_album"})


def worklist(albums: DataFrame, progress: DataFrame, failures: DataFrame, order: list[str]) -> DataFrame:
    """Albums still to do: distinct ones neither done nor failed, and those done incompletely."""
    seen = union_keys(*(d.select(F.col("artist").alias("clean_artist"), F.col("album").alias("clean_album")) for d in (progress, failures)))
    keys = ["clean_artist", "clean_album"]
    fresh = exclude(distinct_on(albums, keys, order), seen, keys).select(*keys)
    return union_by_name(fresh, requeue_incomplete(progress))


def batches(df: DataFrame, value: str, order: str, size: int = 100) -> DataFrame:
    """(batch, items): ordered values in lists of ``size``.

    Positions come from per-range counts, so only one row for each range of ``order`` meets in one task.  Ranges
    are drawn anew each time they are computed, so they are written once.
    """
    path = scratch(df.sparkSession, "ranges")
    ranges = df.select(F.col(value).alias("__value"), F.col(order).alias("__order")).repartitionByRange("__order")
    ranges.withColumn("__part", F.spark_partition_id()).write.parquet(path)
    spread = df.sparkSession.read.parquet(path)
    inside = spread.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy("__order", "__value")))
    counts = spread.groupBy("__part").agg(F.count("*").alias("c"))
    before = counts.select("__part", (F.sum("c").over(Window.orderBy("__part")) - F.col("c")).alias("__before"))
    placed = inside.join(before, "__part").withColumn("__at", F.col("__before") + F.col("__n") - 1)
    lists = placed.groupBy(F.floor(F.col("__at") / size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("__at", "__value"))).alias("l"))
    return lists.select("batch", F.transform("l", lambda s: s["__value"]).alias("items"))


def clean_metadata(tags: DataFrame, required: tuple[str, ...] = ("artist", "title", "album")) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of rows with artist, album_artist, title, album: album artists preferred, keys cleaned.

    Rows lacking a required value can't be joined; they are returned, not lost.
    """
    main = T.album_artist(F.col("artist"), F.col("album_artist"))
    rows = tags.withColumn("artist", main).drop("album_artist")
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in required))
    keyed = rows.where(whole).withColumns({f"clean_{c}": T.process_name(F.col(c)) for c in ("title", "artist", "album")})
    return keyed, rows.where(~whole)

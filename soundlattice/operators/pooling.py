"""Pooling of segments into tracks, and statistics over frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def no_nan(c: Column | str) -> Column:
    """NaN as null: aggregates pass over nulls, not over NaN."""
    return F.nanvl((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(None).cast("double"))


def mean_std_max(c: str, prefix: str, with_max: bool = True) -> list[Column]:
    """Mean, population deviation and maximum."""
    out = [F.avg(c).alias(f"{prefix}_mean"), F.stddev_pop(c).alias(f"{prefix}_std")]
    return out + [F.max(c).alias(f"{prefix}_max")] if with_max else out


def nanmean_nanstd(c: str, prefix: str) -> list[Column]:
    return [F.avg(no_nan(c)).alias(f"{prefix}_mean"), F.stddev_pop(no_nan(c)).alias(f"{prefix}_std")]


def vector_aggregate(vector: str, width: int, function=F.avg) -> Column:
    """An aggregate of each element of vectors of known width: one shuffle, combined before it."""
    return F.array(*(function(F.col(vector)[i].cast("double")) for i in range(width)))


def vector_mean(df: DataFrame, key: str, vector: str, width: int | None = None) -> DataFrame:
    """(key, vector) means of vectors of any one width; a task holds sums, not vectors.  A known ``width`` saves a shuffle."""
    if width is not None:
        return df.groupBy(key).agg(vector_aggregate(vector, width).alias(vector))
    elements = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return elements.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("e")).select(key, F.transform("e", lambda s: s["m"]).alias(vector))


def vector_stats(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """Means, population deviations and maxima of each element over a key's frames."""
    return df.groupBy(key).agg(vector_aggregate(vector, width).alias(f"{vector}_mean"), vector_aggregate(vector, width, F.stddev_pop).alias(f"{vector}_std"), vector_aggregate(vector, width, F.max).alias(f"{vector}_max"))


def pool_segments(df: DataFrame, key: str = "track_path", order: str = "segment_num", scalars: tuple[str, ...] = (), vectors: dict[str, int] | None = None, metadata: tuple[str, ...] = ()) -> DataFrame:
    """A row per track: means of scalars and of vectors, element by element, and the first segment's metadata.

    A NaN in a segment makes its mean NaN.
    """
    return df.groupBy(key).agg(
        *(F.min_by(m, order).alias(m) for m in metadata),
        *(F.avg(F.col(s).cast("double")).alias(s) for s in scalars),
        *(vector_aggregate(v, n).alias(v) for v, n in (vectors or {}).items()),
    )


def metadata_columns(df: DataFrame, num: list[str], dim: list[str], key: str = "filename") -> list[str]:
    """The columns that are no features."""
    return [c for c in df.columns if c not in {*num, *dim, key}]


def pool_dataframe(df: DataFrame, num: list[str], dim: dict[str, int], order: list[str], key: str = "filename", aggregates: dict[str, Callable[[str], Column]] | None = None) -> DataFrame:
    """A row per key: the first non-null metadata, means that pass over NaN, means of vectors; null keys go.

    Columns come as key, metadata, numbers, vectors.  ``aggregates`` maps columns to aggregates of their own.
    """
    place, own = F.struct(*order), aggregates or {}
    first = {m: F.min_by(m, F.when(F.col(m).isNotNull(), place)) for m in metadata_columns(df, num, list(dim), key)}
    pooled = first | {c: F.avg(no_nan(c)) for c in num} | {v: vector_aggregate(v, n) for v, n in dim.items()}
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*((own[c](c) if c in own else how).alias(c) for c, how in pooled.items()))


def top_modes(df: DataFrame, key: str, value: str, order: str, n: int = 5) -> DataFrame:
    """(key, modes): a key's n most frequent values, equals by first occurrence."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("c"), F.min(order).alias("o"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("c"), "o"))).where(F.col("r") <= n)
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r", value))).alias("m")).select(key, F.transform("m", lambda s: s[value]).alias("modes"))


def flat_mean(df: DataFrame, key: str, lists: str) -> DataFrame:
    """The mean of all elements of a key's lists, where longer lists weigh more, and the mean length."""
    per = df.select(key, F.aggregate(lists, F.lit(0.0), lambda s, x: s + x).alias("s"), F.size(lists).alias("n"))
    return per.groupBy(key).agg(F.try_divide(F.sum("s"), F.sum("n")).alias("flat_mean"), F.avg("n").alias("mean_count"))


def normalized_histogram(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """(key, hist): sums of vectors divided by their total; null elements where the total is zero."""
    sums = df.groupBy(key).agg(vector_aggregate(vector, width, F.sum).alias("s"))
    summed = sums.withColumn("total", F.aggregate("s", F.lit(0.0), lambda a, x: a + x))
    return summed.select(key, F.transform("s", lambda x: F.try_divide(x, F.col("total"))).alias("hist"))


def pitch_features(df: DataFrame, key: str, frequency: str, activation: str, width: int) -> DataFrame:
    """(key, pitch_hist, pitch_mean, pitch_var) from a row per frame.

    The histogram is that of the activations; mean and population variance are those of the frequencies.
    """
    hist = normalized_histogram(df, key, activation, width).withColumnRenamed("hist", "pitch_hist")
    track = df.groupBy(key).agg(F.avg(F.col(frequency).cast("double")).alias("pitch_mean"), F.var_pop(F.col(frequency).cast("double")).alias("pitch_var"))
    return hist.join(track, key)


def max_mean_flat(df: DataFrame, key: str, lists: str) -> DataFrame:
    """The largest and the mean of all elements of a key's lists."""
    per = df.select(key, F.array_max(lists).cast("double").alias("m"), F.aggregate(F.col(lists).cast("array<double>"), F.lit(0.0), lambda s, x: s + x).alias("s"), F.size(lists).alias("n"))
    return per.groupBy(key).agg(F.max("m").alias("peak"), F.try_divide(F.sum("s"), F.sum("n")).alias("mean"))

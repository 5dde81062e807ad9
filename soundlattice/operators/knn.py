"""Nearest neighbours of a query set under weighted numeric and vector distances."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from soundlattice.functions import vectors as V
from soundlattice.operators import distances as D
from soundlattice.operators import pooling as P
from soundlattice.operators import scoring
from soundlattice.session import scratch

#: Bytes of queries that are sent to every task at once; larger sets are scored in passes.
BROADCAST_BYTES = 64 << 20
#: From so many queries on, scoring a row costs more than moving it, and the rows are dealt out evenly.
SPREAD_QUERIES = 256


def check_config(expand: bool, normalize_dimensional: bool) -> None:
    """Vectors that become columns can't be normalized as vectors too."""
    if expand and normalize_dimensional:
        raise ValueError("expanded vectors can't be normalized as vectors")


def zscore(dataset: DataFrame, features: list[str], *others: DataFrame) -> list[DataFrame]:
    """The dataset and other frames, features centred and scaled by the dataset's mean and population deviation.

    Without variation the scale is 1.  The statistics are one row, joined by broadcast.
    """
    stats = dataset.agg(*(F.avg(F.nanvl(F.col(f).cast("double"), F.lit(None))).alias(f"{f}__m") for f in features), *(F.stddev_pop(F.nanvl(F.col(f).cast("double"), F.lit(None))).alias(f"{f}__s") for f in features))
    out = []
    for df in (dataset, *others):
        joined = df.crossJoin(F.broadcast(stats))  # one row
        scaled = joined.withColumns({f: (F.col(f) - F.col(f"{f}__m")) / F.when(F.col(f"{f}__s") == 0, 1.0).otherwise(F.col(f"{f}__s")) for f in features})
        out.append(scaled.select(*df.columns))
    return out


def zscore_vectors(dataset: DataFrame, widths: dict[str, int], *others: DataFrame) -> list[DataFrame]:
    """As ``zscore`` for vectors, element by element; vectors of other lengths become null."""
    stats = dataset.agg(*(P.vector_aggregate(v, n).alias(f"{v}__m") for v, n in widths.items()), *(P.vector_aggregate(v, n, F.stddev_pop).alias(f"{v}__s") for v, n in widths.items()))
    scaled = lambda v: F.transform(F.arrays_zip(F.col(v).alias("x"), F.col(f"{v}__m").alias("m"), F.col(f"{v}__s").alias("s")), lambda e: (e["x"].cast("double") - e["m"]) / F.when(e["s"] == 0, 1.0).otherwise(e["s"]))
    out = []
    for df in (dataset, *others):
        joined = df.crossJoin(F.broadcast(stats))  # one row
        out.append(joined.withColumns({v: F.when(F.size(v) == n, scaled(v)) for v, n in widths.items()}).select(*df.columns))
    return out


def vector_widths(dataset: DataFrame, vectors: list[str]) -> dict[str, int]:
    """The longest length of each vector column."""
    found = dataset.agg(*(F.coalesce(F.max(F.size(v)), F.lit(0)).alias(v) for v in vectors)).first()
    return {v: max(0, found[v]) for v in vectors}


def prepare(df: DataFrame, dims: dict[str, float]) -> DataFrame:
    """Vectors as doubles with their norms, once for each row and not for each pair."""
    df = df.withColumns({f: V.doubles(f) for f in dims})
    return df.withColumns({f"{f}__norm": V.norm(F.col(f)) for f in dims})


class Queries:
    """A query set that is computed, written and counted once, in passes of bounded size."""

    def __init__(self, queries: DataFrame, columns: list[str]):
        path = scratch(queries.sparkSession, "queries")
        queries.select(*columns, F.monotonically_increasing_id().alias("__nth")).write.parquet(path)
        self.rows, self.columns = queries.sparkSession.read.parquet(path), columns
        vectors = [f.name for f in self.rows.schema if isinstance(f.dataType, ArrayType)]
        length = sum((F.greatest(F.size(v), F.lit(0)) for v in vectors), F.lit(0))
        size = self.rows.agg(F.count("*").alias("n"), F.coalesce(F.max(length), F.lit(0)).alias("most")).first()
        row_bytes = 16 * (len(columns) + 1) + 8 * size["most"]
        self.n, self.passes = size["n"], max(1, -(-size["n"] * row_bytes // BROADCAST_BYTES))

    def rows_of(self, k: int) -> DataFrame:
        return self.rows.where(F.pmod(F.xxhash64("__nth"), F.lit(self.passes)) == k).select(*self.columns)

    def part(self, k: int) -> DataFrame:
        """The queries of a pass as one row with the array __queries, which is there even if it is empty."""
        return self.rows_of(k).agg(F.collect_list(F.struct(*self.columns)).alias("__queries"))

    def spread(self, dataset: DataFrame) -> DataFrame:
        """The dataset's rows over all cores where they meet many queries: a file of one row group would be one task."""
        return dataset if self.n < SPREAD_QUERIES else dataset.repartition(4 * dataset.sparkSession.sparkContext.defaultParallelism)


def vector_weights(num: dict[str, float], dim: dict[str, float], numeric: D.Distance | None, dimensional: D.Distance | None) -> tuple[dict[str, float], dict[str, float]] | None:
    """The weights that count, if there are vectors and all distances score blocks of pairs; lambdas over arrays cost many times as much."""
    if not dim or dimensional is None or not hasattr(dimensional, "block") or num and numeric is not None and not hasattr(numeric, "block"):
        return None
    return (num if numeric is not None else {}), dim


def features(df: DataFrame, num: dict[str, float], dim: dict[str, float], *kept: Column) -> DataFrame:
    """Kept columns, then numbers and vectors as doubles under names of their own."""
    return df.select(*kept, *(F.col(f).cast("double").alias(f"__n_{f}") for f in num), *(V.doubles(f).alias(f"__v_{f}") for f in dim))


def scorer(df: DataFrame, num: dict[str, float], dim: dict[str, float], numeric: D.Distance | None, dimensional: D.Distance, ids: str | None = None):
    """One pass's queries, held by each task; they come to the driver as BROADCAST_BYTES at most."""
    made = scoring.Scorer({f"__n_{f}": w for f, w in num.items()}, {f"__v_{f}": w for f, w in dim.items()}, numeric.block if num else None, dimensional.block, df.toArrow(), ids)
    return df.sparkSession.sparkContext.broadcast(made)


def pair_distance(num: dict[str, float], dim: dict[str, float], numeric: D.Distance | None, dimensional: D.Distance | None):
    """A function (query struct) -> distance to the current row."""

    def of(q: Column) -> Column:
        get = lambda f: q[f]
        a = numeric(get, F.col, num) if numeric and num else None
        b = dimensional(get, F.col, dim) if dimensional and dim else None
        return D.total(a, b)

    return of


def best_distance(dataset: DataFrame, queries: DataFrame, id_col: str, num: dict[str, float] | None = None, dim: dict[str, float] | None = None, numeric: D.Distance | None = D.euclidean, dimensional: D.Distance | None = D.cosine_dim, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each dataset row with its distance to the nearest query; infinity where no distance is defined.

    The queries go to every task as one row, so the dataset is never shuffled and repeated ids keep a row each.  A
    query set beyond BROADCAST_BYTES is met in passes, between which the minima so far are written.  Large sets meet
    rows that are dealt out evenly.
    """
    num, dim = num or {}, dim or {}
    kept = [id_col, *(k for k in keep if k != id_col)]
    if weights := vector_weights(num, dim, numeric, dimensional):
        return best_of_blocks(dataset, queries, kept, *weights, numeric, dimensional)
    columns = [*num, *dim, *(f"{f}__norm" for f in dim)]
    found = Queries(prepare(queries, dim), columns or [id_col])
    rows = prepare(found.spread(dataset), dim).select(*kept, *(c for c in columns if c not in kept), F.lit(float("inf")).alias("__best"))
    distance = pair_distance(num, dim, numeric, dimensional)
    for k in range(found.passes):
        if k:
            path = scratch(dataset.sparkSession, "minima")
            rows.write.parquet(path)
            rows = dataset.sparkSession.read.parquet(path)
        met = rows.crossJoin(F.broadcast(found.part(k)))  # one row of BROADCAST_BYTES at most
        rows = met.withColumn("__best", F.coalesce(F.least("__best", F.array_min(F.transform("__queries", distance))), "__best")).drop("__queries")
    return rows.select(*kept, F.col("__best").alias("distance"))


def best_of_blocks(dataset: DataFrame, queries: DataFrame, kept: list[str], num: dict[str, float], dim: dict[str, float], numeric: D.Distance | None, dimensional: D.Distance) -> DataFrame:
    """``best_distance`` by blocks of pairs."""
    queries = features(queries, num, dim)
    found = Queries(queries, queries.columns)
    rows = features(found.spread(dataset), num, dim, *kept, F.lit(float("inf")).alias("__best"))
    for k in range(found.passes):
        if k:
            path = scratch(dataset.sparkSession, "minima")
            rows.write.parquet(path)
            rows = dataset.sparkSession.read.parquet(path)
        sent = scorer(found.rows_of(k), num, dim, numeric, dimensional)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index("__best")
                best = np.fmin(batch.column(at).to_numpy(), sent.value.nearest(batch))
                yield pa.RecordBatch.from_arrays([pa.array(best) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select(*kept, F.col("__best").alias("distance"))


def pairs_of_blocks(dataset: DataFrame, queries: DataFrame, id_col: str, num: dict[str, float], dim: dict[str, float], numeric: D.Distance | None, dimensional: D.Distance, digits: int | None) -> DataFrame:
    """``cross_score`` by blocks of pairs, pass by pass."""
    queries = features(queries, num, dim, F.col(id_col).alias("__query"))
    found = Queries(queries, queries.columns)
    rows = features(found.spread(dataset), num, dim, F.col(id_col).alias("__id"))
    kind = rows.schema["__id"].dataType
    schema = StructType([StructField(id_col, kind), StructField("query_id", kind), StructField("distance", DoubleType())])
    out = None
    for k in range(found.passes):
        sent = scorer(found.rows_of(k), num, dim, numeric, dimensional, ids="__query")

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, others = batch.column(batch.schema.get_field_index("__id")), sent.value.ids
                for i, j, d in sent.value.pairs(batch, digits):
                    n, m = d.shape
                    at, to = np.repeat(np.arange(i, i + n), m), np.tile(np.arange(j, j + m), n)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), others.take(pa.array(to)), pa.array(d.ravel(), from_pandas=True)], names=schema.names)

        met = rows.mapInArrow(run, schema)
        out = met if out is None else out.unionAll(met)
    return out


def cross_score(dataset: DataFrame, queries: DataFrame, id_col: str, num: dict[str, float] | None = None, dim: dict[str, float] | None = None, numeric: D.Distance | None = D.euclidean, dimensional: D.Distance | None = D.cosine_dim, digits: int | None = None) -> DataFrame:
    """(id, query_id, distance) for every dataset row and query, rounded to ``digits``; null where undefined.

    The result has a row for each pair by its nature.  Vectors are scored by blocks of pairs; of other features, small
    query sets are broadcast, others meet the dataset as Spark chooses.
    """
    num, dim = num or {}, dim or {}
    if weights := vector_weights(num, dim, numeric, dimensional):
        return pairs_of_blocks(dataset, queries, id_col, *weights, numeric, dimensional, digits)
    columns = [*num, *dim, *(f"{f}__norm" for f in dim)]
    found = Queries(prepare(queries, dim).withColumn("__query", F.col(id_col)), ["__query", *columns])
    dataset = prepare(found.spread(dataset), dim)
    if found.passes == 1:
        pairs = dataset.crossJoin(F.broadcast(found.part(0))).withColumn("__q", F.explode("__queries"))
    else:
        pairs = dataset.crossJoin(found.rows.select(F.struct(*found.columns).alias("__q")))
    return rounded(pairs.select(id_col, F.col("__q.__query").alias("query_id"), pair_distance(num, dim, numeric, dimensional)(F.col("__q")).alias("distance")), digits)


def rounded(scored: DataFrame, digits: int | None) -> DataFrame:
    return scored if digits is None else scored.withColumn("distance", F.round("distance", digits))


def topn(scored: DataFrame, n: int, distance: str = "distance", tie: str | None = None) -> DataFrame:
    """The n nearest, equals by ``tie``: a partial top-n in each task, never a full sort."""
    return scored.orderBy(*(F.col(c) for c in (distance, tie) if c)).limit(n)


Normalize = str | Callable[..., list[DataFrame]] | None


def knn_topk(dataset: DataFrame, queries: DataFrame, id_col: str, n: int = 20, normalize: Normalize = None, normalize_dimensional: Normalize = None, expand: bool = False, pool_order: list[str] | None = None, digits: int | None = None, num: dict[str, float] | None = None, dim: dict[str, float] | None = None, **options) -> DataFrame:
    """The n dataset rows nearest to any query.

    ``expand`` turns vectors into numbers of weight 1.  ``normalize`` and ``normalize_dimensional`` scale numbers and
    vectors of both sides by the dataset: 'zscore', or a function (dataset, features or widths, queries) -> both.
    ``pool_order`` pools the rows of each id on both sides, metadata by that order.  ``digits`` rounds distances before
    they are ranked, so that equals rank by id whatever the last bits are.
    """
    check_config(expand, normalize_dimensional is not None)
    num, dim = dict(num or {}), dict(dim or {})
    widths = vector_widths(dataset, list(dim)) if dim and (expand or normalize_dimensional is not None or pool_order is not None) else {}
    if expand:
        dataset, queries = (df.select("*", *(c for v, w in widths.items() for c in V.expand(v, w))).drop(*dim) for df in (dataset, queries))
        num |= {f"{v}_{i}": 1.0 for v, w in widths.items() for i in range(w)}
        dim, widths = {}, {}
    for how, plain, columns in ((normalize, zscore, list(num)), (normalize_dimensional, zscore_vectors, widths)):
        if how is not None and not callable(how) and how != "zscore":
            raise ValueError(f"unknown normalization {how!r}")
        if how is not None and columns:
            dataset, queries = (how if callable(how) else plain)(dataset, columns, queries)
    if pool_order is not None:
        dataset, queries = (P.pool_dataframe(df, list(num), widths, pool_order, id_col) for df in (dataset, queries))
    return topn(rounded(best_distance(dataset, queries, id_col, num, dim, **options), digits), n, tie=id_col)


def as_recommendations(scored: DataFrame) -> DataFrame:
    return scored.select(F.col("artist").alias("track_artist"), F.col("album").alias("track_album"), F.col("title").alias("track_title"), F.col("uri").alias("spotify_uri"), F.col("distance").alias("track_distance"))


def recommend(tracks: DataFrame, upload: DataFrame, n: int = 10, num: dict[str, float] | None = None, dim: dict[str, float] | None = None, digits: int | None = None) -> DataFrame:
    """The service's answer: the n tracks nearest to the uploaded rows, artist to distance; ``digits`` as of ``knn_topk``."""
    meta = ("artist", "album", "title", "uri")
    scored = best_distance(tracks, upload, "filename", D.DEFAULT_NUM if num is None else num, D.DEFAULT_DIM if dim is None else dim, keep=meta)
    return as_recommendations(topn(rounded(scored, digits), n, tie="filename"))

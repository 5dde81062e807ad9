"""Whole lifecycles: from audio files to a table of tracks, and from an upload to recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundlattice.operators import features as X
from soundlattice.operators import framing, knn, pooling, relational
from soundlattice.sources import readers

#: Widths of the vector features, for pooling in one shuffle.
WIDTHS = {"mfcc_mean": 13, "mfcc_std": 13, "band_mean": 40, "band_std": 40, "erb_bands_mean": 40, "erb_bands_std": 40, "gfcc_mean": 13, "gfcc_peak": 13}
META = ("artist", "title", "album", "length", "release_year", "clean_artist", "clean_title", "clean_album", "uri", "sp_name", "popularity")


def build_tracks(files: DataFrame, features: tuple[str, ...] = X.DEFAULT_FEATURES, catalogue: DataFrame | None = None, pool: bool = True, seed: int = 0, rate: int = 16_000, frame: int = 1024, decode=None, widths: dict[str, int] | None = None, on_error: str = "drop") -> tuple[DataFrame, DataFrame]:
    """(tracks, rejected) from files (path, content, tags); tags are read from the files where there is no such column.

    Metadata is cleaned to keys and enriched from a catalogue keyed by clean_artist and clean_title; one 10-second
    window is drawn from each minute before anything is decoded, features run on windows, and segments are pooled
    to a row for each path (all segments with ``pool=False``).  Files without a length, keys or a whole window
    give no track; those without keys are returned as rejected.  A window that can't be decoded is dropped, or fails
    the query with ``on_error='raise'``.
    """
    if on_error not in ("drop", "raise"):
        raise ValueError(f"unknown on_error {on_error!r}")
    if "tags" not in files.columns:
        files = files.join(readers.file_tags(files), "path")
    meta, rejected = relational.clean_metadata(readers.metadata(files.select("path", "tags")))
    if catalogue is None:
        meta = meta.withColumns({"uri": F.lit(None).cast("string"), "sp_name": F.lit(None).cast("string"), "popularity": F.lit(None).cast("int")})
    else:
        meta = readers.catalogue_search(meta, catalogue, ["clean_artist", "clean_title"], [F.desc("popularity"), "uri"])
    segments = framing.minute_segments(meta.where("length > 0"), "path", "length", seed=seed)
    wanted = segments.groupBy("path").agg(F.array_sort(F.collect_list("segment_start")).alias("segment_starts"))
    windows = readers.audio_windows(wanted.join(files.select("path", "content"), "path"), rate, **({"decode": decode} if decode else {}))
    if on_error == "raise":
        windows = windows.withColumn("signal", F.coalesce("signal", F.raise_error(F.concat(F.lit("can't decode "), "path")).cast("array<float>")))
    windows = windows.where("signal IS NOT NULL")
    keyed = windows.withColumn("segment_key", F.concat_ws("#", "path", F.col("segment_start").cast("string")))
    found = X.extract(keyed, "segment_key", "signal", features, rate, frame)
    rows = segments.withColumn("segment_key", F.concat_ws("#", "path", F.col("segment_start").cast("string"))).join(found, "segment_key").drop("segment_key")
    if not pool:
        return rows, rejected
    sizes = WIDTHS | (widths or {})
    values = [f for f in found.schema if f.name != "segment_key"]
    scalars = tuple(f.name for f in values if f.dataType.simpleString() == "double")
    vectors = {f.name: sizes[f.name] for f in values if f.name in sizes}
    pooled = pooling.pool_segments(rows, "path", "segment_num", scalars, vectors, META)
    return pooled.withColumn("filename", F.element_at(F.split("path", "/"), -1)), rejected


def recommend_upload(tracks: DataFrame, upload: DataFrame, n: int = 10, num: dict[str, float] | None = None, dim: dict[str, float] | None = None, **options) -> DataFrame:
    """The n tracks nearest to an uploaded file (path, content, tags); an upload without features is near to nothing."""
    queries, _ = build_tracks(upload, **options)
    return knn.recommend(tracks, queries, n, num, dim)

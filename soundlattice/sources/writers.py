"""Writers: track tables, append-only logs, JSON and playlists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from soundlattice.operators.relational import batches


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text: CSV holds none."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, ArrayType | MapType | StructType)]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    flat(df).write.mode(mode).csv(path, header=True, escape='"')


def append_log(df: DataFrame, path: str) -> None:
    """Rows for a log; each file has the header, so a reader sees it once for each file."""
    write_csv(df, path, "append")


def as_json(df: DataFrame) -> DataFrame:
    """A row of JSON for each row; infinity is text, since JSON has no such number."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def playlist_batches(df: DataFrame, uri: str, order: str, size: int = 100) -> DataFrame:
    """(batch, items): uris in the lists that a playlist takes at once."""
    return batches(df.where(F.col(uri).isNotNull()), uri, order, size)


def track_frame(tracks: DataFrame, meta: str = "metadata", features: str = "features") -> DataFrame:
    """Metadata and features of struct columns side by side; a feature wins over metadata of its name."""
    wins = set(tracks.schema[features].dataType.names)
    return tracks.select(*(F.col(f"{meta}.{c}") for c in tracks.schema[meta].dataType.names if c not in wins), f"{features}.*")

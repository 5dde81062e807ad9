"""Readers: audio listings and windows, tags, track tables, logs, web pages and uploads."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from soundlattice.functions import signal as S
from soundlattice.functions import text as T
from soundlattice.operators.relational import union_by_name

PROGRESS = "artist string, album string, pri_genres string, sec_genres string, pri_desc string"
FAILURES = "artist string, album string"


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the .flac and .mp3 files of a folder, not of those below it, or of one file.

    The suffix is case-sensitive.  Nothing found is a ValueError; contents are not read.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{flac,mp3}").option("recursiveFileLookup", "false").load(path).select("path", "length")
    if found.isEmpty():
        raise ValueError(f"no audio files in {path}")
    return found


def track_table(spark: SparkSession, path: str, schema: str | StructType, vectors: tuple[str, ...] = ()) -> DataFrame:
    """A CSV track table with a header; ``vectors`` are parsed from list notation."""
    df = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')
    return df.withColumns({v: F.from_json(v, "array<double>") for v in vectors}) if vectors else df


def track_tables(spark: SparkSession, paths: list[str], schemas: list[str]) -> DataFrame:
    """The rows of several tables, columns by name."""
    return union_by_name(*(track_table(spark, p, s) for p, s in zip(paths, schemas, strict=True)))


def optional_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV log, or an empty table where there is none or it holds nothing."""
    try:
        return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def flac_tags(tags: Column) -> list[Column]:
    """Metadata from a map of FLAC tags with their alternative names; ``length`` from seconds, rounded down."""
    first = lambda *names: F.coalesce(*(F.nullif(F.try_element_at(tags, F.lit(n)), F.lit("")) for n in names))
    return [
        T.process_field(first("artist", "artists")).alias("artist"),
        T.process_field(first("title", "song_name")).alias("title"),
        T.process_field(first("album", "album_name")).alias("album"),
        T.process_field(first("album_artist", "albumartist")).alias("album_artist"),
        T.extract_year(first("date", "year")).alias("release_year"),
        F.floor(F.try_element_at(tags, F.lit("seconds")).cast("double")).cast("int").alias("length"),
    ]


def mp3_tags(tags: Column) -> list[Column]:
    """Metadata from ID3 frames as they are; there is no length."""
    get = lambda n: F.try_element_at(tags, F.lit(n))
    return [get("TPE1").alias("artist"), get("TIT2").alias("title"), get("TALB").alias("album"), get("TPE2").alias("album_artist"), get("TDRC").alias("release_year"), F.lit(None).cast("int").alias("length")]


def metadata(files: DataFrame, path: str = "path", tags: str = "tags") -> DataFrame:
    """Metadata by the file's suffix, in any case; null for other suffixes."""
    kind = T.extension(F.col(path))
    struct = F.when(kind == "flac", F.struct(*flac_tags(F.col(tags)))).when(kind == "mp3", F.struct(*mp3_tags(F.col(tags))))
    return files.select(path, struct.alias("meta")).select(path, "meta.*")


def _vorbis_comments(block: bytes) -> Iterator[tuple[str, str]]:
    at = 4 + int.from_bytes(block[:4], "little")
    count = int.from_bytes(block[at : at + 4], "little")
    at += 4
    for _ in range(count):
        size = int.from_bytes(block[at : at + 4], "little")
        name, sign, value = block[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        at += 4 + size
        if sign:
            yield name.lower(), value


def flac_file_tags(content: bytes) -> dict[str, str]:
    """Comments by lower-cased name, the first of each, and ``seconds``, from the metadata blocks of a FLAC file."""
    out: dict[str, str] = {}
    at, last = 4, content[:4] != b"fLaC"
    while not last and at + 4 <= len(content):
        last, kind, size = content[at] >> 7, content[at] & 127, int.from_bytes(content[at + 1 : at + 4], "big")
        block = content[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0 and len(block) >= 18:
            packed = int.from_bytes(block[10:18], "big")  # 20 bits of rate, 3 of channels, 5 of depth, 36 of samples
            if packed >> 44:
                out["seconds"] = repr((packed & (1 << 36) - 1) / (packed >> 44))
        elif kind == 4:
            for name, value in _vorbis_comments(block):
                out.setdefault(name, value)
    return out


# Text encodings of ID3 frames by number, and today's names of old frames.
ID3_ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")
ID3_NAMES = {"TYER": "TDRC", "TP1": "TPE1", "TT2": "TIT2", "TAL": "TALB", "TP2": "TPE2", "TYE": "TDRC"}


def _syncsafe(raw: bytes) -> int:
    return sum((b & 127) << 7 * i for i, b in enumerate(reversed(raw)))


def mp3_file_tags(content: bytes) -> dict[str, str]:
    """Text frames by their name of version 2.4, the first value of each, from the ID3 header of an MP3 file."""
    if content[:3] != b"ID3" or len(content) < 10:
        return {}
    version, flags = content[3], content[5]
    body = content[10 : 10 + _syncsafe(content[6:10])]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at = (_syncsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")) if flags & 0x40 else 0
    wide = 4 if version > 2 else 3
    out: dict[str, str] = {}
    while at + 2 * wide <= len(body) and body[at]:
        name, raw = body[at : at + wide].decode("latin-1"), body[at + wide : at + 2 * wide]
        size = _syncsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        at += 2 * wide + (2 if version > 2 else 0)
        text = body[at : at + size]
        at += size
        if name[0] == "T" and text and text[0] < len(ID3_ENCODINGS):
            value = text[1:].decode(ID3_ENCODINGS[text[0]], "replace").split("\0")[0]
            if value:
                out.setdefault(ID3_NAMES.get(name, name), value)
    return out


def file_tags(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, tags) read from the headers of .flac and .mp3 files; an empty map where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                read = {"flac": flac_file_tags, "mp3": mp3_file_tags}.get((name or "").rpartition(".")[2].lower())
                tags.append(list(read(raw.as_py()).items()) if read and raw.is_valid else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tags, pa.map_(pa.string(), pa.string()))], ["path", "tags"])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, "path string, tags map<string,string>")


def _decode(content: bytes, start: int, seconds: int, rate: int) -> np.ndarray | None:
    """``seconds`` of a 16-bit WAV file from ``start`` on, mono; only that part is converted."""
    try:
        with wave.open(io.BytesIO(content)) as f:
            if f.getsampwidth() != 2:
                return None
            own, channels = f.getframerate(), f.getnchannels()
            f.setpos(min(f.getnframes(), start * own))
            raw = np.frombuffer(f.readframes(seconds * own), "<i2").reshape(-1, channels)
    except (wave.Error, EOFError):
        return None
    return S.resample(S.mono(raw / 32768.0), own, rate)


def audio_windows(files: DataFrame, rate: int = 16_000, seconds: int = 10, decode=_decode) -> DataFrame:
    """(path, segment_start, signal) from (path, content, segment_start) or (path, content, segment_starts), an array, so
    that a file's content travels once for all its windows; null where ``decode`` can't read a file.

    Other formats than WAV need a ``decode`` of (content, start, seconds, rate).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column(1)[i].as_py()
                for start in batch.column(2)[i].as_py() or ():
                    x = decode(content, start, seconds, rate)
                    signal = pa.array([None if x is None else x.tolist()], pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([start], pa.int32()), signal], ["path", "segment_start", "signal"])

    starts = F.col("segment_starts") if "segment_starts" in files.columns else F.array("segment_start")
    return files.select("path", "content", starts.cast("array<int>").alias("starts")).mapInArrow(run, "path string, segment_start int, signal array<float>")


def catalogue_search(tracks: DataFrame, catalogue: DataFrame, keys: list[str], order: list) -> DataFrame:
    """uri, sp_name and popularity of each track's first match in a local catalogue; null without one."""
    from soundlattice.operators.relational import lookup

    return lookup(tracks, catalogue, keys, order, ["uri", "sp_name", "popularity"])


def page_tags(pages: DataFrame, html: str, tag: str, css_class: str | None = None) -> DataFrame:
    """The pages with ``texts``, the texts of their elements of a name and class."""
    return pages.withColumn("texts", T.html_text(F.col(html), tag, css_class))


def upload(spark: SparkSession, path: str) -> DataFrame:
    """One uploaded file as (path, length, content), refused unless its suffix is allowed."""
    name = path.rsplit("/", 1)[-1]
    if "." not in name or name.rsplit(".", 1)[1].lower() not in {"mp3", "flac"}:
        raise ValueError(f"file type not allowed: {name}")
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")

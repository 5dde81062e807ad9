import io
import wave

import numpy as np
import pytest

from soundlattice.plans.pipelines import build_tracks, recommend_upload
from soundlattice.sources import readers


def wav(freq: float, seconds: int) -> bytearray:
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(8000)
        f.writeframes((12_000 * np.sin(2 * np.pi * freq * np.arange(8000 * seconds) / 8000)).astype("<i2").tobytes())
    return bytearray(buffer.getvalue())


def test_from_files_to_recommendations(spark):
    tags = lambda artist, title, n: {"artist": artist, "title": title, "album": "L", "seconds": str(n)}
    files = spark.createDataFrame(
        [
            ("/m/low.flac", wav(300, 80), tags("A", "Low (Live)", 80)),
            ("/m/high.flac", wav(3000, 30), tags("B", "High", 30)),
            ("/m/short.flac", wav(300, 5), tags("C", "Short", 5)),
            ("/m/nameless.flac", wav(300, 30), {"seconds": "30"}),
            ("/m/no-length.mp3", wav(300, 30), {"TPE1": "D", "TIT2": "T", "TALB": "L"}),
        ],
        "path string, content binary, tags map<string,string>",
    )
    catalogue = spark.createDataFrame([("a", "low", "u1", "LOW", 5), ("a", "low", "u2", "low", 9)], "clean_artist string, clean_title string, uri string, sp_name string, popularity int")
    tracks, rejected = build_tracks(files, ("mfcc", "centroid"), catalogue)
    rows = {r["filename"]: r for r in tracks.collect()}
    assert set(rows) == {"low.flac", "high.flac"}
    assert [r["path"] for r in rejected.collect()] == ["/m/nameless.flac"]
    assert rows["low.flac"]["uri"] == "u2" and rows["high.flac"]["uri"] is None and rows["low.flac"]["clean_title"] == "low"
    assert rows["high.flac"]["spectral_centroid_mean"] > 3 * rows["low.flac"]["spectral_centroid_mean"]
    segments, _ = build_tracks(files, ("mfcc",), pool=False)
    assert segments.where("path = '/m/low.flac'").count() == 2
    upload = spark.createDataFrame([("/u/new.flac", wav(320, 20), tags("X", "New", 20))], files.schema)
    top = recommend_upload(tracks, upload, 2, {"spectral_centroid_mean": 1.0}, {"mfcc_mean": 0.01}, features=("mfcc", "centroid")).collect()
    assert [r["track_title"] for r in top] == ["Low", "High"] and top[0]["track_distance"] < top[1]["track_distance"]


def flac(comments: list[str], rate: int = 44_100, samples: int = 44_100 * 61) -> bytes:
    packed = (rate << 44 | 1 << 41 | 15 << 36 | samples).to_bytes(8, "big")
    info = b"\0" * 10 + packed + b"\0" * 16
    body = (3).to_bytes(4, "little") + b"own" + len(comments).to_bytes(4, "little")
    for c in comments:
        body += len(c.encode()).to_bytes(4, "little") + c.encode()
    block = lambda kind, data: bytes([kind]) + len(data).to_bytes(3, "big") + data
    return b"fLaC" + block(0, info) + block(1, b"\0" * 9) + block(0x84, body) + b"audio"


def id3(frames: list[tuple[str, bytes]], version: int = 4) -> bytes:
    safe = lambda n: bytes(n >> s & 127 for s in (21, 14, 7, 0))
    body = b"".join(name.encode() + (safe(len(x)) if version == 4 else len(x).to_bytes(4, "big")) + b"\0\0" + x for name, x in frames) + b"\0" * 30
    return b"ID3" + bytes([version, 0, 0]) + safe(len(body)) + body


def test_tags_are_read_from_files(spark):
    files = [
        ("/m/a.flac", bytearray(flac(["ARTIST=Ä b", "artist=other", "Title=T (Live)", "album=L", "date=2020-05-01"]))),
        ("/m/b.MP3", bytearray(id3([("TPE1", b"\3A\0B"), ("TIT2", b"\1" + "Tü".encode("utf-16")), ("TALB", b"\0L"), ("TDRC", b"\x032001")]))),
        ("/m/c.mp3", bytearray(id3([("TPE1", b"\0" + b"x" * 200), ("TYER", b"\x001999")], 3))),
        ("/m/d.flac", bytearray(b"junk")),
        ("/m/e.wav", None),
    ]
    df = spark.createDataFrame(files, "path string, content binary")
    tags = {r["path"]: r["tags"] for r in readers.file_tags(df).collect()}
    assert tags["/m/a.flac"] == {"seconds": "61.0", "artist": "Ä b", "title": "T (Live)", "album": "L", "date": "2020-05-01"}
    assert tags["/m/b.MP3"] == {"TPE1": "A", "TIT2": "Tü", "TALB": "L", "TDRC": "2001"} and tags["/m/c.mp3"] == {"TPE1": "x" * 200, "TDRC": "1999"}
    assert tags["/m/d.flac"] == {} and tags["/m/e.wav"] == {}
    got = {r["path"]: r for r in readers.metadata(readers.file_tags(df)).collect()}
    assert (got["/m/a.flac"]["title"], got["/m/a.flac"]["length"], got["/m/a.flac"]["release_year"], got["/m/b.MP3"]["title"]) == ("T", 61, "2020", "Tü")


def test_windows_that_cannot_be_decoded(spark):
    files = spark.createDataFrame([("/m/a.flac", bytearray(flac(["artist=A", "title=T", "album=L"])))], "path string, content binary")
    assert build_tracks(files, ("mfcc",))[0].count() == 0
    with pytest.raises(Exception, match="can't decode"):
        build_tracks(files, ("mfcc",), on_error="raise")[0].collect()


def test_upload_without_features_is_near_to_nothing(spark):
    files = spark.createDataFrame([("/m/a.flac", wav(300, 20), {"artist": "A", "title": "T", "album": "L", "seconds": "20"})], "path string, content binary, tags map<string,string>")
    tracks, _ = build_tracks(files, ("mfcc",))
    upload = spark.createDataFrame([("/u/x.mp3", wav(300, 20), {"TPE1": "D", "TIT2": "T", "TALB": "L"})], files.schema)
    top = recommend_upload(tracks, upload, 5, {}, {"mfcc_mean": 1.0}, features=("mfcc",)).collect()
    assert [r["track_distance"] for r in top] == [pytest.approx(float("inf"))]

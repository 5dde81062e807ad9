import io
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundlattice.functions import signal as S
from soundlattice.operators import features, framing, models, pooling, relational
from soundlattice.session import scratch
from soundlattice.sources import readers, writers


def test_frame_rules(spark):
    count = lambda n, exclusive: spark.range(1).select(F.size(framing.starts(F.lit(n), 1024, 1024, exclusive))).first()[0]
    assert [count(2048, True), count(2048, False), count(100, True), count(1024, True), count(1024, False)] == [1, 2, 0, 0, 1]
    assert len(S.frame_matrix(np.zeros(2048), 1024, 1024, True)) == 1 and len(S.frame_matrix(np.zeros(2048), 1024, 1024, False)) == 2


def test_segment_plan(spark):
    tracks = spark.createDataFrame([(str(n), float(n)) for n in (0, 5, 65, 70, 185, 3600)], "path string, length double")
    plan = framing.minute_segments(tracks, "path", "length").collect()
    per = {}
    for r in plan:
        per.setdefault(int(r["path"]), []).append((r["segment_num"], r["segment_start"]))
        sec, end = 60 * r["segment_num"], r["length"]
        assert sec <= r["segment_start"] <= min(sec + 50, end - 10)
    assert {k: len(v) for k, v in per.items()} == {65: 1, 70: 2, 185: 3, 3600: 60}
    assert (1, 60) in per[70]
    assert plan == framing.minute_segments(tracks, "path", "length").collect()


def test_pooling(spark):
    df = spark.createDataFrame([("t", 1, [3.0, 4.0], 1.0, None), ("t", 0, [1.0, 2.0], 3.0, "b"), (None, 0, [9.0, 9.0], 1.0, "x")], "k string, n int, v array<double>, x double, m string")
    (row,) = pooling.pool_segments(df.where("k = 't'"), "k", "n", ("x",), {"v": 2}, ("m",)).collect()
    assert row["v"] == [2.0, 3.0] and row["x"] == 2.0 and row["m"] == "b"
    (row,) = pooling.pool_dataframe(df.withColumn("x", F.when(F.col("n") == 0, F.col("x")).otherwise(float("nan"))), ["x"], {"v": 2}, ["n"], "k").collect()
    assert row["x"] == 3.0 and row["m"] == "b" and row.asDict().keys() == {"k", "n", "m", "x", "v"}
    modes = spark.createDataFrame([("a", v, i) for i, v in enumerate("baabc")], "k string, v string, i int")
    assert pooling.top_modes(modes, "k", "v", "i").first()["modes"] == ["b", "a", "c"]
    assert {r["k"]: r["v"] for r in pooling.vector_mean(df.where("k = 't'"), "k", "v").collect()} == {"t": [2.0, 3.0]}


def test_worklist_keeps_null_keys(spark):
    albums = spark.createDataFrame([(None, "x", 1), ("a", "x", 2), ("a", "x", 3), ("b", "y", 4)], "clean_artist string, clean_album string, i int")
    progress = spark.createDataFrame([("a", "x", "[]", '["g"]', '["d"]'), (None, "x", '["g"]', '["g"]', '["d"]')], readers.PROGRESS)
    failures = spark.createDataFrame([("b", "y")], readers.FAILURES)
    got = relational.worklist(albums, progress, failures, ["i"]).collect()
    assert sorted(map(tuple, got), key=str) == [("a", "x"), (None, "x")]


def test_batches(spark):
    df = spark.createDataFrame([(f"u{i:04d}", i) for i in range(250)], "uri string, i int").repartition(7)
    one = {r["batch"]: r["items"] for r in writers.playlist_batches(df, "i", "i").collect()}
    assert [x for b in sorted(one) for x in one[b]] == sorted(r["i"] for r in df.collect())  # value and order in one column
    got = {r["batch"]: r["items"] for r in writers.playlist_batches(df, "uri", "i").collect()}
    assert {k: len(v) for k, v in got.items()} == {0: 100, 1: 100, 2: 50} and got[2][0] == "u0200"


def test_metadata_rejects_what_lacks_keys(spark):
    tags = spark.createDataFrame([("a", "", "T", "L"), ("a", "M", None, "L")], "artist string, album_artist string, title string, album string")
    good, bad = relational.clean_metadata(tags)
    assert good.first()["clean_artist"] == "a" and bad.first()["artist"] == "M" and good.count() == bad.count() == 1


def test_csv_round_trip(spark):
    path = scratch(spark, "rt")
    df = spark.createDataFrame([(1, 'a "b",\nc', [1.5, -2e-05], None)], "k int, t string, v array<double>, n string")
    writers.write_csv(df, path)
    assert readers.track_table(spark, path, "k int, t string, v string, n string", ("v",)).collect() == df.collect()
    assert readers.optional_table(spark, path + "-none", readers.FAILURES).count() == 0


def test_audio_window_reads_only_its_part(spark):
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(16_000)
        f.writeframes((np.repeat(np.arange(12), 16_000) * 1000).astype("<i2").tobytes())
    files = spark.createDataFrame([("a.wav", bytearray(buffer.getvalue()), 1), ("b.flac", bytearray(b"junk"), 0)], "path string, content binary, segment_start int")
    got = {r["path"]: r["signal"] for r in readers.audio_windows(files).collect()}
    assert len(got["a.wav"]) == 160_000 and got["a.wav"][0] == pytest.approx(1000 / 32768) and got["b.flac"] is None


def test_upload_refuses_other_files(spark):
    with pytest.raises(ValueError):
        readers.upload(spark, "/tmp/x.exe")


def test_spectral_features():
    t = np.arange(44_100) / 44_100
    tone = np.sin(2 * np.pi * 1000 * t)
    s = S.spectra(S.frame_matrix(tone, 1024, 1024))
    assert S.centroid(s).mean() == pytest.approx(1000 * 1024 / 44_100, rel=0.05)
    assert S.energy_ratios(s)["midrange"].mean() > 0.99
    freqs, mags = S.peaks(s)[0]
    assert freqs[np.argmax(mags)] == pytest.approx(1000, abs=44)
    assert (S.flux(np.ones((3, 4))) == [2, 0, 0]).all()
    assert S.flatness_db(np.ones((1, 8)))[0] == pytest.approx(0)
    clicks = np.zeros(44_100 * 8)
    clicks[:: 44_100 // 2] = 1
    assert S.bpm(clicks) == pytest.approx(120, rel=0.03)
    assert S.centroid(s, 44_100 / 1024).mean() == pytest.approx(1000, rel=0.05) and S.rolloff(s, 44_100 / 1024).max() == pytest.approx(1000, abs=90)
    assert S.key_of(np.eye(12)[[0, 2, 4, 5, 7, 9, 11, 0, 4, 7]].sum(axis=0)) == "C_major" and S.key_of(np.eye(12)[[9, 0, 4, 9, 2]].sum(axis=0)) == "A_minor"
    assert S.chord(np.eye(12)[[0, 4, 7]].sum(axis=0)) == "C" and math.isnan(S.energy(np.zeros(0)))


def test_loudness_of_reference_tones():
    """A full-scale tone of 997 Hz has -3.01 in one channel and 0 in two; 60 Hz weighs less, quiet parts are gated."""
    t = np.arange(48_000 * 8) / 48_000
    tone = np.sin(2 * np.pi * 997 * t)
    level, spread = S.loudness(tone, 48_000)
    assert level == pytest.approx(-3.01, abs=0.02) and spread == pytest.approx(0, abs=0.1)
    assert S.loudness(np.stack([tone, tone], axis=1), 48_000)[0] == pytest.approx(0, abs=0.02)
    assert S.loudness(np.sin(2 * np.pi * 30 * t), 48_000)[0] < -8
    assert S.loudness(np.where(t < 4, tone, 0.001 * tone), 48_000)[0] == pytest.approx(-3.1, abs=0.3)
    assert math.isnan(S.loudness(np.zeros(0))[0])


def test_pitch_features(spark):
    rows = [(1, 100.0, [1.0, 0.0]), (1, 200.0, [1.0, 2.0]), (2, 50.0, [0.0, 0.0])]
    got = {r["k"]: r for r in pooling.pitch_features(spark.createDataFrame(rows, "k int, f double, a array<double>"), "k", "f", "a", 2).collect()}
    assert got[1]["pitch_hist"] == [0.5, 0.5] and (got[1]["pitch_mean"], got[1]["pitch_var"]) == (150, 2500)
    assert got[2]["pitch_hist"] == [None, None] and got[2]["pitch_mean"] == 50


def test_pooling_with_own_aggregates(spark):
    df = spark.createDataFrame([("a", 1, 2.0, "x"), ("a", 2, 5.0, "y")], "filename string, n int, v double, m string")
    got = pooling.pool_dataframe(df, ["v"], {}, ["n"], aggregates={"v": F.max, "m": F.count}).first()
    assert (got["v"], got["m"], got["n"]) == (5.0, 2, 1)


def test_feature_stage(spark):
    signal = np.sin(np.arange(8192) / 9).tolist()
    df = spark.createDataFrame([(1, signal), (2, None), (3, [0.0] * 10)], "k int, x array<double>")
    own = {"own": (lambda x, rate, frame: {"peak": float(x.max())}, "peak double")}
    got = {r["k"]: r for r in features.extract(df, "k", "x", tuple(features.FEATURES), frame=1024, extra=own).collect()}
    assert len(got[1]["mfcc_mean"]) == 13 and len(got[1]["band_mean"]) == 40 and got[1]["peak"] > 0.99
    assert got[2]["mfcc_mean"] is None and got[3]["most_common_chords"] is None


def test_models(spark):
    df = spark.createDataFrame([(1, np.arange(64.0).tolist()), (2, [1.0]), (3, None)], "k int, x array<double>")
    got = {r["k"]: r for r in models.infer(df, "k", "x").collect()}
    assert len(models.REGISTRY) == 23 and got[2]["danceable_effnet"] is None and got[3]["discogs_effnet_embeddings"] is None
    rows = np.arange(64.0).reshape(8, 8) @ np.cos(np.outer(np.arange(8) + 0.5, np.arange(8)) * np.pi / 8)
    head = models.stub_head(models.REGISTRY["gender"])
    assert got[1]["female_effnet"] == pytest.approx(head(rows)[:, 0].mean())
    assert models.REGISTRY["approachability_3c"].feature == "not_approachable_effnet"
    assert models.stage_kind("happy") == "model" and models.stage_kind(len) == "algorithm"
    with pytest.raises(TypeError):
        models.stage_kind(3)

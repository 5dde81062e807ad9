"""Feature extraction: functions from a segment's signal to named values, run by Arrow batches.

A feature function takes (signal, rate) and returns a dict.  ``extract`` runs several in one pass, so a signal crosses
to Python once and never comes back.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundlattice.functions import signal as S

Feature = Callable[[np.ndarray, int, int], dict]
FEATURES: dict[str, tuple[Feature, str]] = {}


def feature(name: str, schema: str) -> Callable[[Feature], Feature]:
    """Register a function (signal, rate, frame) -> dict under a name, with its result's schema."""

    def add(f: Feature) -> Feature:
        FEATURES[name] = (f, schema)
        return f

    return add


def _doubles(*names: str) -> str:
    return ", ".join(f"{n} double" for n in names)


def _lists(*names: str) -> str:
    return ", ".join(f"{n} array<double>" for n in names)


def _spectra(x: np.ndarray, frame: int) -> np.ndarray:
    return S.spectra(S.frame_matrix(x, frame, frame, exclusive=True))


@feature("bpm", _doubles("bpm"))
def _bpm(x, rate, frame):
    return {"bpm": S.bpm(x, rate, max(1, frame // 2)) / 208}


@feature("energy", _doubles("avg_energy"))
def _energy(x, rate, frame):
    return {"avg_energy": S.energy(x)}


@feature("loudness", _doubles("integrated_loudness", "loudness_range"))
def _loudness(x, rate, frame):
    level, spread = S.loudness(x, rate)
    return {"integrated_loudness": level, "loudness_range": spread}


@feature("mfcc", _lists("mfcc_mean", "mfcc_std", "band_mean", "band_std"))
def _mfcc(x, rate, frame):
    bands = S.mel_bands(S.spectra(S.frame_matrix(x, 2 * frame, frame, exclusive=False)), rate=rate)
    return S.stats(S.cepstrum(bands), "mfcc") | S.stats(bands, "band")


@feature("centroid", _doubles("spectral_centroid_mean", "spectral_centroid_std", "spectral_centroid_max"))
def _centroid(x, rate, frame):
    return S.stats(S.centroid(_spectra(x, frame), rate / frame), "spectral_centroid", with_max=True)


@feature("rolloff", _doubles("rolloff_mean", "rolloff_std", "rolloff_max"))
def _rolloff(x, rate, frame):
    return S.stats(S.rolloff(_spectra(x, frame), rate / frame), "rolloff", with_max=True)


@feature("contrast", _lists("spectral_contrast_mean", "spectral_contrast_std", "spectral_valley_mean", "spectral_valley_std"))
def _contrast(x, rate, frame):
    top, low = S.contrast(_spectra(x, frame))
    return S.stats(top, "spectral_contrast") | S.stats(low, "spectral_valley")


@feature("hfc", _doubles("hfc_mean", "hfc_std"))
def _hfc(x, rate, frame):
    return S.stats(S.hfc(_spectra(x, frame)), "hfc")


@feature("flux", _doubles("flux_mean", "flux_std"))
def _flux(x, rate, frame):
    return S.stats(S.flux(_spectra(x, frame)), "flux")


@feature("flatness", _doubles("flatness_db_mean", "flatness_db_std"))
def _flatness(x, rate, frame):
    return S.stats(S.flatness_db(_spectra(x, frame)), "flatness_db")


@feature("energy_ratio", _doubles(*(f"{b}_{s}" for b in S.BANDS for s in ("mean", "std"))))
def _energy_ratio(x, rate, frame):
    out = {}
    for band, values in S.energy_ratios(_spectra(x, frame), rate).items():
        out |= S.stats(values, band, skip_nan=True)
    return out


@feature("peaks", _doubles("spectral_peaks_avg_freq", "spectral_peaks_avg_mag", "spectral_peaks_count"))
def _peaks(x, rate, frame):
    found = S.peaks(S.spectra(S.frame_matrix(x, frame, frame, exclusive=False), S.blackman_harris), rate)
    freqs, mags = (np.concatenate([p[i] for p in found]) if found else np.zeros(0) for i in (0, 1))
    mean = lambda a: float(np.mean(a)) if len(a) else float("nan")
    return {"spectral_peaks_avg_freq": mean(freqs), "spectral_peaks_avg_mag": mean(mags), "spectral_peaks_count": mean([len(p[0]) for p in found])}


@feature("gfcc", _lists("erb_bands_mean", "erb_bands_std", "gfcc_mean", "gfcc_peak"))
def _gfcc(x, rate, frame):
    bands = S.erb_bands(_spectra(x, frame), rate=rate)
    out, coefficients = S.stats(bands, "erb_bands"), S.stats(S.cepstrum(bands), "gfcc", with_max=True)
    return out | {"gfcc_mean": coefficients["gfcc_mean"], "gfcc_peak": coefficients["gfcc_max"]}


@feature("tonal", "most_common_chords array<string>, most_common_keys array<string>, " + _doubles("mfcc_peak_energy", "mfcc_avg_energy", "pitch_salience", "avg_dissonance", "avg_rollof") + ", tristimulus array<double>")
def _tonal(x, rate, frame):
    raw = S.frame_matrix(x, frame, frame, exclusive=False)
    spec = S.spectra(raw)
    kept = [(i, f, m) for i, (f, m) in enumerate(S.peaks(spec, rate)) if len(f)]
    if not kept:
        return {}
    chords = Counter(S.chord(S.chroma(f, m)) for _, f, m in kept)
    keys = Counter(S.key_of(S.chroma(f, m)) for _, f, m in kept)
    rows = [i for i, _, _ in kept]
    bands = S.mel_bands(spec[rows], rate=rate)
    return {
        "most_common_chords": [c for c, _ in chords.most_common(5)],
        "most_common_keys": [c for c, _ in keys.most_common(5)],
        "mfcc_peak_energy": float(bands.max()),
        "mfcc_avg_energy": float(bands.mean()),
        "pitch_salience": float(np.mean([S.pitch_salience(raw[i]) for i in rows])),
        "avg_dissonance": float(np.mean([S.dissonance(f, m) for _, f, m in kept])),
        "avg_rollof": float(S.rolloff(spec[rows], rate / frame).mean()),
        "tristimulus": np.mean([S.tristimulus(m) for _, _, m in kept], axis=0).tolist(),
    }


#: Run by default.
DEFAULT_FEATURES = ("mfcc", "bpm")


def extract(df: DataFrame, key: str, signal: str, features: tuple[str, ...] = DEFAULT_FEATURES, rate: int = S.RATE, frame: int = 1024, extra: dict[str, tuple[Feature, str]] | None = None) -> DataFrame:
    """(key, all values of the features).  ``extra`` adds functions for this call, run after the others.

    A null or empty signal gives nulls.
    """
    chosen = {f: FEATURES[f] for f in features} | (extra or {})
    schema = ", ".join(s for _, s in chosen.values())
    kind = df.schema[key].dataType.simpleString()
    names = [p.strip().split(" ")[0] for p in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {f.name: f.type for f in _arrow(schema)}
        for batch in batches:
            rows = []
            for values in batch.column(1):
                x = np.asarray(values.values, dtype=np.float64) if values.is_valid else np.zeros(0)
                found: dict = {}
                for f, _ in chosen.values():
                    found |= f(x, rate, frame) if len(x) else {}
                rows.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r.get(n) for r in rows], types[n]) for n in names)], [key, *names])

    return df.select(key, F.col(signal).cast("array<double>").alias(signal)).mapInArrow(run, f"{key} {kind}, {schema}")


def _arrow(schema: str) -> pa.Schema:
    kinds = {"double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (p.strip().split(" ") for p in schema.split(", "))])

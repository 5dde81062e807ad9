"""Spectral features in numpy, by their textbook definitions.

Frames are rows of a matrix.  Windows are symmetric Hann, magnitudes those of the real Fourier transform.
"""

from __future__ import annotations

import numpy as np

RATE = 44_100
# Bands of the energy ratio in Hz.
BANDS = {"sub_bass": (0, 60), "bass": (60, 250), "lower_midrange": (250, 500), "midrange": (500, 2000), "higher_midrange": (2000, 4000), "presence": (4000, 6000), "brilliance": (6000, 22050)}
CHORD_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def frame_matrix(x: np.ndarray, frame: int, hop: int, exclusive: bool = True) -> np.ndarray:
    last = len(x) - frame - (1 if exclusive else 0)
    if last < 0:
        return np.zeros((0, frame))
    return np.lib.stride_tricks.sliding_window_view(x, frame)[: last + 1 : hop]


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))


def blackman_harris(n: int) -> np.ndarray:
    t = 2 * np.pi * np.arange(n) / (n - 1)
    return 0.35875 - 0.48829 * np.cos(t) + 0.14128 * np.cos(2 * t) - 0.01168 * np.cos(3 * t)


def spectra(frames: np.ndarray, window=hann) -> np.ndarray:
    return np.abs(np.fft.rfft(frames * window(frames.shape[1]), axis=1))


def energy(x: np.ndarray) -> float:
    return float(np.dot(x, x) / len(x)) if len(x) else float("nan")


def centroid(s: np.ndarray, bin_hz: float = 1.0) -> np.ndarray:
    """In bins, or in Hz for bins of that width."""
    k = np.arange(s.shape[1]) * bin_hz
    with np.errstate(invalid="ignore", divide="ignore"):
        return (s * k).sum(axis=1) / s.sum(axis=1)


def rolloff(s: np.ndarray, bin_hz: float = 1.0, share: float = 0.85) -> np.ndarray:
    """The first bin at which the energy reaches its share, or its Hz for bins of that width."""
    e = np.cumsum(s * s, axis=1)
    return (e < share * e[:, -1:]).sum(axis=1) * bin_hz


def hfc(s: np.ndarray) -> np.ndarray:
    return (s * s * np.arange(s.shape[1])).sum(axis=1)


def flux(s: np.ndarray) -> np.ndarray:
    """Distance to the spectrum before; the first is compared with silence."""
    return np.sqrt((np.diff(s, axis=0, prepend=np.zeros((1, s.shape[1]))) ** 2).sum(axis=1)) if len(s) else np.zeros(0)


def flatness_db(s: np.ndarray, floor: float = 1e-12) -> np.ndarray:
    m = np.maximum(s, floor)
    return 10 * np.log10(np.exp(np.log(m).mean(axis=1)) / m.mean(axis=1))


def energy_ratios(s: np.ndarray, rate: int = RATE) -> dict[str, np.ndarray]:
    freq = np.arange(s.shape[1]) * rate / (2 * (s.shape[1] - 1))
    e = s * s
    with np.errstate(invalid="ignore", divide="ignore"):
        return {b: e[:, (freq >= lo) & (freq < hi)].sum(axis=1) / e.sum(axis=1) for b, (lo, hi) in BANDS.items()}


def peaks(s: np.ndarray, rate: int = RATE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Frequencies and magnitudes of local maxima, ascending by frequency."""
    out = []
    for m in s:
        k = 1 + np.flatnonzero((m[1:-1] > m[:-2]) & (m[1:-1] >= m[2:]) & (m[1:-1] > 1e-9))
        out.append((k * rate / (2 * (len(m) - 1)), m[k]))
    return out


def _triangles(edges: np.ndarray, bins: int, rate: int) -> np.ndarray:
    freq = np.arange(bins) * rate / (2 * (bins - 1))
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((freq - lo) / (mid - lo), (hi - freq) / (hi - mid)))


def mel_bands(s: np.ndarray, n: int = 40, rate: int = RATE) -> np.ndarray:
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, n + 2) / 2595) - 1)
    return (s * s) @ _triangles(edges, s.shape[1], rate).T


def erb_bands(s: np.ndarray, n: int = 40, rate: int = RATE) -> np.ndarray:
    top = 21.4 * np.log10(1 + 0.00437 * rate / 2)
    edges = (10 ** (np.linspace(0, top, n + 2) / 21.4) - 1) / 0.00437
    return (s * s) @ _triangles(edges, s.shape[1], rate).T


def cepstrum(bands: np.ndarray, n: int = 13) -> np.ndarray:
    """The type-II cosine transform of log bands."""
    k = np.arange(bands.shape[1])
    basis = np.cos(np.pi * np.outer(np.arange(n), k + 0.5) / bands.shape[1])
    return np.log(np.maximum(bands, 1e-10)) @ basis.T


def contrast(s: np.ndarray, n: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(contrast, valley) in dB of octave-wise bands: means of the top and bottom fifths."""
    edges = np.unique(np.round(np.geomspace(1, s.shape[1], n + 1)).astype(int))
    top, low = [], []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = np.sort(s[:, a:b], axis=1)
        k = max(1, part.shape[1] // 5)
        top.append(10 * np.log10(np.maximum(part[:, -k:].mean(axis=1), 1e-10)))
        low.append(10 * np.log10(np.maximum(part[:, :k].mean(axis=1), 1e-10)))
    top, low = np.array(top).T, np.array(low).T
    return top - low, low


def bpm(x: np.ndarray, rate: int = RATE, hop: int = 512) -> float:
    """Tempo from the autocorrelation of energy onsets between 40 and 208 beats a minute."""
    m = len(x) // hop
    if m < 4:
        return float("nan")
    e = (x[: m * hop].reshape(m, hop) ** 2).sum(axis=1)
    onset = np.maximum(np.diff(np.log1p(e)), 0)
    onset -= onset.mean()
    lags = np.arange(max(1, int(60 * rate / hop / 208)), min(len(onset) - 1, int(60 * rate / hop / 40)) + 1)
    if not len(lags):
        return float("nan")
    score = [float(onset[:-k] @ onset[k:]) for k in lags]
    return float(60 * rate / hop / lags[int(np.argmax(score))])


# The two filters of the K weighting, as centre in Hz, quality, and gain in dB of the shelf.
SHELF = (1681.974450955533, 0.7071752369554196, 3.999843853973347)
HIGH_PASS = (38.13547087602444, 0.5003270373238773)


def k_weighting(freq: np.ndarray, rate: int) -> np.ndarray:
    """The complex response of the K weighting's two second-order filters at frequencies in Hz."""
    z = np.exp(-2j * np.pi * freq / rate)
    k = np.tan(np.pi * SHELF[0] / rate)
    high = 10 ** (SHELF[2] / 20)
    mid = high**0.4996667741545416
    out = (high + mid * k / SHELF[1] + k * k + 2 * (k * k - high) * z + (high - mid * k / SHELF[1] + k * k) * z * z) / (1 + k / SHELF[1] + k * k + 2 * (k * k - 1) * z + (1 - k / SHELF[1] + k * k) * z * z)
    k = np.tan(np.pi * HIGH_PASS[0] / rate)
    norm = 1 + k / HIGH_PASS[1] + k * k
    return out * (1 - 2 * z + z * z) / (1 + 2 * (k * k - 1) / norm * z + (1 - k / HIGH_PASS[1] + k * k) / norm * z * z)


def _block_powers(x: np.ndarray, size: int, step: int) -> np.ndarray:
    """Summed mean squares of the channels over blocks; a signal shorter than a block is one."""
    squares = np.concatenate([[0.0], np.cumsum((x * x).sum(axis=1))])
    size = max(1, min(len(x), size))
    at = np.arange(0, len(x) - size + 1, max(1, step))
    return (squares[at + size] - squares[at]) / size


def loudness(x: np.ndarray, rate: int = RATE) -> tuple[float, float]:
    """(integrated loudness, loudness range) of EBU R 128, for a mono signal or channels along the last axis.

    K weighting; 400 ms blocks every 100 ms, gated at -70 and then at 10 below their mean; the range is that from the
    10th to the 95th percentile of 3 s blocks, gated at -70 and then at 20 below their mean.  NaN without a signal.
    """
    if not len(x):
        return float("nan"), float("nan")
    x = x.reshape(len(x), -1)
    padded = 2 * len(x)
    heard = np.fft.irfft(np.fft.rfft(x, padded, axis=0) * k_weighting(np.fft.rfftfreq(padded, 1 / rate), rate)[:, None], padded, axis=0)[: len(x)]
    level = lambda power: -0.691 + 10 * np.log10(np.maximum(power, 1e-12))

    def gated(power: np.ndarray, below: float) -> np.ndarray:
        held = power[level(power) > -70] if (level(power) > -70).any() else power
        return held[level(held) > level(held.mean()) - below]

    blocks = gated(_block_powers(heard, int(0.4 * rate), int(0.1 * rate)), 10)
    long = level(gated(_block_powers(heard, 3 * rate, int(0.1 * rate)), 20))
    return float(level(blocks.mean())), float(np.percentile(long, 95) - np.percentile(long, 10))


def chroma(freqs: np.ndarray, mags: np.ndarray) -> np.ndarray:
    out = np.zeros(12)
    ok = freqs > 20
    np.add.at(out, np.round(12 * np.log2(freqs[ok] / 440)).astype(int) % 12, mags[ok])
    return np.roll(out, 9)  # from A to C


def chord(profile: np.ndarray) -> str:
    """The best major or minor triad."""
    scores = [(profile[[i, (i + 4) % 12, (i + 7) % 12]].sum(), CHORD_NAMES[i]) for i in range(12)] + [(profile[[i, (i + 3) % 12, (i + 7) % 12]].sum(), CHORD_NAMES[i] + "m") for i in range(12)]
    return max(scores, key=lambda s: s[0])[1]


# How well each degree fits a major and a minor key, from listening tests.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


_KEY_NAMES = [f"{note}_{scale}" for scale in ("major", "minor") for note in CHORD_NAMES]
_KEYS = np.array([np.roll((np.array(d) - np.mean(d)) / np.std(d), i) for d in (MAJOR, MINOR) for i in range(12)])


def key_of(profile: np.ndarray) -> str:
    """The key whose degrees correlate best with a profile from C, as note_scale."""
    return _KEY_NAMES[int(np.argmax(_KEYS @ (profile - profile.mean())))]


def dissonance(f: np.ndarray, m: np.ndarray) -> float:
    """Mean roughness of the pairs of a frame's peaks, weighted by magnitude."""
    if len(f) < 2:
        return 0.0
    i, j = np.triu_indices(len(f), 1)
    d = np.abs(f[i] - f[j]) / (0.021 * np.minimum(f[i], f[j]) + 19)
    rough = np.exp(-0.84 * d) - np.exp(-1.38 * d)
    w = m[i] * m[j]
    return float((w * rough).sum() / w.sum()) if w.sum() else 0.0


def tristimulus(mags: np.ndarray) -> tuple[float, float, float]:
    total = mags.sum()
    return (float(mags[:1].sum() / total), float(mags[1:4].sum() / total), float(mags[4:].sum() / total)) if total else (0.0, 0.0, 0.0)


def pitch_salience(frame: np.ndarray) -> float:
    """The largest autocorrelation beyond the main lobe, relative to energy."""
    e = float(frame @ frame)
    if not e:
        return 0.0
    a = np.correlate(frame, frame, "full")[len(frame) :]
    first = int(np.argmax(a < 0)) if (a < 0).any() else 0
    return float(max(0.0, a[first:].max()) / e) if len(a[first:]) else 0.0


def resample(x: np.ndarray, source: int = RATE, target: int = 16_000) -> np.ndarray:
    """Linear interpolation at the target's times."""
    n = int(len(x) * target // source)
    return np.interp(np.arange(n) * source / target, np.arange(len(x)), x).astype(np.float32) if n else np.zeros(0, np.float32)


def mono(x: np.ndarray) -> np.ndarray:
    """Mean over channels, the last axis."""
    return x.mean(axis=-1) if x.ndim > 1 else x


def stats(x: np.ndarray, prefix: str, with_max: bool = False, skip_nan: bool = False) -> dict:
    """Mean and population deviation over frames, lists for vectors; empty input gives NaN."""
    mean, std = (np.nanmean, np.nanstd) if skip_nan else (np.mean, np.std)
    if not len(x) or (skip_nan and np.isnan(x).all()):
        x = np.full((1, *x.shape[1:]), np.nan)
        mean, std = np.mean, np.std
    out = {f"{prefix}_mean": mean(x, axis=0).tolist(), f"{prefix}_std": std(x, axis=0).tolist()}
    return out | {f"{prefix}_max": np.max(x, axis=0).tolist()} if with_max else out

"""Signal kernels over audio clips, and the Arrow stage that runs them.

The kernels are NumPy versions of published methods: autocorrelation pitch, periods by
guided peak picking, Burg linear prediction for formants. They are checked against
synthetic signals of known pitch, tilt and pauses; agreement with any particular
phonetics package is not claimed. What is relational about the features (runs, window
rates, percentiles) has a Spark version in :mod:`timbrel.operators.frames`.

Defined cases: an empty or silent clip gives 0 for every feature; a clip that cannot be
decoded gives a null row with the reason; undefined jitter or shimmer is 0 with
``nan_policy="zero"`` and NaN with ``"keep"``.
"""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.taxonomy import SCALARS

RATE, FRAME, HOP = 16_000, 400, 160
PITCH = (75.0, 500.0)
SILENCE_DB, MIN_PAUSE, MIN_SEGMENT = -40.0, 0.15, 0.03


def resample(y: np.ndarray, own: int, rate: int) -> np.ndarray:
    """``y`` from ``own`` to ``rate`` samples a second, by a windowed sinc that passes nothing above half of the lower rate.

    The time of an output sample between input samples takes few values, so the filter is a table
    with one row for each.
    """
    if own == rate or not len(y):
        return y
    g = math.gcd(own, rate)
    up, down = rate // g, own // g
    pass_ = 0.94 * min(1.0, rate / own)
    half = int(np.ceil(32 / pass_))
    taps = np.arange(-half + 1, half + 1)
    x = taps - (np.arange(up) * down % up / up)[:, None]
    table = np.sinc(pass_ * x) * (0.5 + 0.5 * np.cos(np.pi * np.clip(x / half, -1, 1)))
    table /= table.sum(axis=1, keepdims=True)
    padded = np.pad(y, half)
    n = int(len(y) * rate / own)
    out = np.empty(n)
    for i in range(0, n, 16_384):
        k = np.arange(i, min(n, i + 16_384))
        out[k] = (padded[(k * down // up)[:, None] + taps + half] * table[k % up]).sum(axis=1)
    return out


def decode(data: bytes, rate: int = RATE) -> np.ndarray:
    """Mono samples from -1 to 1 of a PCM wave file, brought to ``rate``."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, own = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        y = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        y = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2**23
    else:
        y = np.frombuffer(raw, {2: np.int16, 4: np.int32}[width]).astype(float) / 2 ** (8 * width - 1)
    return resample(y.reshape(-1, channels).mean(axis=1), own, rate)


def frames(y: np.ndarray, size: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Overlapping frames centred on every ``hop`` samples, zero-padded at the ends."""
    padded = np.pad(y, size // 2)
    if len(padded) < size:
        padded = np.pad(padded, (0, size - len(padded)))
    return np.lib.stride_tricks.sliding_window_view(padded, size)[:: hop][: 1 + len(y) // hop]


def rms_db(y: np.ndarray) -> np.ndarray:
    """Frame energy in dB below the loudest frame, at least -80."""
    rms = np.sqrt((frames(y) ** 2).mean(axis=1))
    top = max(rms.max(initial=0.0), 1e-5)
    return np.maximum(20 * np.log10(np.maximum(rms, 1e-5) / top), -80.0)


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """``[start, stop)`` of maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(int), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def pauses(db: np.ndarray, step: float = HOP / RATE) -> list[float]:
    return [(b - a) * step for a, b in runs(db <= SILENCE_DB) if (b - a) * step >= MIN_PAUSE]


def segments(db: np.ndarray, duration: float, step: float = HOP / RATE) -> list[tuple[float, float]]:
    """High-energy stretches as a stand-in for vowels; the whole clip if there are none."""
    loud = db[db > -80]
    if not len(loud):
        return [(0.0, duration)]
    out = [(a * step, b * step) for a, b in runs(db > np.percentile(loud, 40)) if (b - a) * step > MIN_SEGMENT]
    return out or [(0.0, duration)]


def pitch(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fundamental frequency (0 if unvoiced) and autocorrelation peak of each frame of three periods of the lowest pitch."""
    size = int(3 * RATE / PITCH[0])
    f = frames(y, size, HOP) * np.hanning(size)
    n = 1 << (2 * size - 1).bit_length()
    auto = np.fft.irfft(np.abs(np.fft.rfft(f, n)) ** 2)[:, :size]
    win = np.fft.irfft(np.abs(np.fft.rfft(np.hanning(size), n)) ** 2)[:size]
    norm = auto / np.maximum(auto[:, :1], 1e-12) / np.maximum(win / win[0], 1e-3)
    lo, hi = int(RATE / PITCH[1]), int(RATE / PITCH[0])
    part = norm[:, lo : hi + 1]
    # a shorter lag is preferred among nearly equal peaks
    best = np.argmax(part - 0.02 * np.log2(np.arange(lo, hi + 1) / lo), axis=1) + lo
    rows = np.arange(len(norm))
    a, b, c = norm[rows, best - 1], norm[rows, best], norm[rows, np.minimum(best + 1, size - 1)]
    shift = np.where(np.abs(a - 2 * b + c) > 1e-12, 0.5 * (a - c) / np.where(np.abs(a - 2 * b + c) > 1e-12, a - 2 * b + c, 1), 0.0)
    peak = np.clip(b, 0.0, 0.999999)
    loud = (f**2).mean(axis=1) > 1e-8
    return np.where((peak > 0.45) & loud, RATE / (best + np.clip(shift, -0.5, 0.5)), 0.0), np.where(loud, peak, 0.0)


def periods(y: np.ndarray, f0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths in seconds and peak heights of successive pitch periods within voiced runs."""
    lengths, heights = [], []
    for a, b in runs(f0 > 0):
        at, stop = a * HOP, min(len(y), b * HOP)
        step = RATE / f0[a]
        if stop - at < 2 * step:
            continue
        p = at + int(np.argmax(y[at : at + int(step) + 1]))
        marks = [p]
        while True:
            step = RATE / f0[min(p // HOP, b - 1)]
            lo, hi = int(p + 0.8 * step), int(p + 1.2 * step) + 1
            if hi >= stop:
                break
            p = lo + int(np.argmax(y[lo:hi]))
            marks.append(p)
        m = np.array(marks)
        m = m[(m > 0) & (m < len(y) - 1)]
        l, c, r = y[m - 1], y[m], y[m + 1]
        d = l - 2 * c + r
        fine = m + np.where(np.abs(d) > 1e-12, 0.5 * (l - r) / np.where(np.abs(d) > 1e-12, d, 1), 0)
        lengths.append(np.diff(fine) / RATE)
        heights.append(c)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0)
    return cat(lengths), cat(heights)


#: Least and greatest period in seconds, and the greatest ratios of successive periods and heights that count.
PERIODS, PERIOD_FACTOR, HEIGHT_FACTOR = (0.0001, 0.02), 1.3, 1.6


def perturbation(x: np.ndarray, counts: np.ndarray, factor: float) -> float:
    """Mean step between successive values, in percent of their mean; steps count between two values that count and differ at most by ``factor``. NaN if none does."""
    a, b = x[:-1], x[1:]
    fine = counts[:-1] & counts[1:] & (np.maximum(a, b) <= factor * np.minimum(a, b))
    if not fine.any():
        return float("nan")
    held = np.zeros(len(x), bool)
    held[:-1] |= fine
    held[1:] |= fine
    return float(np.abs(b - a)[fine].mean() / x[held].mean() * 100)


def voice_quality(y: np.ndarray, f0: np.ndarray, peak: np.ndarray, nan_policy: str = "zero") -> dict[str, float]:
    """Jitter and shimmer in percent, harmonics-to-noise ratio and spectral tilt."""
    t, h = periods(y, f0)
    none = 0.0 if nan_policy == "zero" else float("nan")
    counts = (t >= PERIODS[0]) & (t <= PERIODS[1])
    jitter, shimmer = perturbation(t, counts, PERIOD_FACTOR), perturbation(h, h > 0, HEIGHT_FACTOR)
    jitter, shimmer = (none if math.isnan(x) else x for x in (jitter, shimmer))
    r = np.clip(peak[f0 > 0], 1e-6, 0.999999)
    hnr = float((10 * np.log10(r / (1 - r))).mean()) if len(r) else 0.0
    return {"jitter": jitter, "shimmer": shimmer, "hnr": hnr, "spectral_tilt": spectral_tilt(y)}


def spectral_tilt(y: np.ndarray) -> float:
    """Slope of the mean spectrum from 50 to 5000 Hz, in dB an octave."""
    if not len(y):
        return 0.0
    power = (np.abs(np.fft.rfft(frames(y) * np.hanning(FRAME + 1)[:-1], axis=1)) ** 2).mean(axis=0)
    freq = np.fft.rfftfreq(FRAME, 1 / RATE)
    held = (freq >= 50) & (freq <= 5000)
    return float(np.polyfit(np.log2(freq[held]), 10 * np.log10(power[held] + 1e-10), 1)[0])


def onsets(db: np.ndarray, step: float = HOP / RATE) -> np.ndarray:
    """Times of rises in energy of at least 6 dB over 30 ms that are the steepest around."""
    rise = np.maximum(db[3:] - db[:-3], 0.0)
    out = [i for i in np.flatnonzero(rise >= 6.0) if rise[i] == rise[max(0, i - 5) : i + 6].max() and (i == 0 or rise[i - 1] < rise[i])]
    return (np.array(out, float) + 1.5) * step


def temporal(db: np.ndarray, duration: float, step: float = HOP / RATE) -> dict[str, float]:
    times, held = onsets(db, step), pauses(db, step)
    starts = np.arange(0, duration - 1.0, 0.5)
    local = [float(((times >= s) & (times < s + 1.0)).sum()) for s in starts]
    return {
        "speech_rate": len(times) / max(float((db > SILENCE_DB).sum()) * step, 0.1), "speech_rate_variation": float(np.std(local)) if local else 0.0,
        "pause_duration_mean": float(np.mean(held)) if held else 0.0, "pause_frequency": len(held) / max(duration, 0.1),
    }


def burg(x: np.ndarray, order: int) -> np.ndarray:
    """Linear prediction polynomial by Burg's recursion."""
    a, f, b = np.array([1.0]), x[1:].copy(), x[:-1].copy()
    for _ in range(order):
        k = -2 * (f @ b) / max(f @ f + b @ b, 1e-12)
        a = np.append(a, 0.0) + k * np.append(a, 0.0)[::-1]
        f, b = (f + k * b)[1:], (b + k * f)[:-1]
    return a


def formants(y: np.ndarray) -> tuple[list[float], list[float]]:
    """First and second formant of each frame that has them, up to 5500 Hz."""
    rate = 11_000
    if len(y) < FRAME:
        return [], []
    z = resample(y, RATE, rate)
    z = np.append(z[0], z[1:] - 0.98 * z[:-1])
    f1, f2 = [], []
    size = int(0.05 * rate)
    for x in frames(z, size, int(0.01 * rate)):
        if (x**2).mean() < 1e-10:
            continue
        roots = np.roots(burg(x * np.hanning(size), 10))
        roots = roots[np.imag(roots) > 0]
        freq, wide = np.angle(roots) * rate / (2 * np.pi), -np.log(np.maximum(np.abs(roots), 1e-9)) * rate / np.pi
        found = np.sort(freq[(freq > 90) & (freq < 5400) & (wide < 600)])
        f1 += found[:1].tolist()
        f2 += found[1:2].tolist()
    return f1, f2


def vowel_space(f1: list[float], f2: list[float]) -> float:
    """Half the product of the 10-90 % ranges of both formants; 0 below ten values."""
    if len(f1) < 10 or len(f2) < 10:
        return 0.0
    (a, b), (c, d) = np.percentile(f1, [10, 90]), np.percentile(f2, [10, 90])
    return float(0.5 * (b - a) * (d - c))


def prosody(y: np.ndarray, f0: np.ndarray, db: np.ndarray, spans: list[tuple[float, float]]) -> dict[str, list[float]]:
    """Per segment: level, spread and slope of pitch, level and spread of intensity, duration."""
    out: dict[str, list[float]] = {n: [] for n in ("pitch_level", "pitch_variation", "pitch_slope", "intensity_level", "intensity_variation", "duration")}
    rms = np.sqrt((frames(y) ** 2).mean(axis=1))
    level = 20 * np.log10(np.maximum(rms, 1e-5) / 2e-5)  # over the auditory threshold
    for start, end in spans:
        i, j = int(start * RATE / HOP), max(int(end * RATE / HOP), int(start * RATE / HOP) + 1)
        p, q = f0[i:j][f0[i:j] > 0], level[i:j]
        out["pitch_level"].append(float(p.mean()) if len(p) else 0.0)
        out["pitch_variation"].append(float(p.std()) if len(p) else 0.0)
        out["pitch_slope"].append(float(np.polyfit(np.linspace(0, end - start, len(p)), p, 1)[0]) if len(p) > 1 and end > start else 0.0)
        out["intensity_level"].append(float(q.mean()) if len(q) else 0.0)
        out["intensity_variation"].append(float(q.std()) if len(q) else 0.0)
        out["duration"].append(end - start)
    return out


def scalars(y: np.ndarray, spans: list[tuple[float, float]] | None = None, nan_policy: str = "zero") -> dict[str, float]:
    """All scalar features of one clip."""
    if not len(y) or not np.abs(y).max():
        return dict.fromkeys(SCALARS, 0.0)
    db, (f0, peak), duration = rms_db(y), pitch(y), len(y) / RATE
    seg = prosody(y, f0, db, spans or segments(db, duration))
    out = {f"{n}_mean": float(np.mean(v)) if v else 0.0 for n, v in seg.items()}
    f1, f2 = formants(y)
    out |= voice_quality(y, f0, peak, nan_policy) | temporal(db, duration)
    out |= {"f1_mean": float(np.mean(f1)) if f1 else 0.0, "f2_mean": float(np.mean(f2)) if f2 else 0.0, "vowel_space_area": vowel_space(f1, f2)}
    return {n: out[n] for n in SCALARS}


def extract(clips: DataFrame, keys: list[str], content: str = "content", nan_policy: str = "zero") -> DataFrame:
    """Scalar features of wave files held in a binary column, one row per clip, with ``error`` where decoding fails."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for data in pdf[content]:
                try:
                    rows.append({**scalars(decode(data), None, nan_policy), "error": None})
                except Exception as e:  # one bad file must not end the job
                    rows.append({**dict.fromkeys(SCALARS), "error": f"{type(e).__name__}: {e}"[:200]})
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(rows, columns=[*SCALARS, "error"])], axis=1)

    kinds = ", ".join(f"{k} {clips.schema[k].dataType.simpleString()}" for k in keys)
    return clips.select(*keys, content).mapInPandas(run, f"{kinds}, " + ", ".join(f"{n} double" for n in SCALARS) + ", error string")


def frame_energy(clips: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """``(keys.., frame, db)``: frame energies for relational operators such as runs."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(len(pdf)):
                db = rms_db(decode(pdf[content].iloc[i]))
                yield pd.DataFrame({**{k: [pdf[k].iloc[i]] * len(db) for k in keys}, "frame": np.arange(len(db), dtype=np.int64), "db": db})

    kinds = ", ".join(f"{k} {clips.schema[k].dataType.simpleString()}" for k in keys)
    return clips.select(*keys, content).mapInPandas(run, f"{kinds}, frame long, db double")


def synthetic(spark, n: int = 8, seconds: float = 2.0) -> DataFrame:
    """Clips of pulse tones of known pitch with one pause, ``(clip_id, f0, content)``, made on the executors."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                f0 = 100.0 + 20 * i
                t = np.arange(int(seconds * RATE)) / RATE
                y = sum(np.sin(2 * np.pi * f0 * h * t) / h for h in range(1, 8)) * 0.2
                y[int(0.9 * RATE) : int(1.2 * RATE)] = 0
                buf = io.BytesIO()
                with wave.open(buf, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(RATE)
                    w.writeframes((y * 32767).astype(np.int16).tobytes())
                out.append((i, f0, buf.getvalue()))
            yield pd.DataFrame(out, columns=["clip_id", "f0", "content"])

    return spark.range(n).mapInPandas(run, "clip_id long, f0 double, content binary")

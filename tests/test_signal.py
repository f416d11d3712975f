import numpy as np
import pytest

from timbrel.operators import signal as S

T = np.arange(2 * S.RATE) / S.RATE


def tone(f0, harmonics=8):
    return sum(np.sin(2 * np.pi * f0 * h * T) / h for h in range(1, harmonics)) * 0.2


@pytest.mark.parametrize("f0", [90, 120, 200, 330])
def test_pitch_of_a_tone(f0):
    got, _ = S.pitch(tone(f0))
    voiced = got[got > 0]
    assert len(voiced) > 0.9 * len(got) and abs(np.median(voiced) - f0) < 1


def test_a_glide_has_its_slope():
    f = 150 + 30 * T
    y = np.sin(2 * np.pi * np.cumsum(f) / S.RATE) * 0.5
    f0, _ = S.pitch(y)
    assert abs(S.prosody(y, f0, S.rms_db(y), [(0.2, 1.8)])["pitch_slope"][0] - 30) < 3


def test_a_steady_tone_has_little_jitter_and_noise_has_no_pitch():
    v = S.scalars(tone(150))
    assert v["jitter"] < 0.5 and v["shimmer"] < 2 and v["hnr"] > 20
    noise = np.random.default_rng(0).normal(0, 0.1, 2 * S.RATE)
    f0, _ = S.pitch(noise)
    assert (f0 > 0).mean() < 0.2


def test_resampling_keeps_what_fits_and_drops_what_would_fold_back():
    t = np.arange(44_100) / 44_100
    for f, left in ((440, 1.0), (3000, 1.0), (12_000, 0.0), (20_000, 0.0)):
        y = S.resample(np.sin(2 * np.pi * f * t), 44_100, 16_000)
        assert len(y) == 16_000
        middle = y[2000:-2000]
        assert abs(np.sqrt(2 * (middle**2).mean()) - left) < 0.01
        if left:
            assert np.abs(middle - np.sin(2 * np.pi * f * np.arange(16_000) / 16_000)[2000:-2000]).max() < 0.01
    up = S.resample(np.sin(2 * np.pi * 440 * np.arange(8000) / 8000), 8000, 16_000)
    assert np.abs(up - np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000))[1000:-1000].max() < 0.01
    assert S.resample(np.ones(100), 11_000, 16_000)[50] == pytest.approx(1) and len(S.resample(np.zeros(0), 8000, 16_000)) == 0


def test_perturbation_leaves_out_jumps():
    x = np.array([1.0, 1.1, 1.0, 2.0, 1.0, 1.1])
    assert S.perturbation(x, x > 0, 1.3) == pytest.approx(100 * 0.1 / np.mean([1.0, 1.1, 1.0, 1.0, 1.1]))
    assert np.isnan(S.perturbation(x[2:4], x[2:4] > 0, 1.3)) and np.isnan(S.perturbation(np.zeros(0), np.zeros(0, bool), 1.3))
    v = S.voice_quality(np.zeros(S.RATE), np.zeros(101), np.zeros(101), "keep")
    assert np.isnan(v["jitter"]) and np.isnan(v["shimmer"])


def test_pauses_are_measured():
    y = tone(150)
    y[int(0.8 * S.RATE) : int(1.2 * S.RATE)] = 0
    held = S.pauses(S.rms_db(y))
    assert len(held) == 1 and abs(held[0] - 0.4) < 0.04


def test_tilt_of_shaped_noise():
    spectrum = np.fft.rfft(np.random.default_rng(1).normal(size=2 * S.RATE))
    f = np.fft.rfftfreq(2 * S.RATE, 1 / S.RATE)
    y = np.fft.irfft(spectrum / np.maximum(f, 1))
    assert abs(S.spectral_tilt(y / np.abs(y).max()) + 6) < 1


def test_formants_of_a_resonance():
    y = np.zeros(2 * S.RATE)
    y[:: S.RATE // 110] = 1
    for f, bw in ((600, 60), (1500, 90)):
        r = np.exp(-np.pi * bw / S.RATE)
        a1, a2 = 2 * r * np.cos(2 * np.pi * f / S.RATE), -(r**2)
        out, p, q = np.zeros_like(y), 0.0, 0.0
        for i, x in enumerate(y):
            p, q = x + a1 * p + a2 * q, p
            out[i] = p
        y = out
    f1, f2 = S.formants(y / np.abs(y).max())
    assert abs(np.median(f1) - 600) < 60 and abs(np.median(f2) - 1500) < 120


def test_vowel_space():
    assert S.vowel_space([1.0] * 9, [1.0] * 20) == 0
    a, b = list(np.linspace(300, 800, 101)), list(np.linspace(1000, 2000, 101))
    assert abs(S.vowel_space(a, b) - 0.5 * 400 * 800) < 1e-6


@pytest.mark.parametrize("y", [np.zeros(0), np.zeros(1000), np.ones(3)])
def test_silent_and_tiny_clips(y):
    assert set(S.scalars(y)) == set(S.SCALARS) and all(np.isfinite(list(S.scalars(y).values())))


def test_bad_clips_are_reported(spark):
    df = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "id int, content binary")
    rows = S.extract(df, ["id"]).collect()
    assert all(r.error and r.jitter is None for r in rows)
    good = S.extract(S.synthetic(spark, 2), ["clip_id", "f0"]).collect()
    assert all(abs(r.pitch_level_mean - r.f0) < 2 and r.error is None for r in good)

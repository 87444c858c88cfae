import io
import math
import wave

import numpy as np
import pytest

from listenlake.sources import audio as A


def direct(x, rate, target):
    """Every output as a sum over all inputs."""
    cut, out = min(1.0, target / rate), []
    for n in range(max(1, len(x) * target // rate)):
        away = n * rate / target - np.arange(len(x))
        inside = np.sqrt(np.maximum(1 - (away * cut / A.ZEROS) ** 2, 0))
        out.append((x * np.where(np.abs(away) * cut <= A.ZEROS, cut * np.sinc(cut * away) * np.i0(A.BETA * inside) / np.i0(A.BETA), 0)).sum())
    return np.array(out)


@pytest.mark.parametrize("rate, target", [(44100, 16000), (16000, 44100), (8000, 16000), (48000, 44100), (3, 2), (22050, 22050)])
def test_resampling_is_the_direct_convolution(rate, target, monkeypatch):
    monkeypatch.setattr(A, "HELD", 7)
    x = np.random.default_rng(1).standard_normal(700)
    want = x if rate == target else direct(x, rate, target)
    assert np.allclose(A.resample(x, rate, target), want, atol=1e-9)


def test_tones_keep_their_pitch_and_what_the_rate_cannot_hold_goes():
    t = np.arange(44100) / 44100
    y = A.resample(np.sin(2 * math.pi * 440 * t), 44100, 16000)
    want = np.sin(2 * math.pi * 440 * np.arange(16000) / 16000)
    assert len(y) == 16000 and np.abs(y - want)[200:-200].max() < 1e-3
    assert np.abs(A.resample(np.sin(2 * math.pi * 12000 * t), 44100, 16000))[200:-200].max() < 1e-3
    assert len(A.resample(np.zeros(0), 44100, 16000)) == 0 and len(A.resample(np.ones(1), 44100, 16000)) == 1
    with pytest.raises(ValueError):
        A.resample(np.ones(3), 0, 16000)


def test_waveforms_at_one_rate(spark, tmp_path):
    for name, rate in (("a.wav", 8000), ("b.wav", 16000)):
        buffer = io.BytesIO()
        with wave.open(buffer, "wb") as w:
            w.setnchannels(2)
            w.setsampwidth(2)
            w.setframerate(rate)
            tone = (20000 * np.cos(2 * np.pi * 300 * np.arange(rate) / rate)).astype("<i2")
            w.writeframes(np.column_stack((tone, tone)).tobytes())
        (tmp_path / name).write_bytes(buffer.getvalue())
    (tmp_path / "c.wav").write_bytes(b"no audio")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in A.waveforms(A.list_audio(spark, str(tmp_path), "*.wav"), 16000).collect()}
    assert rows["c.wav"].rate is None and rows["c.wav"].error
    a, b = (np.array(rows[n].samples) for n in ("a.wav", "b.wav"))
    assert rows["a.wav"].rate == rows["b.wav"].rate == 16000 and abs(len(a) - len(b)) <= 2
    n = min(len(a), len(b)) - 200
    assert np.abs(a[200:n] / a[200:n].std() - b[200:n] / b[200:n].std()).max() < 0.02

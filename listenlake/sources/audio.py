"""Audio files, embeddings and sidecars as frames."""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

_FULL = {1: 128.0, 2: 2.0**15, 3: 2.0**23, 4: 2.0**31}


def list_audio(spark: SparkSession, root: str, pattern: str = "*.mp3") -> DataFrame:
    """Files below a folder: path, length, modification time and content; reading no content costs none."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)


def decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and float samples (frames x channels, in -1..1) of PCM audio of 8 to 32 bits."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float32) - 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32)
    return rate, (x / np.float32(_FULL[width])).reshape(-1, channels)


def prepare(samples: np.ndarray, floor_db: float = -45.0) -> np.ndarray:
    """Mono, scaled to a peak of 1, without silence at the ends."""
    x = samples.mean(axis=1) if samples.ndim == 2 else samples
    peak = float(np.abs(x).max(initial=0))
    if peak == 0:
        return x[:0]
    x = x / peak
    loud = np.flatnonzero(np.abs(x) > 10 ** (floor_db / 20))
    return x[loud[0] : loud[-1] + 1]


ZEROS, BETA, HELD = 32, 12.0, 1 << 16  # zero crossings of the sinc on each side, the window's shape, outputs computed at a time


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Mono samples at another rate: a sinc under a Kaiser window, cut off at the lower rate's half, a filter a phase.

    Output n stands at n * rate / target input samples. With rates in lowest terms it has one of target / gcd phases, so
    that many short filters serve all outputs. Samples outside count as 0; as many outputs as fit into the input's time.
    """
    if rate <= 0 or target <= 0:
        raise ValueError("rates must be positive")
    if rate == target or len(x) == 0:
        return x
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    cut = min(1.0, target / rate)
    half = math.ceil(ZEROS / cut)
    at = np.arange(-half + 1, half + 1)
    n_out = max(1, len(x) * up // down)
    padded = np.concatenate((np.zeros(half), x.astype(np.float64), np.zeros(half + 1)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * half)
    out = np.empty(n_out)
    for phase in range(min(up, n_out)):
        away = phase * down % up / up - at  # of each tap from the output, in input samples
        inside = np.sqrt(np.maximum(1 - (away * cut / ZEROS) ** 2, 0))
        taps = np.where(np.abs(away) * cut <= ZEROS, cut * np.sinc(cut * away) * np.i0(BETA * inside) / np.i0(BETA), 0.0)
        base = np.arange(phase, n_out, up) * down // up + 1
        for k in range(0, len(base), HELD):
            out[phase + k * up : phase + (k + HELD) * up : up] = windows[base[k : k + HELD]] @ taps
    return out


def waveforms(files: DataFrame, target_rate: int | None = None) -> DataFrame:
    """path, rate and prepared samples of binary files, at ``target_rate`` where one is given; content that is no PCM audio has a null rate and its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    rate, x = decode_wav(content)
                    x = resample(x.mean(axis=1), rate, target_rate or rate)
                    rows.append((path, target_rate or rate, prepare(x).astype(float).tolist(), None))
                except (wave.Error, EOFError, KeyError) as e:
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "rate", "samples", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, rate int, samples array<double>, error string")


def load_embeddings(files: DataFrame, size: int | None = None) -> DataFrame:
    """path and frames of .npz content: its array 'embedding', else 'postprocessed'; one vector is one frame; another width than ``size`` is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                with np.load(io.BytesIO(content)) as z:
                    x = np.atleast_2d(z["embedding"] if "embedding" in z else z["postprocessed"])
                if size is not None and x.shape[1] != size:
                    raise ValueError(f"{path}: vectors have {x.shape[1]} dimensions, not {size}")
                rows.append((path, x.astype(float).tolist()))
            yield pd.DataFrame(rows, columns=["path", "frames"])

    return files.select("path", "content").mapInPandas(run, "path string, frames array<array<double>>")


def sidecars(files: DataFrame, schema: str) -> DataFrame:
    """path and meta of JSON text files read whole; broken JSON gives nulls."""
    return files.select("path", F.from_json(F.col("content").cast("string"), schema, {"mode": "PERMISSIVE"}).alias("meta"))

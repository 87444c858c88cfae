"""Vectorised text primitives over Arrow string columns, used inside Spark tasks.

A batch of texts is handled as one byte buffer with document offsets, so that splitting
and hashing cost a few numpy passes a batch instead of Python work a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: The byte classes of the contracts' white space and of search words' separators.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240131))
_BYTES = _rng.integers(1, 2**63, size=(2, 256), dtype=np.int64).view(np.uint64)
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over all 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int, which: int = 0) -> np.ndarray:
    """The first n powers of an odd constant, modulo 2**64."""
    if len(_POWERS[which]) < n:
        size = max(1024, 1 << (int(n) - 1).bit_length())
        p = np.full(size, _ODD[which], np.uint64)
        p[0] = 1
        _POWERS[which] = np.multiply.accumulate(p)
    return _POWERS[which][:n]


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts (one more at the end); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside``; a run never crosses a row's border."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offs[:-1][offs[:-1] < n]] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes; spans ascend and don't overlap."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    cum = np.concatenate(([0], np.cumsum(lengths)))
    kind = np.int32 if len(buf) < 2**31 else np.int64
    at = np.arange(cum[-1], dtype=kind)
    at -= np.repeat(cum[:-1].astype(kind), lengths)  # place in the span
    longest = int(lengths.max())
    v = powers(max(longest, 1), which)[at]
    if cum[-1] == len(buf):
        v *= _BYTES[which][buf]
    else:
        at += np.repeat(starts.astype(kind), lengths)
        v *= _BYTES[which][buf[at]]
    full = lengths > 0
    out = np.zeros(len(starts), np.uint64)
    if full.any():
        out[full] = np.add.reduceat(v, cum[:-1][full])
    return mix64(out + lengths.astype(np.uint64) * _ODD[which])


def words(buf: np.ndarray, offs: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each row's first word (one more at the end)."""
    starts, ends = runs(~separators[buf], offs)
    return starts, ends, np.searchsorted(starts, offs)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of ``width`` consecutive hashes; windows that cross rows are the caller's to drop."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[j : j + n]
    return mix64(out)


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """A hash of a whole sequence of hashes."""
    n = len(hashes)
    x = (hashes * powers(n + 1, 1)[:n]).sum(dtype=np.uint64) + np.uint64(n)
    return mix64(np.array([x], np.uint64))[0]


def byte_slices(column: pa.Array, limit: int = 4 << 20):
    """(start, length) of runs of rows of about ``limit`` bytes together, one row at least."""
    lengths = np.diff(flat(column)[1])
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > limit:
            yield start, i - start
            start, held = i, 0
        held += int(n)
    if start < len(lengths):
        yield start, len(lengths) - start


def pieces(batches, column: str = "text", limit: int = 4 << 20):
    """The batches of a task, cut into record batches of a bounded number of text bytes."""
    for b in batches:
        if b.num_rows:
            for start, n in byte_slices(b.column(b.schema.get_field_index(column)), limit):
                yield b.slice(start, n)

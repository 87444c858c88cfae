"""Periodic runs of words, found through a suffix automaton of each document.

The end positions of the automaton's states are ordered sets, merged from the small into the large along the suffix links.
Where a merge makes two positions neighbours whose distance is at most the state's length, the text holds a square
there: the state's length says how far it reaches to the left, and comparing words on extends it to the right.

Only words that can lie in a run are given to the automaton. A run of period q has at least max(6, 4q) words, so each of its
three-word shingles comes three times in it: stretches of fewer than six words whose shingles all come three times in the
document hold no run. A document is one row of one task; its automaton takes about 1 KB a word of such stretches.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from listenlake.llm import _text as T
from listenlake.runtime import ship_package

LEAST, TIMES = 6, 4  # a run's least length in words, and in periods
SHINGLE, COMES = 3, 3  # what the filter of stretches counts
BLOCK = 512  # positions in a block of an ordered set
HASHED = 1 << 18  # words hashed or written at a time


class Positions:
    """An ordered set of numbers in sorted blocks, so that adding one moves few others."""

    def __init__(self, first: int):
        self.blocks, self.lasts, self.n = [[first]], [first], 1

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Add x; its neighbours before and after it."""
        k = min(bisect_left(self.lasts, x), len(self.blocks) - 1)
        block = self.blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else self.lasts[k - 1] if k else None
        after = block[i] if i < len(block) else None  # x is past its block only in the last one
        insort(block, x)
        self.lasts[k] = block[-1]
        self.n += 1
        if len(block) > 2 * BLOCK:
            self.blocks[k : k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.lasts[k : k + 1] = [block[BLOCK - 1], block[-1]]
        return before, after

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links and lengths of the states of the suffix automaton, and the state of each prefix."""
    nexts, links, lengths, prefixes = [{}], [-1], [0], []
    last = 0
    for w in words:
        cur = len(nexts)
        nexts.append({})
        links.append(0)
        lengths.append(lengths[last] + 1)
        prefixes.append(cur)
        p = last
        while p >= 0 and w not in nexts[p]:
            nexts[p][w] = cur
            p = links[p]
        if p >= 0:
            q = nexts[p][w]
            if lengths[q] == lengths[p] + 1:
                links[cur] = q
            else:
                clone = len(nexts)
                nexts.append(nexts[q].copy())
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                while p >= 0 and nexts[p].get(w) == q:
                    nexts[p][w] = clone
                    p = links[p]
                links[q] = links[cur] = clone
        last = cur
    return links, lengths, prefixes


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the maximal runs of at least six words and four periods, by start and period."""
    links, lengths, prefixes = automaton(words)
    sets: list[Positions | None] = [None] * len(links)
    for end, state in enumerate(prefixes):
        sets[state] = Positions(end)
    n, seeds = len(words), {}

    def seed(a: int | None, b: int | None, length: int) -> None:
        if a is not None and b is not None and b - a <= length:
            at = (a - length + 1, b - a)  # a run is known by its start and its period
            whole = at[0] == 0 or words[at[0] - 1] != words[b - length]  # else both came from one longer state, which has seen them
            if whole and at not in seeds:
                end = b + 1
                while end < n and words[end] == words[end - at[1]]:
                    end += 1
                seeds[at] = end - at[0]

    # Longer states first, so that a state's set is whole when it goes up its link; nothing meets at the root but the empty word.
    for state in sorted(range(1, len(links)), key=lengths.__getitem__, reverse=True):
        up, own = links[state], sets[state]
        sets[state] = None
        if up == 0 or own is None:
            continue
        held = sets[up]
        if held is None:
            sets[up] = own
            continue
        small, large = (own, held) if own.n < held.n else (held, own)
        for x in small:
            before, after = large.add(x)
            seed(before, x, lengths[up])
            seed(x, after, lengths[up])
        sets[up] = large
    best: dict[tuple[int, int], int] = {}
    for (start, period), length in seeds.items():  # positions that come between two others later leave seeds of a multiple of the period
        if length >= max(LEAST, TIMES * period):
            best[start, length] = min(period, best.get((start, length), period))
    return sorted(((start, length, period) for (start, length), period in best.items()), key=lambda r: (r[0], r[2]))


def stretches(hashes: np.ndarray) -> list[tuple[int, int]]:
    """Starts and ends of the stretches of words that can hold runs."""
    if len(hashes) < LEAST:
        return []
    _, kind, times = np.unique(T.rolling(hashes, SHINGLE), return_inverse=True, return_counts=True)
    often = times[kind] >= COMES
    starts, ends = T.runs(often, np.array([0, len(often)]))
    ends += SHINGLE - 1
    full = ends - starts >= LEAST
    return list(zip(starts[full].tolist(), ends[full].tolist(), strict=True))


def document_runs(hashes: np.ndarray, word) -> list[tuple[int, int, int]]:
    """All runs of a document; ``word(i)`` is the bytes of word i, which decide where hashes only suggest."""
    out = []
    for start, end in stretches(hashes):
        known: dict[bytes, int] = {}
        out += [(start + s, length, period) for s, length, period in runs_of([known.setdefault(word(i), len(known)) for i in range(start, end)])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def mutation(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(first word, period) of the repetition that one document in ten gets, or None."""
    h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *[T.span_hashes(buf, starts[i : i + HASHED], ends[i : i + HASHED]) for i in range(0, len(starts), HASHED)]])


def _joined_sha256(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray) -> str:
    """The digest of the words of ``order``, joined by one space; written in blocks."""
    digest = hashlib.sha256()
    for i in range(0, len(order), HASHED):
        s, lengths = starts[order[i : i + HASHED]], (ends - starts)[order[i : i + HASHED]]
        cum = np.concatenate(([0], np.cumsum(lengths + 1)))
        out = np.full(cum[-1], 0x20, np.uint8)
        inside = np.ones(cum[-1], bool)
        inside[cum[1:] - 1] = False
        out[inside] = buf[np.repeat(s - cum[:-1], lengths) + np.flatnonzero(inside)]
        digest.update(out[: len(out) - (i + HASHED >= len(order))].tobytes())
    return digest.hexdigest()


_OUT = pa.schema([
    ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
    ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
])


def _described(doc_id: int | None, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, repeat: bool) -> tuple:
    order = np.arange(len(starts))
    changed = mutation(doc_id, len(order)) if repeat else None
    if changed:
        a, p = changed
        order[a:] = a + (order[a:] - a) % p
        hashes = hashes[order]
    runs = document_runs(hashes, lambda i: buf[starts[order[i]] : ends[order[i]]].tobytes())
    dropped = np.zeros(len(order) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    best = (None, None, None)
    for run in runs:
        if best[1] is None or run[1] * best[2] > best[1] * run[2]:  # exact; runs come by start, then period
            best = run
    exponent = None if best[1] is None else 1000 * best[1] // best[2]
    kept = order[np.cumsum(dropped[:-1]) == 0]
    return len(runs), *best, exponent, hashlib.sha256(listed).hexdigest(), _joined_sha256(buf, starts, ends, kept)


def periodic_runs(docs: DataFrame, repeat: bool = True) -> DataFrame:
    """The documents' ids with their periodic runs; a row each.

    Words are ``[^\\x20\\x09-\\x0D]+``; with ``repeat``, one document in ten (by the crc32 of its id) is first made periodic from some word on. Returns
    doc_id, n_runs, the run of the greatest exponent (start, length, period, exponent_milli; ties: smallest start, then period; null without any), and the
    digests of all runs and of the words left when each run keeps its first period. Null and empty texts have no words; a row without an id keeps
    its words; repeated rows are each described; other columns, whatever their names, are not read; an empty table stays empty.
    """
    ship_package(docs.sparkSession)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.pieces(batches):
            buf, offs = T.flat(b.column(1))
            starts, ends, first = T.words(buf, offs, T.SPACE)
            hashes = _hashes(buf, starts, ends)
            rows = [_described(i, buf, starts[a:z], ends[a:z], hashes[a:z], repeat) for i, a, z in zip(b.column(0).to_pylist(), first[:-1], first[1:], strict=True)]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)]], names=["doc_id", *_OUT.names])

    fields = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(described, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {fields}")

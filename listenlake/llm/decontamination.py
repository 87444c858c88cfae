"""Benchmark decontamination with an FM-index per training shard.

A task cuts its documents into shards of a bounded number of words. Over each shard's word sequence it sorts
the suffixes, takes the Burrows-Wheeler transform, and ranks it with a wavelet matrix; words that no test
phrase holds share one symbol. All test phrases are then searched backwards at once, and the occurrences are
located by walking to sampled suffix positions. Hit words merge into removal spans. No document is shuffled, so
no frequent passage can gather in one task.

Tasks cut the benchmark into phrases. Pairs of a phrase and an item are dealt into blocks by hash, so a block is
bounded however long an item is and however many items hold a phrase. A pass over the documents searches a bounded
number of broadcast blocks in each shard's one index; only a benchmark beyond that takes a further pass.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from listenlake.llm import _text as T
from listenlake.runtime import discard, materialize, ship_package

_U = np.uint64
#: Text bytes of a shard (a longer document is a shard of its own), rows between sampled positions.
SHARD_BYTES, SAMPLE = 2 << 20, 8
#: Pairs of a phrase and an item in a broadcast block (about 5 MB), blocks searched in one pass over the documents.
BLOCK, PASS_BLOCKS = 50_000, 16


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of s (non-negative integers) in sorted order, by prefix doubling."""
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = max(1, int(s.max()).bit_length())
    step = max(1, 62 // (bits + 1))
    key = np.zeros(n, np.int64)
    for j in range(step):  # the first ``step`` symbols; past the end counts as less than any
        key <<= bits + 1
        key[: n - j] |= s[j:].astype(np.int64) + 1 if j < n else 0
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    rank = np.empty(n, np.int64)

    def set_ranks(at: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Ranks of the rows ``at`` (ascending): the row where their group starts. Returns rows in groups of several."""
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank[order[at]] = start
        alone = new & np.append(new[1:], True)
        return at[~alone]

    rows = set_ranks(np.arange(n), np.append(True, sorted_key[1:] != sorted_key[:-1]))
    while len(rows):
        pos = order[rows]
        ahead = pos + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        group = rank[pos]
        by = np.lexsort((second, group))
        order[rows] = pos[by]
        g, x = group[by], second[by]
        rows = set_ranks(rows, np.append(True, (g[1:] != g[:-1]) | (x[1:] != x[:-1])))
        step *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit plane at a time."""

    def __init__(self, s: np.ndarray, bits: int):
        self.planes, self.zeros, self.bits = [], [], bits
        for level in range(bits - 1, -1, -1):
            bit = (s >> level & 1).astype(bool)
            self.planes.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(s) - int(bit.sum()))
            s = np.concatenate((s[~bit], s[bit]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``at``."""
        start = np.zeros_like(at)
        for plane, zeros, level in zip(self.planes, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            one = (symbol >> level & 1).astype(bool)
            a, b = plane[at], plane[start]
            at = np.where(one, zeros + a, at - a)
            start = np.where(one, zeros + b, start - b)
        return at - start


class FMIndex:
    """Search and location of phrases in one sequence of symbols below ``sigma``."""

    def __init__(self, s: np.ndarray, sigma: int):
        order = suffix_order(s)
        n = len(s)
        # The empty suffix is row 0; its predecessor is the last symbol. The first suffix's predecessor is none: sigma.
        before = np.concatenate(([n], order)) - 1
        self.bwt = np.where(before >= 0, s[np.maximum(before, 0)], sigma) if n else np.array([sigma])
        self.wavelet = WaveletMatrix(self.bwt, max(1, int(sigma).bit_length()))
        self.start = 1 + np.concatenate(([0], np.cumsum(np.bincount(s, minlength=sigma + 1)))).astype(np.int64)
        self.full = np.concatenate(([n], order))
        sampled = self.full % SAMPLE == 0
        self.marked, self.samples = sampled, self.full[sampled]
        self.sample_row = np.cumsum(sampled) - 1
        del self.full

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of left-aligned phrases, all searched at once from their last symbols backwards."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            on = np.flatnonzero((lengths >= back) & (lo < hi))
            if len(on) == 0:
                break
            c = phrases[on, lengths[on] - back]
            lo[on] = self.start[c] + self.wavelet.rank(c, lo[on])
            hi[on] = self.start[c] + self.wavelet.rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: steps to the preceding suffix until one that is sampled."""
        out, walked, open_ = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            hit = self.marked[rows]
            out[open_[hit]] = self.samples[self.sample_row[rows[hit]]] + walked
            open_, rows = open_[~hit], rows[~hit]
            c = self.bwt[rows]
            rows = self.start[c] + self.wavelet.rank(c, rows)
            walked += 1
        return out


def _windows(width: int):
    """Rows (item, text) to rows (item, phrase): the word hashes of each window of ``width`` words, or of all words if there are fewer."""

    def run(batches):
        for b in T.pieces(batches):
            buf, offs = T.flat(b.column(1))
            buf = T.LOWER[buf]
            starts, ends, first = T.words(buf, offs, T.NOT_ALNUM)
            h = T.span_hashes(buf, starts, ends)
            for item, a, z in zip(b.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                for i in range(a, max(z - width, a) + 1, 1 << 16):
                    part = [h[j : min(j + width, z)].tobytes() for j in range(i, min(i + (1 << 16), max(z - width, a) + 1))] if z > a else []
                    yield pa.record_batch([pa.array([item] * len(part), pa.string()), pa.array(part, pa.binary())], names=["item", "phrase"])

    return run


class Phrases:
    """A block of test phrases: distinct windows as rows of words, and the items that hold each."""

    def __init__(self, pairs: list[tuple[bytes, str]]):
        held: dict[bytes, set[str]] = {}
        for window, item in pairs:
            own = held.setdefault(window, set())  # of an item without an id only the window counts
            if item is not None:
                own.add(item)
        wins = [np.frombuffer(k, np.uint64) for k in held]
        self.items = [sorted(v) for v in held.values()]
        self.words, at = np.unique(np.concatenate(wins), return_inverse=True) if wins else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.lengths = np.array([len(w) for w in wins], np.int64)
        self.rows = np.zeros((len(wins), int(self.lengths.max(initial=0))), np.int64)
        self.rows[np.arange(self.rows.shape[1]) < self.lengths[:, None]] = at


class Search:
    """Blocks of test phrases over one alphabet. Symbols: 0 is any word of no phrase, 1 a document's end, 2 and on the phrases' words."""

    def __init__(self, blocks: list[Phrases]):
        self.words = np.unique(np.concatenate([np.zeros(0, np.uint64), *(b.words for b in blocks)]))
        self.sigma = len(self.words) + 2
        self.blocks = [(b, np.searchsorted(self.words, b.words)[b.rows] + 2) for b in blocks if len(b.lengths)]

    def symbols(self, h: np.ndarray) -> np.ndarray:
        if len(self.words) == 0:
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at + 2, 0)


def shard_hits(texts: pa.Array, search: Search):
    """One shard: each row's word count, hit words' starts and ends in bytes, and items found."""
    buf, offs = T.flat(texts)
    buf = T.LOWER[buf]
    starts, ends, first = T.words(buf, offs, T.NOT_ALNUM)
    n_docs = len(offs) - 1
    s = np.ones(len(starts) + n_docs, np.int64)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    at = np.arange(len(starts)) + doc  # a document's end follows its words
    s[at] = search.symbols(T.span_hashes(buf, starts, ends))
    # Runs of words that no phrase holds can't be hit: one of each run is enough.
    other = s == 0
    keep = np.ones(len(s), bool)
    keep[1:] = ~(other[1:] & other[:-1])
    place = np.flatnonzero(keep)
    short = s[place]
    items: list[set[str]] = [set() for _ in range(n_docs)]
    hit = np.zeros(len(short) + 1, np.int64)
    index = FMIndex(short, search.sigma) if search.blocks and len(short) else None
    for block, rows in search.blocks if index else ():
        lo, hi = index.search(rows, block.lengths)
        found = np.flatnonzero(hi > lo)
        if len(found):
            count = (hi - lo)[found]
            which = np.repeat(found, count)
            pos = index.locate(np.repeat(lo[found] - np.cumsum(count) + count, count) + np.arange(count.sum()))
            np.add.at(hit, pos, 1)
            np.add.at(hit, pos + block.lengths[which], -1)
            of = np.searchsorted(first + np.arange(n_docs + 1), place[pos], "right") - 1
            for d, w in set(zip(of.tolist(), which.tolist(), strict=True)):
                items[d].update(block.items[w])
    on = np.zeros(len(s), bool)
    on[place] = np.cumsum(hit)[:-1] > 0
    word_hit = on[at]
    return np.diff(first), word_hit, starts, ends, first, offs, items


_SPAN = "struct<first:int,last:int,start:int,end:int>"
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(blocks: list, text_at: int, passed: int, clean: bool):
    """Rows of ``passed`` columns plus earlier passes' items and spans, to the same with these blocks' added."""

    def run(batches):
        block = Search([pickle.loads(b.value) for b in blocks])
        for b in batches:
            for start, length in T.byte_slices(b.column(text_at), SHARD_BYTES) if b.num_rows else ():
                yield one(b.slice(start, length), block)

    def one(b: pa.RecordBatch, block: Search) -> pa.RecordBatch:
        n, word_hit, starts, ends, first, offs, items = shard_hits(b.column(text_at), block)
        hits, spans, found = [], [], []
        for d, (old_items, old_spans) in enumerate(zip(b.column(passed).to_pylist(), b.column(passed + 1).to_pylist(), strict=True)):
            a, z = int(first[d]), int(first[d + 1])
            for x in old_spans or ():
                word_hit[a + x["first"] : a + x["last"]] = True
            w = np.flatnonzero(np.diff(np.concatenate(([0], word_hit[a:z].astype(np.int8), [0])))).reshape(-1, 2)
            flat = [(p, q, int(starts[a + p] - offs[d]), int(ends[a + q - 1] - offs[d])) for p, q in w.tolist()]
            spans.append([dict(zip(("first", "last", "start", "end"), x, strict=True)) for x in flat])
            hits.append(int(word_hit[a:z].sum()))
            found.append(sorted(items[d].union(old_items or ())))
        columns = list(b.columns[:passed])
        if clean and any(spans):
            texts = columns[text_at].to_pylist()
            for d, cut in enumerate(spans):
                if cut:
                    raw, out, at = texts[d].encode(), [], 0
                    for x in cut:
                        out.append(raw[at : x["start"]])
                        at = x["end"]
                    texts[d] = b"".join([*out, raw[at:]]).decode()
            columns[text_at] = pa.array(texts, columns[text_at].type)
        return pa.record_batch(
            [*columns, pa.array(found, pa.list_(pa.string())), pa.array(spans, _SPANS), pa.array(n, pa.int64()), pa.array(hits, pa.int64())],
            names=[*b.schema.names[:passed], "items", "spans", "n_words", "n_hit"],
        )

    return run


def _build(batches):
    """Rows (block, item, phrase), sorted by block, to rows (block, blob): a pickled block each."""
    held, pairs = None, []
    done = lambda: pa.record_batch([pa.array([held], pa.int64()), pa.array([pickle.dumps(Phrases(pairs))], pa.binary())], names=["block", "blob"])
    for b in batches:
        for block, item, phrase in zip(*(b.column(k).to_pylist() for k in ("block", "item", "phrase")), strict=True):
            if pairs and block != held:
                yield done()
                pairs = []
            held = block
            pairs.append((phrase, item))
    if pairs:
        yield done()


def _blocks(benchmark: DataFrame, width: int, item_col: str, text_col: str) -> DataFrame:
    """A table (block, blob) of the benchmark's phrases in blocks of about BLOCK pairs."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    pairs = materialize(rows.mapInArrow(_windows(width), "item string, phrase binary").distinct(), "phrases")
    n = max(1, -(-pairs.count() // BLOCK))
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("phrase", "item"), F.lit(n)).cast("long"))
    blocks = materialize(dealt.repartition(n, "block").sortWithinPartitions("block").mapInArrow(_build, "block long, blob binary"), "phrase-blocks")
    discard(pairs)
    return blocks


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, clean: bool = True, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents with items (sorted item ids found), spans (of hit words), n_words and n_hit added.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. A phrase is ``width`` consecutive words of
    a test item, or all of its words if it has fewer; an item without words has none. A document's word inside
    any occurrence of a phrase is hit. Adjacent hit words merge into a span of word numbers [first, last) and
    UTF-8 byte offsets [start, end). With ``clean`` the spans are cut from the text, else the text stays as it is.
    Null text has no words; windows of items without an id hit words, but name no item; items of one id are one,
    and equal texts of several items name each; repeated rows are each treated; columns with the names of added ones are replaced; empty tables give empty results or no hits.
    """
    spark = docs.sparkSession
    ship_package(spark)
    added = ["items", "spans", "n_words", "n_hit"]
    kept = docs.drop(*[c for c in added if c != text_col])
    passed, text_at = len(kept.columns), kept.columns.index(text_col)
    out, schema = kept.withColumns({"items": F.lit(None).cast("array<string>"), "spans": F.lit(None).cast(f"array<{_SPAN}>")}), kept.schema
    full = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + f", items array<string>, spans array<{_SPAN}>, n_words long, n_hit long"
    blocks = _blocks(benchmark, width, item_col, item_text_col)
    ready, one_pass = blocks.select("blob").toLocalIterator(), []  # a partition, of a block or few, at a time
    earlier = None

    def scanned(last: bool) -> DataFrame:
        return out.select(*kept.columns, "items", "spans").mapInArrow(_scan(one_pass, text_at, passed, clean and last), full)

    for r in ready:
        if len(one_pass) == PASS_BLOCKS:
            out = materialize(scanned(False), "decontamination")
            discard(*[earlier] if earlier is not None else [])
            earlier, one_pass = out, []
        one_pass.append(spark.sparkContext.broadcast(bytes(r.blob)))
    discard(blocks)
    return scanned(True)

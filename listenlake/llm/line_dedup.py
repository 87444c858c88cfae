"""Line dedup by a sharded minimal perfect hash.

Distinct line hashes are counted with a map-side combined aggregation. Those that several documents hold
are dealt into shards by hash, and each shard becomes one row: the bitmaps of a minimal perfect hash and,
at the hash's slots, arrays of fingerprints, document counts and first holders. Documents then probe these
arrays: packed line hashes stream past their shard's arrays in one task, which answers with the lines to
drop. No line is joined to a line. A shard that holds very common lines is replicated over several tasks;
how often is a table of a row a shard, joined to the probes.

Lines of a single document, nearly all of a large corpus, are never dropped and so are not indexed: the index
grows with the lines that recur. The count array decides at probing time (``min_docs``). A fingerprint is the
line's second 64-bit hash: with 32 bits a few of 10**10 unindexed lines would match by chance and be lost.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from listenlake.llm import _text as T
from listenlake.runtime import discard, materialize, ship_package

_U = np.uint64
#: Line hashes in a shard, and probes of a shard's common lines that one task answers.
SHARD_KEYS, TASK_PROBES = 200_000, 500_000
_PROBE = np.dtype([("doc", "<i8"), ("print", "<i8"), ("line", "<u4"), ("h1", "<u8"), ("h2", "<u8")])


def line_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of each row, and each row's first line (one more at the end)."""
    breaks = np.flatnonzero(buf == 10)
    of = np.searchsorted(offs, breaks, "right") - 1
    count = 1 + np.bincount(of, minlength=len(offs) - 1)
    first = np.concatenate(([0], np.cumsum(count)))
    heads = np.zeros(first[-1], bool)
    heads[first[:-1]] = True
    starts = np.empty(first[-1], np.int64)
    starts[heads] = offs[:-1]
    starts[~heads] = breaks + 1
    ends = np.empty(first[-1], np.int64)
    last = np.zeros(first[-1], bool)
    last[first[1:] - 1] = True
    ends[last] = offs[1:]
    ends[~last] = breaks
    return starts, ends, first


def line_keys(texts: pa.Array, least: int):
    """Row, line number and two 64-bit hashes of each line whose key has ``least`` code points or more."""
    buf, offs = T.flat(texts)
    starts, ends, first = line_spans(buf, offs)
    solid = np.flatnonzero(~T.SPACE[buf])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = np.flatnonzero(b > a)
    s, e = solid[a[some]], solid[b[some] - 1] + 1
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    enough = points[e] - points[s] >= least
    some, s, e = some[enough], s[enough], e[enough]
    low = T.LOWER[buf]
    row = np.searchsorted(first, some, "right") - 1
    return row, some - first[row], T.span_hashes(low, s, e, 0), T.span_hashes(low, s, e, 1)


class PerfectHash:
    """Minimal perfect hash over distinct pairs of 64-bit keys: each level's bitmap holds the keys that no other meets there.

    Both halves place a key, so keys that share one half part at some level.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = []
        held = 0
        for bits in levels:
            rank = np.cumsum(bits) - 1 + held
            held += int(bits.sum())
            self.ranks.append(rank)
        self.size = held

    @staticmethod
    def places(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        x = T.mix64(h1 + T.mix64(h2 + _U((level + 1) * 0x9E3779B97F4A7C15 % 2**64))) >> _U(32)
        return (x * _U(size) >> _U(32)).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        pairs = np.lexsort((h2, h1))
        if ((np.diff(h1[pairs]) == 0) & (np.diff(h2[pairs]) == 0)).any():
            raise ValueError("the keys of a perfect hash must be distinct")
        levels = []
        while len(h1):
            size = 2 * len(h1) + 1
            at = cls.places(h1, h2, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            rest = ~bits[at]
            h1, h2 = h1[rest], h2[rest]
        return cls(levels)

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """A slot for each key; keys that aren't in the set get any slot, or -1."""
        out = np.full(len(h1), -1, np.int64)
        open_ = np.arange(len(h1))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self.places(h1[open_], h2[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return out


def pack_shard(h1: np.ndarray, h2: np.ndarray, count: np.ndarray, first: np.ndarray) -> bytes:
    """One shard: level sizes, bitmaps, fingerprints, document counts, first holders."""
    mph = PerfectHash.build(h1, h2)
    slot = mph.slots(h1, h2)
    arrays = [np.empty(len(h1), t) for t in ("<u8", "<u4", "<i8")]
    for a, v in zip(arrays, (h2, np.minimum(count, 2**32 - 1), first), strict=True):
        a[slot] = v
    head = struct.pack(f"<II{len(mph.levels)}I", len(h1), len(mph.levels), *map(len, mph.levels))
    return head + b"".join(np.packbits(b).tobytes() for b in mph.levels) + b"".join(a.tobytes() for a in arrays)


def load_shard(blob: bytes):
    """(perfect hash, fingerprints, document counts, first holders) of :func:`pack_shard`."""
    n, depth = struct.unpack_from("<II", blob)
    sizes = struct.unpack_from(f"<{depth}I", blob, 8)
    at, levels = 8 + 4 * depth, []
    for size in sizes:
        levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, (size + 7) // 8, at), count=size).astype(bool))
        at += (size + 7) // 8
    out = []
    for t, w in (("<u8", 8), ("<u4", 4), ("<i8", 8)):
        out.append(np.frombuffer(blob, t, n, at))
        at += n * w
    return PerfectHash(levels), *out


def _hashes(least: int):
    """Rows (h1, h2, doc): each row's distinct line keys."""

    def run(batches):
        for b in T.pieces(batches):
            row, _, h1, h2 = line_keys(b.column(1), least)
            _, keep = np.unique(T.mix64(h1 + T.mix64(h2 + T.mix64(row.astype(np.uint64)))), return_index=True)
            yield pa.record_batch(
                [pa.array(h1[keep].view(np.int64)), pa.array(h2[keep].view(np.int64)), b.column(0).take(pa.array(row[keep]))],
                names=["h1", "h2", "doc"],
            )

    return run


def _shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return ((h1 >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def _build(batches):
    """Sorted rows (shard, h1, h2, n, first) to rows (shard, blob), shard by shard."""
    held, rows = None, []

    def done():
        t = pa.Table.from_batches(rows)
        col = lambda c: t.column(c).to_numpy()
        blob = pack_shard(col("h1").view(np.uint64), col("h2").view(np.uint64), col("n"), col("first"))
        return pa.record_batch([pa.array([held], pa.int64()), pa.array([blob], pa.binary())], names=["shard", "blob"])

    for b in batches:
        s = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(s)) + 1), len(s)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                if rows and s[i] != held:
                    yield done()
                    rows = []
                held = int(s[i])
                rows.append(b.slice(i, j - i))
    if rows:
        yield done()


_PACKETS = "shard long, salt long, kind int, blob binary"


def _probes(least: int, shards: int):
    """Rows (shard, salt, kind 1, blob): a batch's line hashes packed by shard."""

    def run(batches):
        for b in T.pieces(batches):
            row, line, h1, h2 = line_keys(b.column(1), least)
            ids = b.column(0)
            rec = np.empty(len(row), _PROBE)
            rec["doc"] = ids.fill_null(-1).to_numpy(zero_copy_only=False)[row]
            rec["print"] = b.column(2).to_numpy(zero_copy_only=False)[row]
            rec["line"], rec["h1"], rec["h2"] = line, h1, h2
            known = ids.is_valid().to_numpy(zero_copy_only=False)[row]
            rec, shard = rec[known], _shard_of(h1[known], shards)
            order = np.argsort(shard, kind="stable")
            rec, shard = rec[order], shard[order]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)])) if len(shard) else np.zeros(1, np.int64)
            packed = [(int(shard[i]), int(rec["doc"][i]), 1, rec[i:j].tobytes()) for i, j in zip(cuts, cuts[1:], strict=False)]
            cols = list(zip(*packed, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["shard", "salt", "kind", "blob"])

    return run


def _answer(min_docs: int):
    """Sorted rows, each shard's arrays (kind 0) before its probes, to rows (doc, print, line) that lose their line."""

    def run(batches):
        loaded, shard = None, None
        for b in batches:
            lost = [np.zeros(0, _PROBE)]
            keys = zip(b.column("shard").to_pylist(), b.column("copy").to_pylist(), b.column("kind").to_pylist(), b.column("blob"), strict=True)
            for s, c, kind, blob in keys:
                if kind == 0:
                    loaded, shard = load_shard(blob.as_py()), (s, c)
                elif shard == (s, c):
                    mph, prints, count, first = loaded
                    rec = np.frombuffer(blob.as_buffer(), _PROBE)
                    slot = mph.slots(rec["h1"], rec["h2"])
                    lost.append(rec[(slot >= 0) & (prints[slot] == rec["h2"]) & (count[slot] >= min_docs) & (first[slot] != rec["doc"])])
            rec = np.concatenate(lost)
            columns = [pa.array(np.ascontiguousarray(rec[k]).astype(t)) for k, t in (("doc", np.int64), ("print", np.int64), ("line", np.int32))]
            yield pa.record_batch(columns, names=["doc", "print", "line"])

    return run


def dedup_lines(
    docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text", count_cols: tuple[str, str] = ("n_lines", "n_dropped"), min_docs: int = 2
) -> DataFrame:
    """The documents with ``text_col`` deduplicated, and how many lines each had and lost (``count_cols``, replaced if there).

    A text is split at \\n (null or empty: one empty line). A line's key is the line without ``[\\x20\\x09-\\x0D]``
    at its ends, A-Z lower-cased. A key of ``least`` or more code points that ``min_docs`` (2 at least) or more ids hold
    keeps its lines in the smallest id only. Rows of one id are one document: they hold their lines together, and a row
    loses only lines of its own text. A row without an id holds nothing and loses nothing. Other columns pass through;
    an empty table stays empty.
    """
    spark = docs.sparkSession
    ship_package(spark)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("print"))
    held = rows.mapInArrow(_hashes(least), "h1 long, h2 long, doc long").where("doc IS NOT NULL")
    held = held.distinct() if min_docs > 2 else held  # two documents show in the least and the greatest id: no shuffle of all lines
    counted = held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"))
    twice = materialize(counted.where("first < last").drop("last"), "line-counts")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-twice.count() // SHARD_KEYS))
    dealt = twice.select(F.shiftrightunsigned(F.shiftrightunsigned("h1", 32) * F.lit(shards), 32).alias("shard"), "h1", "h2", "n", "first")
    index = materialize(dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(_build, "shard long, blob binary"), "line-index")
    # A row a shard. Written, so that Spark knows its size: it is broadcast if it is small, else joined by a shuffle.
    load = F.ceil(F.sum("n") / F.lit(TASK_PROBES))
    copies = materialize(dealt.groupBy("shard").agg(F.when(load > 2, load).otherwise(1).cast("long").alias("copies")), "line-copies")
    arrays = index.join(copies, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), "blob")
    probes = rows.mapInArrow(_probes(least, shards), _PACKETS).join(copies, "shard")
    probes = probes.select("shard", F.pmod(F.xxhash64("salt"), F.col("copies")).alias("copy"), "kind", "blob")
    asked = arrays.union(probes).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    drops = asked.mapInArrow(_answer(min_docs), "doc long, print long, line int")
    lost = materialize(drops.groupBy(F.col("doc").alias("__id"), F.col("print").alias("__print")).agg(F.collect_set("line").alias("__lost")), "line-drops")
    discard(twice, index, copies)
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    total, gone = count_cols
    own = docs.drop(*count_cols)
    joined = own.join(lost, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text) == F.col("__print")), "left")
    joined = joined.withColumn("__lines", lines).withColumn("__lost", F.coalesce("__lost", F.array().cast("array<int>")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__lost")), lambda i: F.get("__lines", i))
    new = {text_col: F.array_join(kept, "\n"), total: F.size("__lines").cast("long"), gone: F.size("__lost").cast("long")}
    return joined.withColumns(new).drop("__id", "__print", "__lost", "__lines")

"""Token-id files with Re-Pair grammar compression.

Documents are dealt to tasks by ranges of doc_id, so that shards ascend; a task encodes its documents and cuts
them into shards of a bounded number of ids. In each shard frequent pairs of neighbouring symbols are replaced
by nonterminals, round after round until none is frequent; pairs never cross documents. A shard stores its rules,
the rules' expansion lengths, and how many symbols and ids each document has, so one document, or a part of it, can
be decoded alone.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from listenlake.llm import _text as T, _vocab as V
from listenlake.runtime import ship_package

MAGIC = b"RPG1"
#: Ids of a shard (a longer document is a shard of its own), occurrences that a pair needs.
SHARD_IDS, LEAST = 2_000_000, 24
_TABLE_BITS = 20


def _pair_codes(s: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Code of the pair that starts at each place; 2**64 - 1 where a document ends."""
    code = np.full(len(s), 2**64 - 1, np.uint64)
    code[:-1] = s[:-1].astype(np.uint64) << np.uint64(32) | s[1:]
    code[last] = 2**64 - 1
    return code


def _slot(code: np.ndarray) -> np.ndarray:
    return (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def compress(ids: np.ndarray, lengths: np.ndarray, least: int = LEAST):
    """Re-Pair until no pair occurs ``least`` times, over documents of ``lengths`` ids: (symbols, symbols of each document, rules, first rule of each round, base)."""
    s = ids.astype(np.uint32)
    base = int(s.max(initial=0)) + 1
    last = np.zeros(len(s), bool)
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    rules, levels = [np.zeros((0, 2), np.uint32)], [0]
    while len(s) > 1:
        code = _pair_codes(s, last)
        slot = _slot(code)
        bins = np.bincount(slot, minlength=1 << _TABLE_BITS)  # a pair is at most as frequent as its slot
        hot = bins[slot] >= least
        hot &= code != 2**64 - 1
        pairs, count = np.unique(code[hot], return_counts=True)
        enough = np.flatnonzero(count >= least)
        pick = enough[np.argsort(-count[enough], kind="stable")]
        if len(pick) == 0:
            break
        at = _slot(pairs[pick])
        _, one = np.unique(at, return_index=True)  # the most frequent of a slot
        chosen, at = pairs[pick[one]], at[one]
        table = np.full(1 << _TABLE_BITS, -1, np.int32)
        table[at] = np.arange(len(chosen))
        rule = table[slot]
        take = rule >= 0
        take[take] = chosen[rule[take]] == code[take]
        # Where chosen pairs overlap, every second one from the run's start is replaced.
        places = np.flatnonzero(take)
        fresh = np.append(True, np.diff(places) > 1)
        start = places[np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))]
        places = places[(places - start) % 2 == 0]
        new = base + levels[-1] + rule[places]
        s[places] = new
        last[places] = last[places + 1]
        keep = np.ones(len(s), bool)
        keep[places + 1] = False
        s, last = s[keep], last[keep]
        rules.append(np.column_stack((chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF))).astype(np.uint32))
        levels.append(levels[-1] + len(chosen))
    ends = np.flatnonzero(last) + 1
    sizes = np.zeros(len(lengths), np.int64)
    sizes[lengths > 0] = np.diff(np.concatenate(([0], ends)))
    return s, sizes, np.concatenate(rules), np.array(levels), base


def expansion_lengths(rules: np.ndarray, levels: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule stands for."""
    out = np.ones(len(rules), np.uint32)
    for a, b in zip(levels, levels[1:], strict=False):
        for side in (0, 1):
            x = rules[a:b, side].astype(np.int64) - base
            n = np.where(x >= 0, out[np.maximum(x, 0)], 1)
            out[a:b] = n if side == 0 else out[a:b] + n
    return out


def expand(s: np.ndarray, rules: np.ndarray, levels: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for."""
    s = s.astype(np.uint32)
    for a, b in reversed(list(zip(levels, levels[1:], strict=False))):
        is_rule = (s >= base + a) & (s < base + b)
        n = 1 + is_rule
        at = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.uint32)
        out[at] = s
        where = at[is_rule]
        pair = rules[s[is_rule].astype(np.int64) - base]
        out[where], out[where + 1] = pair[:, 0], pair[:, 1]
        s = out
    return s


def pack(doc_ids: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """A shard file's bytes: header, level starts, rules, expansion lengths, doc ids, ids and symbols of each document, symbols."""
    s, sizes, rules, levels, base = compress(ids, lengths)
    kind = "<u2" if base + len(rules) <= 65536 else "<u4"
    head = struct.pack("<4sIIIIII", MAGIC, len(doc_ids), len(rules), len(levels), base, len(s), int(kind[-1]))
    parts = (levels.astype("<u4"), rules.astype("<u4"), expansion_lengths(rules, levels, base).astype("<u4"), doc_ids.astype("<i8"), lengths.astype("<u4"), sizes.astype("<u4"), s.astype(kind))
    return head + b"".join(p.tobytes() for p in parts)


class Shard:
    """A shard file, decoded whole or one document at a time."""

    def __init__(self, blob):
        magic, docs, n_rules, n_levels, self.base, n, width = struct.unpack_from("<4sIIIIII", blob)
        if magic != MAGIC:
            raise ValueError("not a token-id shard")
        at = struct.calcsize("<4sIIIIII")
        out = []
        for kind, count in (("<u4", n_levels), ("<u4", 2 * n_rules), ("<u4", n_rules), ("<i8", docs), ("<u4", docs), ("<u4", docs), (f"<u{width}", n)):
            out.append(np.frombuffer(blob, kind, count, at))
            at += out[-1].nbytes
        levels, rules, self.expansions, self.doc_ids, self.lengths, self.sizes, self.symbols = out
        self.levels, self.rules = levels.astype(np.int64), rules.reshape(-1, 2)

    def all_ids(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.levels, self.base)

    def ids(self, k: int, i: int = 0, j: int | None = None) -> np.ndarray:
        """The ids i..j (exclusive) of the k-th document alone; only symbols that reach into them are expanded."""
        start = int(self.sizes[:k].sum())
        s = self.symbols[start : start + int(self.sizes[k])].astype(np.int64)
        i, j, _ = slice(i, j).indices(int(self.lengths[k]))
        n = np.ones(len(s), np.int64)
        rule = s >= self.base
        n[rule] = self.expansions[s[rule] - self.base]
        ends = np.cumsum(n)
        first, last = np.searchsorted(ends, i, "right"), np.searchsorted(ends, j, "left") + 1
        if i >= j:
            return np.zeros(0, np.uint32)
        skipped = i - int(ends[first] - n[first])
        return expand(s[first:last], self.rules, self.levels, self.base)[skipped : skipped + j - i]


def _write(path: str, end_id: int):
    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        docs, ids, lengths, held = [], [], [], 0

        def shard():
            n = np.concatenate(lengths)
            blob = pack(np.concatenate(docs), np.concatenate(ids), n)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([int(n.sum())], pa.int64()), pa.array([blob], pa.binary())], names=["part", "seq", "n_tokens", "shard"])

        for b in T.pieces(batches, limit=V.BATCH_BYTES):
            got, n = V.byte_bpe_ids(b.column(1), path)
            cum = np.cumsum(n)
            ids.append(np.insert(got.astype(np.uint32), cum, end_id))
            docs.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            lengths.append(n + 1)
            held += int(n.sum()) + len(n)
            if held >= SHARD_IDS:
                yield shard()
                seq += 1
                docs, ids, lengths, held = [], [], [], 0
        if held:
            yield shard()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts (null: empty), append ``end_id`` to each, and write shards at ``path`` in ascending id order.

    Rows (part, seq, n_tokens, shard) hold one shard file each; (part, seq) ascends with doc_id. Repeated rows are
    written as often as they come; rows of one id are in the order of their texts; rows without an id are left out, as no order is defined for them; other columns
    are ignored; an empty table writes no shards.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")  # ties of an id are ordered by their texts
    dealt.mapInArrow(_write(tokenizer, end_id), "part int, seq int, n_tokens long, shard binary").write.parquet(path)


def _read(batches):
    for b in batches:
        for part, seq, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            shard = Shard(blob.as_buffer())
            ids = shard.all_ids().astype("<u4")
            n = shard.lengths.astype(np.int64)
            cum = np.cumsum(n) - n
            crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(cum.tolist(), n.tolist(), strict=True)]
            size = len(n)
            yield pa.record_batch([pa.array([part] * size, pa.int32()), pa.array([seq] * size, pa.int32()), pa.array(shard.doc_ids), pa.array(cum), pa.array(n), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, decoded from the shards."""
    ship_package(spark)
    shards = spark.read.parquet(path)
    # Ids before each shard: sums of parts, then of the shards in a part; a row a part is all that one task orders.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    of_part = Window.partitionBy("part").orderBy("seq")
    starts = shards.select("part", "seq", (F.sum("n_tokens").over(of_part) - F.col("n_tokens")).alias("seq_start")).join(parts, "part")
    rows = shards.select("part", "seq", "shard").mapInArrow(_read, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("part_start") + F.col("seq_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")

"""Public tokenizers inside tasks: texts are cut where no token can reach across, and each distinct chunk is encoded once a batch."""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from listenlake.llm import _text as T

#: Text bytes that one call handles.
BATCH_BYTES = 2 << 20
#: Distinct chunks, and ids of them, that a Python worker keeps from batch to batch; beyond either it starts anew.
KEPT_CHUNKS, KEPT_IDS = 800_000, 8_000_000
#: Bytes beyond which a chunk is encoded whenever it comes and not kept.
LONG = 256
#: Marks that end a run of letters, in ASCII and in three bytes (full stop and commas of East Asian scripts, full-width marks).
MARKS = np.isin(np.arange(256), list(b",.;:!?"))
WIDE_MARKS = ("\u3001", "\u3002", "\uff01", "\uff0c", "\uff1a", "\uff1b", "\uff1f")


@functools.cache
def byte_bpe(path: str):
    """The tokenizers library's tokenizer of a file, without truncation or padding, one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.cache
def sentence_pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


_SOLID = np.zeros(256, bool)
for _a, _b in ((0x21, 0x7F), (0xC3, 0xE1), (0xE4, 0xEE), (0xF0, 0xF5)):
    _SOLID[_a:_b] = True
_WIDTH = np.array([1 + (i >= 0xC0) + (i >= 0xE0) + (i >= 0xF0) for i in range(256)])


def _solid_ends(buf: np.ndarray) -> np.ndarray:
    """True at the lead byte of a character that is certainly no white space: printable ASCII, two bytes from U+00C0 on, three
    bytes but for U+1000 to U+303F (which hold the wide spaces) and U+E000 to U+FEFF, and all of four bytes.
    """
    out = _SOLID[buf]
    for lead, least in ((0xE3, 0x81), (0xEF, 0xBC)):
        at = np.flatnonzero(buf == lead)
        out[at] = buf[np.minimum(at + 1, len(buf) - 1)] >= least
    return out


def _wide_letters(buf: np.ndarray) -> np.ndarray:
    """True at the lead byte of three-byte characters that are certainly letters: most Han characters and kana, and Hangul of two lead bytes."""
    out = np.zeros(len(buf), bool)
    if len(buf) > 2:
        a, b, c = buf[:-2], buf[1:-1], buf[2:]
        han = (a >= 0xE5) & (a <= 0xE8) | (a == 0xE9) & (b < 0xBF)
        kana = (a == 0xE3) & ((b == 0x81) & (c >= 0x81) | (b == 0x82) & ((c <= 0x96) | (c >= 0xA1)) | (b == 0x83) & (c <= 0xBA))
        out[:-2] = han | kana | (a == 0xEB) | (a == 0xEC)
    return out


def byte_bpe_breaks(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """True where a chunk starts: before a space, and on both sides of a line break, between two other characters, and between a letter and a mark.

    The byte-level pattern ends a token at each of these places whatever surrounds them. Where a neighbour may be white
    space, or a letter may be none, nothing is cut.
    """
    n = len(buf)
    if n == 0:
        return np.zeros(0, bool)
    solid = _solid_ends(buf)
    before, after = np.zeros(n + 1, bool), np.zeros(n + 1, bool)  # what ends, or starts, at i is no white space
    before[1:] = solid & (buf < 0x80)
    at = np.flatnonzero(solid & (buf >= 0x80))
    before[np.minimum(at + _WIDTH[buf[at]], n)] = True
    after[:n] = solid
    head = np.zeros(n + 1, bool)
    head[offs] = True
    lone = np.zeros(n + 1, bool)
    lone[:n] = before[:n] & after[1:] & ~head[:n] & ~head[1:]
    out = head[:n].copy()
    out |= lone[:n] & (buf == 0x20)
    line = lone[:n] & (buf == 0x0A)
    out |= line
    out[1:] |= line[:-1]
    letter = (buf & 0xDF >= 0x41) & (buf & 0xDF <= 0x5A) & (buf < 0x80)
    letter[1:] |= (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7) & (buf[1:] >= 0x80)  # U+00C0 to U+00FF
    mark = MARKS[buf]
    if (buf >= 0xE3).any():
        letter[np.flatnonzero(_wide_letters(buf)) + 2] = True  # a letter is marked at its last byte
        last = [tuple(x.encode()) for x in WIDE_MARKS]
        for a, b, c in last:
            mark[:-2] |= (buf[:-2] == a) & (buf[1:-1] == b) & (buf[2:] == c)
    out[1:] |= letter[:-1] & mark[1:] & ~head[1:n]
    return out


def piece_breaks(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """True where a chunk starts: at a line break, and at a run of spaces. No piece holds a space mark after another character."""
    n = len(buf)
    out = np.zeros(n + 1, bool)
    out[offs] = True
    out = out[:n]
    if n == 0:
        return out
    space = buf == 0x20
    run = space.copy()
    run[1:] &= ~space[:-1]
    run[3:] &= ~((buf[:-3] == 0xE2) & (buf[1:-2] == 0x96) & (buf[2:-1] == 0x81))  # a literal space mark joins the run
    return out | run | (buf == 0x0A)


_held: list = [None, None]


def held(key: tuple[str, str], make):
    """The one encoder that a Python worker keeps; asking for another (a later stage's) lets it go."""
    if _held[0] != key:
        _held[:] = [None, None]
        _held[:] = [key, make(key[1])]
    return _held[1]


class ChunkIds:
    """The ids of chunks by their 64-bit hashes, kept from batch to batch within bounds of chunks and of ids.

    Hashes lie in two sorted tables, an old one and a young one that is merged into it now and then, so that a small
    batch costs little. Long chunks lie behind the kept ids until the next batch.
    """

    def __init__(self, encode):
        self.encode = encode
        self.values, self.kept = np.zeros(1 << 16, np.uint32), 0
        self.old = self.young = self._table()

    @staticmethod
    def _table(hashes=(), starts=(), lengths=()):
        return np.asarray(hashes, np.uint64), np.asarray(starts, np.int32), np.asarray(lengths, np.int32)

    @staticmethod
    def _find(table, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a table, and whether each hash is there."""
        if len(table[0]) == 0:
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
        return at, table[0][at] == h

    @staticmethod
    def _merged(a, b):
        keys = np.concatenate((a[0], b[0]))
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate((a[1], b[1]))[order], np.concatenate((a[2], b[2]))[order]

    def _encoded(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the chunks' ids start, and how many there are; they are written from ``at`` on."""
        found = self.encode([buf[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]) if len(starts) else []
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        need = at + int(lengths.sum())
        if need > len(self.values):
            grown = np.zeros(1 << need.bit_length(), np.uint32)
            grown[:at] = self.values[:at]
            self.values = grown
        self.values[at:need] = np.fromiter((i for x in found for i in x), np.uint32, need - at)
        return at + np.cumsum(lengths) - lengths, lengths

    def __call__(self, buf: np.ndarray, offs: np.ndarray, breaks: np.ndarray):
        """(where each chunk's ids start in ``values``, how many there are, each row's first chunk and one more)."""
        starts = np.flatnonzero(breaks)
        ends = np.append(starts[1:], len(buf)).astype(np.int64) if len(starts) else starts
        h, first, inverse = np.unique(T.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.old[0]) > KEPT_CHUNKS or self.kept > KEPT_IDS:
            self.__init__(self.encode)
        new = ~(self._find(self.old, h)[1] | self._find(self.young, h)[1])
        long = new & (ends[first] - starts[first] > LONG)
        new &= ~long
        if new.any():
            at, n = self._encoded(buf, starts[first[new]], ends[first[new]], self.kept)
            self.kept += int(n.sum())
            self.young = self._merged(self.young, self._table(h[new], at, n))
        once = self._table(h[long], *self._encoded(buf, starts[first[long]], ends[first[long]], self.kept))
        start, count = np.zeros(len(h), np.int32), np.zeros(len(h), np.int32)
        for table in (self.old, self.young, once):
            at, known = self._find(table, h)
            start[known], count[known] = table[1][at[known]], table[2][at[known]]
        if len(self.young[0]) > 50_000 + len(self.old[0]) // 8:
            self.old, self.young = self._merged(self.old, self.young), self._table()
        return start[inverse], count[inverse], np.searchsorted(starts, offs)

    def ids(self, buf: np.ndarray, offs: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids, and each row's number of ids."""
        start, n, first = self(buf, offs, breaks)
        cum = np.cumsum(n)
        at = np.repeat((start - (cum - n)).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        return self.values[at], row_sums(n, first)

    def counts(self, buf: np.ndarray, offs: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        _, n, first = self(buf, offs, breaks)
        return row_sums(n, first)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each row's entries."""
    cum = np.concatenate(([0], np.cumsum(values)))
    return cum[first[1:]] - cum[first[:-1]]


def _byte_bpe_chunks(path: str) -> ChunkIds:
    return held(("byte_bpe", path), _new_byte_bpe_chunks)


def _piece_chunks(path: str) -> ChunkIds:
    return held(("pieces", path), _new_piece_chunks)


def _new_byte_bpe_chunks(path: str) -> ChunkIds:
    return ChunkIds(lambda chunks: [e.ids for e in byte_bpe(path).encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)])


def _new_piece_chunks(path: str) -> ChunkIds:
    # A line break put before a chunk keeps the library from adding its own first space: two ids to drop.
    return ChunkIds(lambda chunks: [x[2:] for x in sentence_pieces(path).encode([b"\n" + c for c in chunks], num_threads=1)])


def byte_bpe_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the rows' whole texts as the library encodes them, and each row's number of ids."""
    buf, offs = T.flat(texts)
    return _byte_bpe_chunks(path).ids(buf, offs, byte_bpe_breaks(buf, offs))


def _led(texts: pa.Array) -> pa.Array:
    """Texts with the space that sentencepiece puts before the first character; empty ones stay empty."""
    t = texts.cast(pa.large_string()).fill_null("")
    return pc.if_else(pc.equal(pc.binary_length(t), 0), pa.scalar("", pa.large_string()), pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), t, pa.scalar("", pa.large_string())))


def piece_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All piece ids of the rows' whole texts, and each row's number of ids."""
    buf, offs = T.flat(_led(texts))
    return _piece_chunks(path).ids(buf, offs, piece_breaks(buf, offs))


def piece_counts(texts: pa.Array, path: str) -> np.ndarray:
    """Each row's number of piece ids."""
    buf, offs = T.flat(_led(texts))
    return _piece_chunks(path).counts(buf, offs, piece_breaks(buf, offs))

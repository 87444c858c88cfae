"""BPE encoding by a prefix-sharing trie traversal, and decoding.

The distinct pre-tokens of a batch, sorted, are the leaves of a trie in depth-first order. Each trie node keeps
the last token of its prefix's encoding: the token t that ends the prefix such that the last token before t
and t stay apart when merged by rank. A node looks only at its ancestors' states, so words that share a
prefix share its encoding, and a word's ids are read by stepping back from its leaf, token by token.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from listenlake.llm import _text as T, _vocab as V
from listenlake.runtime import ship_package

#: Fixed value: the byte-level pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs of tokens whose verdict a Python worker keeps.
KEPT_PAIRS = 400_000


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in the vocabulary file: itself where printable, else U+0100 and on."""
    out, extra = {}, 0
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out[chr(b)] = b
        else:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class Vocabulary:
    """Tokens as bytes, merges by rank, and the special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.id_of = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(self.id_of[raw(a)], self.id_of[raw(b)]): (i, self.id_of[raw(a) + raw(b)]) for i, (a, b) in enumerate(merges)}
        self.token = {v: k for k, v in self.id_of.items()} | {v: k.encode() for k, v in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.longest: dict[bytes, int] = {}  # of the tokens that end in these two bytes
        for t in self.id_of:
            self.longest[t[-2:]] = max(self.longest.get(t[-2:], 0), len(t))
        self.apart: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        size = max(self.token) + 1
        self.lengths = np.array([len(self.token.get(i, b"")) for i in range(size)], np.int64)
        self.bytes = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(size)), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _best(self, ids: list[int]) -> tuple[int, int, int]:
        """(rank, place, new id) of the least merge, leftmost first; rank 2**60 if there is none."""
        low, at, new = 1 << 60, 0, 0
        a = ids[0]
        for i in range(1, len(ids)):
            b = ids[i]
            r = self.rank.get((a, b))
            if r is not None and r[0] < low:
                low, at, new = r[0], i - 1, r[1]
            a = b
        return low, at, new

    def merged(self, text: bytes) -> list[int]:
        """Plain merging by rank, for short strings."""
        ids = [self.id_of[text[i : i + 1]] for i in range(len(text))]
        while len(ids) > 1:
            low, at, new = self._best(ids)
            if low == 1 << 60:
                break
            ids[at : at + 2] = [new]
        return ids

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the encoding of a's bytes followed by b's is just a, b: no merge crosses before both are whole."""
        known = self.apart.get(a << 20 | b)
        if known is not None:
            return known
        sides = [[self.id_of[t[i : i + 1]] for i in range(len(t))] for t in (self.token[a], self.token[b])]
        best = [self._best(x) for x in sides]
        while True:
            cross = self.rank.get((sides[0][-1], sides[1][0]))
            k = 0 if best[0][0] <= best[1][0] else 1
            low, at, new = best[k]
            if cross is not None and (cross[0] < low or cross[0] == low and k == 1):
                known = False
                break
            if low == 1 << 60:
                known = sides == [[a], [b]]
                break
            sides[k][at : at + 2] = [new]
            best[k] = self._best(sides[k])
        if len(self.apart) > KEPT_PAIRS:
            self.apart.clear()
        self.apart[a << 20 | b] = known
        return known

    def stands(self, t: int) -> bool:
        """Whether a token's bytes are encoded as that token."""
        known = self.whole.get(t)
        if known is None:
            known = self.whole[t] = self.merged(self.token[t]) == [t]
        return known

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of distinct words in sorted order, by the trie's depth-first traversal."""
        out, before, state = [], b"", []
        id_of, longest, token = self.id_of, self.longest, self.token
        for w in words:
            shared = 0
            for x, y in zip(before, w, strict=False):
                if x != y:
                    break
                shared += 1
            del state[shared:]
            for end in range(shared + 1, len(w) + 1):
                for size in range(min(end, longest.get(w[max(0, end - 2) : end], 1)), 0, -1):
                    t = id_of.get(w[end - size : end])
                    if t is not None and (self.stands(t) if size == end else self.stay_apart(state[end - size - 1], t)):
                        state.append(t)
                        break
            ids, end = [], len(w)
            while end:
                t = state[end - 1]
                ids.append(t)
                end -= len(token[t])
            out.append(ids[::-1])
            before = w
        return out

    def encode_chunks(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of chunks: special strings are single ids, the rest is cut into pre-tokens, encoded once each."""
        parts = []
        for c in chunks:
            text = c.decode()
            pieces = self.cut.split(text) if self.cut and any(x in text for x in self.special) else [text]
            parts.append([self.special[p] if p in self.special else w.encode() for p in pieces for w in ([p] if p in self.special else self.pattern.findall(p))])
        words = sorted({w for p in parts for w in p if isinstance(w, bytes)})
        ids = dict(zip(words, self.encode_words(words), strict=True))
        return [[i for w in p for i in ([w] if isinstance(w, int) else ids[w])] for p in parts]

    def decode(self, ids: np.ndarray, n: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All rows' decoded bytes, and where each row's start (one more at the end)."""
        lengths = self.lengths[ids]
        cum = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - (cum - lengths), lengths)
        at += np.arange(len(at))
        ends = np.concatenate(([0], np.cumsum(n)))
        return self.bytes[at].tobytes(), np.concatenate(([0], cum))[ends]


class Encoder:
    """A vocabulary and the chunks that it has encoded."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.chunks = V.ChunkIds(self.vocab.encode_chunks)


def encoder(path: str) -> Encoder:
    return V.held(("trie", path), Encoder)


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the rows' whole texts, and each row's number of ids."""
    buf, offs = T.flat(texts)
    return encoder(path).chunks.ids(buf, offs, V.byte_bpe_breaks(buf, offs))


def _run(path: str, text_at: int, with_ids: bool):
    def run(batches):
        vocab = encoder(path).vocab
        for b in batches:
            for start, length in T.byte_slices(b.column(text_at), V.BATCH_BYTES) if b.num_rows else ():
                yield one(b.slice(start, length), vocab)

    def one(b: pa.RecordBatch, vocab: Vocabulary) -> pa.RecordBatch:
        ids, n = encode(b.column(text_at), path)
        wide = ids.astype("<u4")
        ends = np.concatenate(([0], np.cumsum(n)))
        raw, at = vocab.decode(ids, n)
        cut = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        # A decoder replaces bytes that are no UTF-8; ids of a whole text never leave any.
        decoded = [raw[p:q].decode("utf-8", "replace").encode() for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        columns = [*b.columns, pa.array(n, pa.int64()), pa.array([hashlib.sha256(wide[p:q]).hexdigest() for p, q in cut]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
        names = [*b.schema.names, "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(ids.astype(np.int32))))
            names.append("ids")
        return pa.record_batch(columns, names=names)

    return run


def encode_decode(docs: DataFrame, tokenizer: str, with_ids: bool = True, text_col: str = "text") -> DataFrame:
    """The documents with n_tokens, ids_sha256 (of little-endian 32-bit ids), decoded_sha256 (of the ids' decoded text) and, with ``with_ids``, ids.

    Whole texts are encoded as the tokenizers library does with this byte-level BPE file, without added special
    tokens, truncation or padding; special strings inside a text are single ids. Null text counts as empty and has
    no ids; repeated rows are each encoded; columns with the names of added ones are replaced, others pass through;
    an empty table stays empty.
    """
    ship_package(docs.sparkSession)
    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if with_ids else {})
    kept = docs.drop(*[c for c in added if c != text_col])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{k} {v}" for k, v in added.items()])
    return kept.mapInArrow(_run(tokenizer, kept.columns.index(text_col), with_ids), schema)

"""Quality rules with tokeniser fertility.

A public piece vocabulary with byte fallback measures each document: characters per token, share of byte
pieces and token entropy. Prose of a language and script keeps close to its median; junk (symbol soup, broken encodings,
endless repetition) leaves the band around it. The bands are fitted to all documents: exact medians, and medians of the
distances to them, by language, script and size, from histograms of thousandths (a few thousand counts a group, however
many documents). Groups of few documents have only fixed bands by script. Counting rules over words, lines and
repeated windows come before. Texts are tokenised once; the measured rows are written, and read again with the bands.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from listenlake.llm import _text as T, _vocab as V
from listenlake.runtime import discard, materialize, ship_package

#: Symbols that are counted, and the repeated window's width.
SYMBOLS = np.isin(np.arange(256), list(b"[#*$%&|<>]"[1:-1]))
REPEAT = 8

#: Fixed bands (least, most) by script: characters per token, share of byte pieces, token entropy as a share of what so many
#: tokens can reach (log2 of the smaller of tokens and ENTROPY_IDS). None: no bound.
ENTROPY_IDS = 1024
_WIDE = {"chars_per_token": (0.2, 8.0), "byte_share": (None, 0.97), "entropy_share": (0.25, None)}
BANDS = {
    "latin": {"chars_per_token": (1.2, 8.0), "byte_share": (None, 0.35), "entropy_share": (0.5, None)},
    "greek": {"chars_per_token": (0.6, 6.0), "byte_share": (None, 0.35), "entropy_share": (0.3, None)},
    "cyrillic": {"chars_per_token": (0.8, 6.0), "byte_share": (None, 0.35), "entropy_share": (0.5, None)},
    "hebrew": _WIDE, "arabic": _WIDE, "indic": _WIDE, "thai": _WIDE, "east_asian": _WIDE, "hangul": _WIDE, "other": _WIDE,
}
#: Fitted bands: documents that a group needs, and how many robust standard deviations from the median are inside.
GROUP_DOCS, WIDTHS = 30, {"chars_per_token": (4, None), "byte_share": (None, 4), "entropy_share": (4, None)}
#: Least robust standard deviation of each figure, in thousandths; fixed value: standard deviations in a median distance.
SPREAD, MAD = {"chars_per_token": 20, "byte_share": 50, "entropy_share": 8}, 1.4826

#: A script's range of two leading bytes of a character's UTF-8, first and last.
SCRIPTS = {
    "greek": [(0xCDB0, 0xCFBF)], "cyrillic": [(0xD080, 0xD3BF)], "hebrew": [(0xD690, 0xD7BF)], "arabic": [(0xD880, 0xDDBF)],
    "indic": [(0xE0A4, 0xE0B7)], "thai": [(0xE0B8, 0xE0B9)], "east_asian": [(0xE381, 0xE383), (0xE390, 0xE9BF)], "hangul": [(0xEAB0, 0xED9F)],
}

_SCHEMA = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "script": "string", "n_tokens": "long", "chars_per_token": "double", "byte_share": "double", "entropy_share": "double", "base_failed": "boolean", "kept": "boolean",
}


@functools.cache
def _byte_pieces(path: str) -> np.ndarray:
    """True for byte pieces, but for the line break, which has no other piece."""
    sp = V.sentence_pieces(path)
    return np.array([sp.is_byte(i) and sp.id_to_piece(i) != "<0x0A>" for i in range(sp.get_piece_size())])


def _per_row(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    cum = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return cum[offs[1:]] - cum[offs[:-1]]


def base_counts(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counting rules' figures of each row."""
    from listenlake.llm.line_dedup import line_spans

    n_rows = len(offs) - 1
    solid, lead = ~T.SPACE[buf], (buf & 0xC0) != 0x80
    starts, ends, first = T.words(buf, offs, T.SPACE)
    n_words = np.diff(first)
    ls, le, lf = line_spans(buf, offs)
    cum = np.concatenate(([0], np.cumsum(solid)))
    wordy = cum[le] > cum[ls]
    row = np.repeat(np.arange(n_rows), np.diff(lf))[wordy].astype(np.uint64)
    lines = T.mix64(T.span_hashes(buf, ls[wordy], le[wordy]) + T.mix64(row))
    _, one = np.unique(lines, return_index=True)
    n_dup = np.bincount(row.astype(np.int64), minlength=n_rows) - np.bincount(row[one].astype(np.int64), minlength=n_rows)
    of = np.repeat(np.arange(n_rows), n_words)
    hit = np.zeros(len(starts) + 1, np.int64)
    rolled = T.rolling(T.span_hashes(buf, starts, ends), REPEAT)
    if len(rolled):
        inside = np.flatnonzero(of[: len(rolled)] == of[REPEAT - 1 :])
        key = T.mix64(rolled[inside] + T.mix64(of[inside].astype(np.uint64)))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        at = inside[count[inverse] > 1]
        hit[at] += 1
        hit[at + REPEAT] -= 1
    repeated = np.cumsum(hit)[:-1] > 0
    return {
        "n_words": n_words, "word_chars": _per_row(solid & lead, offs), "n_symbols": _per_row(SYMBOLS[buf], offs), "n_dup_lines": n_dup,
        "n_repeat_words": np.bincount(of[repeated], minlength=n_rows), "chars": _per_row(lead, offs),
    }


def _scripts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The script of most letters in each row; latin if there are none, the first in the order of BANDS on a tie."""
    low, lead = buf | 0x20, buf >= 0xC3
    counts = {"latin": _per_row(((low >= 97) & (low <= 122) & (buf < 128)) | (buf >= 0xC3) & (buf <= 0xC9), offs)}
    if lead.any():
        two = buf.astype(np.uint16) << 8
        two[:-1] |= buf[1:]
        known = (buf >= 0xC3) & (buf <= 0xC9) | (buf < 0xC3)
        for name, ranges in SCRIPTS.items():
            own = np.zeros(len(buf), bool)
            for a, b in ranges:
                own |= (two >= a) & (two <= b)
            counts[name] = _per_row(own, offs)
            known |= own
        counts["other"] = _per_row((buf >= 0xC0) & ~known, offs)
    names = [k for k in BANDS if k in counts]
    return np.array(names)[np.argmax(np.stack([counts[k] for k in names]), axis=0)]


def script_of(text: str) -> str:
    buf, offs = T.flat(pa.array([text], pa.large_string()))
    return str(_scripts(buf, offs)[0])


def fertility(texts: pa.Array, path: str, chars: np.ndarray) -> dict[str, np.ndarray]:
    """Tokens, characters per token, byte share and entropy share of each row; 0 tokens: all 0."""
    ids, n = V.piece_ids(texts, path)
    ends = np.concatenate(([0], np.cumsum(n)))
    some = np.maximum(n, 1)
    row = np.repeat(np.arange(len(n), dtype=np.int64), n)
    pairs, count = np.unique(row << 20 | ids, return_counts=True)
    logs = np.bincount(pairs >> 20, weights=count * np.log2(count), minlength=len(n))
    entropy = np.log2(some) - logs / some
    most = np.log2(np.maximum(np.minimum(n, ENTROPY_IDS), 2))
    return {"n_tokens": n, "chars_per_token": chars / some, "byte_share": _per_row(_byte_pieces(path)[ids], ends) / some, "entropy_share": entropy / most}


def verdict(script: np.ndarray, figures: dict[str, np.ndarray], bands: dict) -> np.ndarray:
    """Whether each row is inside all bands of its script."""
    ok = np.ones(len(script), bool)
    for name, own in bands.items():
        of = script == name
        for what, (least, most) in own.items():
            x = figures[what]
            ok &= ~of | ((least is None or x >= least) & (most is None or x <= most))
    return ok


def _run(path: str, text_at: int, bands: dict, keep_text: bool):
    def run(batches):
        for b in batches:
            for start, length in T.byte_slices(b.column(text_at), V.BATCH_BYTES) if b.num_rows else ():
                yield one(b.slice(start, length))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(text_at)
        buf, offs = T.flat(texts)
        x = base_counts(buf, offs)
        script = _scripts(buf, offs)
        x |= fertility(texts, path, x["chars"])
        failed = (x["n_words"] < 20) | (100 * x["n_repeat_words"] > 30 * x["n_words"])
        x |= {"script": script, "base_failed": failed, "kept": ~failed & verdict(script, x, bands)}
        kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
        passed = [i for i in range(b.num_columns) if keep_text or i != text_at]
        return pa.record_batch([*(b.column(i) for i in passed), *(pa.array(x[k].tolist() if v == "string" else x[k], kinds[v]) for k, v in _SCHEMA.items())], names=[*(b.schema.names[i] for i in passed), *_SCHEMA])

    return run


def fitted_bands(measured: DataFrame) -> DataFrame:
    """Rows (band_lang, script, size) with the bounds of each figure, low_* and high_*, in thousandths, over all rows that pass the base rules."""
    keys = ["band_lang", "script", "size"]
    figures = list(WIDTHS)
    stacked = ", ".join(f"'{k}', CAST(floor({k} * 1000) AS LONG)" for k in figures)
    rows = measured.where("NOT base_failed").select(*keys, F.expr(f"stack({len(figures)}, {stacked}) AS (what, v)"))
    counts = materialize(rows.groupBy(*keys, "what", "v").agg(F.count("*").alias("n")), "quality-histograms")
    middle = counts.groupBy(*keys, "what").agg(F.expr("percentile(v, 0.5, n)").alias("m"), F.sum("n").alias("docs")).where(F.col("docs") >= GROUP_DOCS)
    around = counts.join(middle, [*keys, "what"]).groupBy(*keys, "what", "m").agg(F.expr("percentile(abs(v - m), 0.5, n)").alias("d"))
    sides = []
    for k, (below, above) in WIDTHS.items():
        own = F.col("what") == k
        spread = F.greatest(F.col("d") * MAD, F.lit(float(SPREAD[k])))
        sides += [F.max(F.when(own, F.col("m") - below * spread)).alias(f"low_{k}")] if below else []
        sides += [F.max(F.when(own, F.col("m") + above * spread)).alias(f"high_{k}")] if above else []
    bands = materialize(around.groupBy(*keys).agg(*sides), "quality-bands")
    discard(counts)
    return bands


def quality_rules(docs: DataFrame, tokenizer: str, bands: dict | None = None, text_col: str = "text", lang: Column | None = None, keep_text: bool = True) -> DataFrame:
    """The documents with the figures of ``_SCHEMA`` added.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text (null: none). base_failed: fewer than 20 words, or over 30 % of the
    words lie in 8-word windows that the text holds twice or more. kept: not base_failed, inside the fixed bands of
    the document's script (``bands``, else BANDS), and inside the band fitted to the documents of its language (``lang``;
    null or none given: all such rows are one language), script and number of tokens (by powers of two), if they are GROUP_DOCS
    or more. Repeated rows count as often as they come and agree; columns with the names of added ones are replaced, others
    pass through (the text only with ``keep_text``); an empty table stays empty.
    """
    ship_package(docs.sparkSession)
    kept = docs.drop(*[c for c in _SCHEMA if c != text_col])
    own = kept.withColumn("band_lang", F.coalesce(lang.cast("string") if lang is not None else F.lit(None).cast("string"), F.lit("")))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if keep_text or f.name != text_col] + [f"{k} {v}" for k, v in _SCHEMA.items()])
    rows = own.mapInArrow(_run(tokenizer, own.columns.index(text_col), bands or BANDS, keep_text), schema)
    measured = materialize(rows.withColumn("size", F.length(F.bin("n_tokens"))), "quality-measured")
    joined = measured.join(fitted_bands(measured), ["band_lang", "script", "size"], "left")
    inside = F.lit(True)
    for k, (below, above) in WIDTHS.items():
        v = F.floor(F.col(k) * 1000)
        inside &= F.coalesce(v >= F.col(f"low_{k}"), F.lit(True)) if below else F.lit(True)
        inside &= F.coalesce(v <= F.col(f"high_{k}"), F.lit(True)) if above else F.lit(True)
    names = [c for c in kept.columns if keep_text or c != text_col]
    return joined.withColumn("kept", F.col("kept") & inside).select(*[f"`{c}`" for c in names], *_SCHEMA)

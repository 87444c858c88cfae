"""Resampling of documents by importance for a target distribution, in two Arrow passes over hashed word runs.

The first pass counts each partition's features into a vector of 10,000 buckets with np.bincount; the vectors are merged by treeReduce.
The second gathers the buckets' gains, a broadcast of that fixed size, and sums them for each document with bincount weights.
Drawn documents are numbered in sorted ranges of their scores, so no task holds them all.

The crc32 of a run of words comes from those of its words: a checksum is linear, so words are hashed once and joined by
tables for the bytes that follow.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from listenlake.llm import _text as T
from listenlake.operators.windows import positions
from listenlake.runtime import discard, materialize, ship_package

BUCKETS, LONGEST = 10_000, 3
CHUNK = 1 << 18  # words whose runs are held at a time
TABLED = 64  # bytes that one table lookup passes over


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The checksum's table for one byte, and for 0 to TABLED zero bytes the tables that move each of a checksum's four bytes over them."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, np.uint32(0xEDB88320) ^ (byte >> 1), byte >> 1)
    over = np.empty((TABLED + 1, 4, 256), np.uint32)
    over[0] = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    for n in range(TABLED):
        over[n + 1] = byte[over[n] & 255] ^ (over[n] >> 8)
    return byte, over


_BYTE, _OVER = _crc_tables()


def crc32_of_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 of each span's bytes."""
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    sizes, at = lengths[order], starts[order]
    short = int(np.searchsorted(sizes, TABLED, "right"))
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for j in range(int(sizes[short - 1]) if short else 0):
        k = int(np.searchsorted(sizes[:short], j, "right"))  # longer ones go on
        c = crc[k:short]
        crc[k:short] = _BYTE[(c ^ buf[at[k:short] + j]) & 255] ^ (c >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(short, len(starts)):
        crc[i] = zlib.crc32(buf[at[i] : at[i] + sizes[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part of a joined text's crc32 that its beginning gives: the beginning's crc32 moved over the n bytes after it."""
    out, left, rest = crc.copy(), n.copy(), np.arange(len(n))
    while rest.size:
        step, c = np.minimum(left[rest], TABLED), out[rest]
        out[rest] = _OVER[step, 0, c & 255] ^ _OVER[step, 1, (c >> 8) & 255] ^ _OVER[step, 2, (c >> 16) & 255] ^ _OVER[step, 3, c >> 24]
        left[rest] -= step
        rest = rest[left[rest] > 0]
    return out


_SPACE = np.uint32(zlib.crc32(b" "))


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and chunks of (text, bucket) of every run of 1 to 3 words."""
    buf = T.LOWER[buf]
    starts, ends, first = T.words(buf, offs, T.NOT_ALNUM)
    n_words = np.diff(first)

    def chunks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        text, n = np.repeat(np.arange(len(n_words)), n_words), len(starts)
        for a in range(0, n, CHUNK):
            z = min(a + CHUNK + LONGEST - 1, n)
            own, lengths, doc = crc32_of_spans(buf, starts[a:z], ends[a:z]), (ends - starts)[a:z], text[a:z]
            spaced = own ^ moved(np.full(len(own), _SPACE), lengths)  # of a space and the word
            run = own[:CHUNK]
            for k in range(LONGEST):
                if k:
                    run = run[: len(own) - k]
                    run = moved(run, lengths[k : k + len(run)] + 1) ^ spaced[k : k + len(run)]
                whole = doc[: len(run)] == doc[k : k + len(run)]
                yield doc[: len(run)][whole], (run % BUCKETS)[whole]

    return n_words, chunks()


def _bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in T.pieces(batches):
            for _, bucket in features(*T.flat(b.column(0)))[1]:
                total += np.bincount(bucket, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = texts.select("text").mapInArrow(counted, "counts binary").rdd.map(lambda r: np.frombuffer(r.counts, np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(BUCKETS, np.int64)


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket in thousandths: the log of its smoothed share of the target over that of the source, rounded down."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """Weights of all documents for a target's distribution, and the rank of the ``percent`` drawn without replacement.

    Both frames have ``text``; a null one has no words. Returns doc_id, n_features, weight, score and rank, a row each. A document's score is its weight and a
    Gumbel number that its id fixes; of those with ``least_words`` words, the highest scores are drawn: rank is 1 for the
    highest and null for the others. Ties go to the smaller id, rows of one id by features, weight and their place in the input; a row without an
    id gets the number of an empty id and loses ties. Other columns, whatever their names, are not read; an empty table stays empty, an empty
    target has no features.
    """
    spark = docs.sparkSession
    ship_package(spark)
    gains = spark.sparkContext.broadcast(bucket_gains(_bucket_counts(docs), _bucket_counts(target)))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.pieces(batches):
            n_words, chunks = features(*T.flat(b.column(1)))
            n, weight = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
            for doc, bucket in chunks:
                n += np.bincount(doc, minlength=len(n))
                weight += np.bincount(doc, weights=gains.value[bucket], minlength=len(n)).astype(np.int64)  # whole numbers below 2**53
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words.astype(np.int64)), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(weighed, f"doc_id {kind}, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = materialize(rows.withColumns({"score": F.col("weight") + noise, "__row": F.monotonically_increasing_id()}), "scored")
    able = F.col("n_words") >= least_words
    keys = [able.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc(), F.col("__row").asc()]
    placed = positions(scored, keys, "rank", "long")
    drawn = percent * scored.where(able).count() // 100
    discard(scored)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") < drawn, F.col("rank") + 1).alias("rank"))


def resample_sql() -> str:
    """DuckDB SQL for :func:`importance_resample` over documents and benchmark, checksums computed byte by byte."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = " UNION ALL ".join(f"SELECT side, doc_id, array_to_string(w[i : i + {k}], ' ') AS f FROM word WHERE i + {k} <= len(w)" for k in range(LONGEST))
    step = "xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)"
    table = "SELECT i AS c0, i::BIGINT AS c, 0 AS n FROM range(256) t(i) UNION ALL SELECT c0, " + step + ", n + 1 FROM crc WHERE n < 8"
    return f"""
WITH RECURSIVE crc AS ({table}),
tab AS MATERIALIZED (SELECT list(c ORDER BY c0) AS t FROM crc WHERE n = 8),
text AS (SELECT 'd' AS side, doc_id, {words} AS w FROM documents UNION ALL SELECT 'b', NULL, {words} FROM benchmark),
word AS (SELECT side, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM text),
run AS ({runs}),
grouped AS MATERIALIZED (SELECT side, doc_id, f, count(*) AS n FROM run GROUP BY ALL),
hashed AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(f))), lambda k: ('0x' || substr(hex(encode(f)), 2 * k + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT f FROM grouped), tab),
bucketed AS MATERIALIZED (SELECT side, doc_id, bucket, sum(n) AS n FROM grouped JOIN hashed USING (f) GROUP BY ALL),
counts AS (SELECT range AS bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM range({BUCKETS}) LEFT JOIN bucketed ON bucket = range GROUP BY range),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + {BUCKETS}) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + {BUCKETS})))) AS g FROM counts),
weight AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM bucketed JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM text LEFT JOIN weight USING (doc_id) WHERE side = 'd'),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS r, count(*) FILTER (able) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= 5 * n // 100 THEN r END AS rank FROM placed"""

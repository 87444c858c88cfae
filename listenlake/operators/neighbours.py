"""Nearest neighbours of many songs at once: an index of random hyperplanes, and an exact join in blocks.

Of equal vectors only the k + 1 least ids can be in anyone's answer, and equal queries have one answer: both are reduced so before
anything is compared. The exact way compares blocks of queries, each of a bounded size, with one scan of the vectors; every task
keeps the best k of its rows. Products are taken in single precision first, and only rows that its error lets among the best are scored in
double precision; all pairs are compared, so the time is quadratic, the memory is not. The index puts each vector into a bucket per table by the signs of its products with random planes and
looks a query up in its own bucket and in those across its nearest planes. A bucket of too many rows or queries is compared in parts, each
part of its rows with each of its queries, so a task's memory is bounded and no row of it is left out; only the best k leave a part.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from listenlake.operators.similarity import METRICS
from listenlake.runtime import discard, materialize

BLOCK, CHUNK, TILE = 16384, 512, 2048  # queries of a broadcast block; queries and rows compared at a time
BUCKET, CAP = 256, 8192  # rows of a bucket as intended; rows or queries of a part of one, about
BITS = 60  # planes of a table, of which the first are used
SAMPLE = 100  # queries on whose exact answers the index is fitted
#: Comparisons that a moved copy of a vector costs (measured: some 10 us to write and shuffle it, some 4 ns to compare), and copies a vector at most.
MOVED, COPIES = 2500, 24
#: Tables and looked-up buckets per table that are tried, cheapest first.
SETTINGS = sorted(itertools.product((4, 8, 16, 32), (1, 4, 8)), key=lambda s: s[0] * s[1])
_FOUND = "q long, sha_id string, score double"


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def _units(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero vectors stay zero, so that their cosine with anything is 0."""
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def _scored(metric: str, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Similarities of a query and a row each, as one query's search gives them: cosine, 1 / (1 + distance) or 1 / (1 + |dot|)."""
    if metric == "cosine":
        return np.einsum("ij,ij->i", _units(queries), _units(rows))
    if metric == "dot":
        return 1 / (1 + np.abs(np.einsum("ij,ij->i", queries, rows)))
    return 1 / (1 + np.sqrt(((queries - rows) ** 2).sum(1)))


def _single(metric: str, queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(left, right, error, scale): single-precision factors whose product ascends with the score (for dot, its absolute value descends).

    Everything is divided by ``scale``; no product is off by more than its query's ``error``.
    """
    if metric == "cosine":
        queries, rows = _units(queries), _units(rows)
    size = [np.where(np.isfinite(n), n, 0) for n in (np.linalg.norm(queries, axis=1), np.linalg.norm(rows, axis=1))]
    unit = 2.0**-24 * (queries.shape[1] + 8)
    if metric == "euclidean":  # 2 q r - r r; the square of the distance is q q less that
        scale = max(size[0].max(), size[1].max(), 1e-150)
        q, r = queries / scale, rows / scale
        left, right = np.c_[2 * q, np.full(len(q), -1.0)], np.c_[r, (r * r).sum(1)]
        return left.astype(np.float32), right.astype(np.float32), np.full(len(q), 8 * unit), scale
    a, b = max(size[0].max(), 1e-150), max(size[1].max(), 1e-150)
    return (queries / a).astype(np.float32), (rows / b).astype(np.float32), 4 * unit * size[0] / a + 1e-30, a * b


def _needed(metric: str, least: np.ndarray, queries: np.ndarray, error: np.ndarray, scale: float) -> np.ndarray:
    """The least product (for dot, minus its largest absolute value) with which a row can still reach a query's ``least`` score."""
    if metric == "cosine":
        return least - error
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        x = 1 / least - 1
        x = x + 4e-15 * (1 + x)  # scores that doubles can't tell apart
        far = -x / scale if metric == "dot" else ((queries / scale) ** 2).sum(1) - (x / scale) ** 2 * (1 + 4e-15)
    return np.where(np.isfinite(least), far - error, -np.inf)


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of flat (query, id, score) rows, the k best of each query; ties take the least id."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return q[place < k], ids[place < k], scores[place < k]


def _compared(metric: str, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, held: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, id, score) of the k best rows of each query and of those that are ``held``, compared in tiles; in the queries' order."""
    at0 = held or (np.zeros(0, np.int64), ids[:0], np.zeros(0))
    names, place = np.unique(np.r_[at0[1], ids], return_inverse=True)  # ids as numbers of the same order
    at0, place = (at0[0], place[: len(at0[1])], at0[2]), place[len(at0[1]) :]
    order = np.argsort(place, kind="stable")
    place, rows = place[order], rows[order]
    out = []
    for b in range(0, len(queries), CHUNK):
        own = queries[b : b + CHUNK]
        first, last = np.searchsorted(at0[0], [b, b + len(own)])
        best = (at0[0][first:last] - b, at0[1][first:last], at0[2][first:last])
        for a in range(0, len(rows), TILE):
            tile = rows[a : a + TILE]
            left, right, error, scale = _single(metric, own, tile)
            s = left @ right.T
            if metric == "dot":
                s = np.negative(np.abs(s, out=s), out=s)
            ends = np.searchsorted(best[0], np.arange(len(own)), side="right")
            full = np.bincount(best[0], minlength=len(own)) >= k
            least = np.full(len(own), -np.inf)
            least[full] = best[2][ends[full] - 1]
            need = _needed(metric, least, own, error, scale)
            if not full.all() and s.shape[1] > k:
                short = np.flatnonzero(~full)
                need[short] = np.partition(s[short], s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 2 * error[short]
                need[short] -= _slack(metric, -need[short], scale)
            bound = np.nextafter(np.maximum(need, -3e38).astype(np.float32), np.float32(-np.inf))
            at, row = np.divmod(np.flatnonzero(s >= bound[:, None]), len(tile))
            if len(at):
                found = _scored(metric, own[at], tile[row])
                best = _best(np.r_[best[0], at], np.r_[best[1], place[a + row]], np.r_[best[2], found], k)
        out.append((best[0] + b, best[1], best[2]))
    number, where, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else at0
    return number, names[where], score


def _slack(metric: str, far: np.ndarray, scale: float) -> np.ndarray | float:
    """By how much products can differ whose scores doubles can't tell apart."""
    if metric == "cosine":
        return 0.0
    near = 8e-15 / scale  # of a dot product or distance of at most 1
    return near + 8e-15 * np.abs(far) if metric == "dot" else near * near + near * 4 + 8e-15


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=str) if len(column) else np.zeros(0, "<U1")


def _batch(found: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1].tolist(), pa.string()), pa.array(found[2], pa.float64())], names=["q", "sha_id", "score"])


def exact(rows: DataFrame, asked: DataFrame, k: int, metric: str) -> DataFrame:
    """(q, sha_id, score) of the k best of ``rows`` (sha_id, vector) for each of ``asked`` (q, vector): one scan a block of queries."""
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    numbered, out = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks))), []
    for block in range(blocks):
        own = numbered.where(F.col("block") == block).select("q", "vector").toArrow()  # about BLOCK rows
        shared = rows.sparkSession.sparkContext.broadcast((own["q"].to_numpy(), _matrix(own["vector"])))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, queries = shared.value
            held = (np.zeros(0, np.int64), np.zeros(0, "<U1"), np.zeros(0))
            for b in batches:
                if b.num_rows and len(q):
                    held = _compared(metric, queries, _ids(b.column(0)), _matrix(b.column(1)), k, held)
            yield _batch((q[held[0]], *held[1:]))

        out.append(materialize(rows.select("sha_id", "vector").mapInArrow(best, _FOUND), "neighbours"))
        shared.unpersist()
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


def planes(tables: int, dimensions: int) -> np.ndarray:
    """The random planes of each table, the same in every run."""
    return np.random.Generator(np.random.PCG64(977)).standard_normal((tables, BITS, dimensions))


def codes(vectors: np.ndarray, tables: int, probes: int = 1, bits: int = BITS) -> np.ndarray:
    """Each vector's codes (vectors, tables, probes): the signs as bits, first plane highest; further probes flip the nearest of the first ``bits`` planes."""
    product = np.einsum("nd,tbd->ntb", vectors, planes(tables, vectors.shape[1]))
    weight = np.left_shift(np.int64(1), np.arange(BITS - 1, -1, -1, dtype=np.int64))
    own = ((product > 0) * weight).sum(axis=2)
    near = np.argsort(np.abs(product[:, :, :bits]), axis=2)[:, :, : probes - 1]
    return np.concatenate((own[:, :, None], own[:, :, None] ^ weight[near]), axis=2)


def fitted(queries: np.ndarray, answers: list[np.ndarray], n: int, recall: float) -> tuple[int, int, int] | None:
    """(tables, probes, bits) of the cheapest index that finds ``recall`` of the sample's answers; None if comparing all rows costs no more.

    The rows and bits are compared, and the copies of vectors that the tables and probes move are counted as comparisons: their number is bounded
    by COPIES, so that what is shuffled grows with the vectors alone.
    """
    bits = min(BITS, max(1, math.ceil(math.log2(max(n, 2) / BUCKET))))
    for tables, probes in SETTINGS:
        copies = tables * (1 + probes)
        if copies > COPIES or tables * probes * n / 2**bits * 2 + MOVED * copies > n:
            continue
        hit = total = 0
        for q, own in zip(queries, answers, strict=True):
            if len(own):
                asked, held = codes(q[None], tables, probes, bits)[0] >> (BITS - bits), codes(own, tables)[:, :, 0] >> (BITS - bits)
                hit += (held[:, :, None] == asked[None]).any(axis=(1, 2)).sum()
                total += len(own)
        if total and hit >= recall * total:
            return tables, probes, bits
    return None


def _coded(df: DataFrame, key: str, kind: str, tables: int, probes: int, bits: int) -> DataFrame:
    """(table, code, key, vector): a row for each table and probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, TILE):
                part = b.slice(a, TILE)
                code = codes(_matrix(part.column(1)), tables, probes, bits)
                each = np.repeat(np.arange(part.num_rows), tables * probes)
                table = np.tile(np.repeat(np.arange(tables), probes), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(table, pa.int32()), pa.array(code.reshape(-1)), part.column(0).take(pa.array(each)), part.column(1).take(pa.array(each))], names=["table", "code", key, "vector"])

    return df.select(key, "vector").mapInArrow(run, f"table int, code long, {key} {kind}, vector array<double>")


def indexed(rows: DataFrame, asked: DataFrame, k: int, tables: int, probes: int, bits: int, whole: bool = False) -> DataFrame | None:
    """(q, sha_id, score) by cosine among all rows of the buckets that each query looks up.

    Rows and queries of a bucket of more than CAP are dealt to parts of about CAP each, and every part of its rows is compared with every part
    of its queries, so none is left out. With ``whole``, None if that costs more than comparing all rows, or moves more than COPIES copies of them.
    """
    by = ["table", "bucket"]
    bucket = F.shiftright("code", BITS - bits).alias("bucket")
    held = materialize(_coded(rows, "sha_id", "string", tables, 1, bits).select("table", bucket, "sha_id", "vector"), "index")
    probed = materialize(_coded(asked, "q", "long", tables, probes, bits).select("table", bucket, "q", "vector"), "probes")
    size = lambda df, name: df.groupBy(by).agg(F.count(F.lit(1)).alias(name))
    met = size(held, "n").join(size(probed, "m"), by).withColumns({"n_parts": F.ceil(F.col("n") / CAP), "m_parts": F.ceil(F.col("m") / CAP)})
    met = materialize(met, "buckets")
    if whole:
        copied = F.sum(F.col("n").cast("double") * F.col("m_parts") + F.col("m") * F.col("n_parts"))
        cost = met.agg(F.sum(F.col("n").cast("double") * F.col("m")).alias("compared"), copied.alias("moved")).first()
        all_, queries = rows.count(), asked.count()
        if cost.compared is not None and (cost.compared + MOVED * cost.moved > all_ * queries or cost.moved > COPIES * max(all_, queries)):
            discard(held, probed, met)
            return None
    full = met.where("n_parts > 1 OR m_parts > 1").select(*by, "n_parts", "m_parts")

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Each row in its own part, once for each part of the other side."""
        part = lambda c: F.coalesce(c, F.lit(1).cast("long"))
        joined = df.join(full, by, "left").withColumn(f"{own}_part", F.pmod(F.xxhash64(key), part(F.col(f"{own}_parts"))))
        return joined.withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0).cast("long"), part(F.col(f"{other}_parts")) - 1))).select(*by, "n_part", "m_part", key, "vector")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_batch((np.zeros(0, np.int64), np.zeros(0, "<U1"), np.zeros(0)))])
        return pa.Table.from_batches([_batch((left["q"].to_numpy()[(found := _compared("cosine", _matrix(left["vector"]), _ids(right["sha_id"]), _matrix(right["vector"]), k))[0]], *found[1:]))])

    by_part = [*by, "n_part", "m_part"]
    probed, held = dealt(probed, "q", "m", "n"), dealt(held, "sha_id", "n", "m")
    return probed.groupBy(*by_part).cogroup(held.groupBy(*by_part)).applyInArrow(best, _FOUND).dropDuplicates(["q", "sha_id"])


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", recall: float | None = None) -> DataFrame:
    """(query, rank, sha_id, score): the ``k`` songs most similar to each of ``queries``, itself left out; both have sha_id and vector.

    Without ``recall`` the answer is exact. With it (cosine only), the index finds at least that share of the neighbours of a sample of SAMPLE queries,
    or else the exact way is taken, as it is where the buckets are so full that it costs no more. Ties take the least sha_id. Null vectors neither ask nor answer; zero vectors have cosine 0
    with all; ids should be distinct; no queries give no rows.
    """
    if metric not in METRICS or (recall is not None and metric != "cosine"):
        raise ValueError(f"metric {metric!r} is not one of {METRICS}, or has no index")
    whole = lambda df: df.select("sha_id", F.col("vector").cast("array<double>").alias("vector")).where("sha_id IS NOT NULL AND vector IS NOT NULL")
    copies = F.row_number().over(Window.partitionBy("vector").orderBy("sha_id"))
    rows = materialize(whole(vectors).withColumn("copy", copies).where(F.col("copy") <= k + 1).drop("copy"), "vectors")
    asked = materialize(whole(queries).select("vector").distinct().withColumn("q", F.monotonically_increasing_id()), "asked")
    setting = None
    if recall is not None:
        some = asked.orderBy(F.xxhash64("q")).limit(SAMPLE)
        best = _ranked(exact(rows, some, k + 1, metric), "q", k + 1).join(rows, "sha_id")
        known = {r.q: np.array(r.own, np.float64) for r in best.groupBy("q").agg(F.collect_list("vector").alias("own")).collect()}  # SAMPLE rows of k + 1 vectors
        sample = [r for r in some.collect() if r.q in known]
        setting = fitted(np.array([r.vector for r in sample]), [known[r.q] for r in sample], rows.count(), recall) if sample else None
    near = indexed(rows, asked, k + 1, *setting, whole=True) if setting else None
    found = materialize(exact(rows, asked, k + 1, metric) if near is None else near, "found")
    top = materialize(_ranked(found, "q", k + 1), "found")
    discard(found)
    who = whole(queries).select(F.col("sha_id").alias("query"), "vector").join(asked, "vector").select("query", "q")
    return _ranked(who.join(top.drop("rank"), "q").where("query <> sha_id"), "query", k).select("query", "rank", "sha_id", "score")


def _ranked(found: DataFrame, by: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "sha_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def recall_of(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of the true neighbours (query, sha_id) that were found."""
    hit = truth.select("query", "sha_id").join(found.select("query", "sha_id").withColumn("hit", F.lit(1)), ["query", "sha_id"], "left")
    return hit.agg(F.count(F.lit(1)).alias("pairs"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))

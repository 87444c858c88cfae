import numpy as np
import pytest
from pyspark.sql import functions as F

from listenlake.operators import neighbours as N


def frame(spark, m, ids=None):
    return spark.createDataFrame([(str(i) if ids is None else ids[i], [float(x) for x in v]) for i, v in enumerate(m)], "sha_id string, vector array<double>")


def brute(m, k):
    unit = m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
    s = unit @ unit.T
    ids = [str(i) for i in range(len(m))]
    return {(ids[i], j + 1): (ids[x], round(float(s[i, x]), 9)) for i in range(len(m)) for j, x in enumerate(sorted((x for x in range(len(m)) if x != i), key=lambda x: (-round(s[i, x], 12), ids[x]))[:k])}


def test_exact_neighbours_of_copies_zero_and_null_vectors(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "TILE", 5)
    rng = np.random.default_rng(3)
    m = np.vstack([rng.standard_normal((20, 6)), np.tile(rng.integers(1, 4, 6).astype(float), (15, 1)), np.zeros((2, 6))])
    v = frame(spark, m).union(spark.createDataFrame([("null", None)], "sha_id string, vector array<double>"))
    found = {(r.query, r["rank"]): (r.sha_id, round(r.score, 9)) for r in N.neighbours(v, v, 4).collect()}
    want = brute(m, 4)
    assert found.keys() == want.keys()
    assert all(abs(found[x][1] - want[x][1]) < 1e-9 for x in want)
    copies = {i: [str(x) for x in sorted(map(str, range(20, 35))) if x != i][:4] for i in map(str, range(20, 35))}
    assert all([found[i, j + 1][0] for j in range(4)] == own for i, own in copies.items())
    assert N.neighbours(v, v.limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        N.neighbours(v, v, 4, "dot", recall=0.9)


def clustered(n, of, dimensions=32, noise=0.15, seed=11):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // of, dimensions))
    return np.repeat(centres, of, axis=0) + noise * rng.standard_normal((n // of * of, dimensions))


def test_index_finds_nine_tenths_with_few_comparisons(spark, monkeypatch):
    m = clustered(6000, 12)
    v = frame(spark, m).repartition(4).cache()
    truth = N.neighbours(v, v, 10).select("query", "sha_id")
    monkeypatch.setattr(N, "BUCKET", 32)
    rows = v.withColumn("q", F.col("sha_id").cast("long"))
    setting = (4, 4, 8)
    found = N._ranked(N.indexed(v, rows.select("q", "vector"), 11, *setting), "q", 11).select(F.col("q").cast("string").alias("query"), "sha_id").where("query <> sha_id").cache()
    bucket = F.shiftright("code", N.BITS - 8).alias("bucket")
    held, asked = (N._coded(df, key, kind, 4, probes, 8).groupBy("table", bucket).count() for df, key, kind, probes in ((v, "sha_id", "string", 1), (rows, "q", "long", 4)))
    compared = held.join(asked.withColumnRenamed("count", "n"), ["table", "bucket"]).agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    assert compared < 0.12 * 6000 * 6000
    recall = N.recall_of(found, truth).first()
    assert recall.pairs == 60_000 and recall.recall >= 0.9
    chosen = N.neighbours(v, v, 10, recall=0.95)
    assert N.recall_of(chosen, truth).first().recall >= 0.9


def test_the_fit_takes_the_exact_way_where_no_index_is_cheaper():
    rng = np.random.default_rng(2)
    noise, close = rng.standard_normal((50, 64)), clustered(1000, 20)
    assert N.fitted(noise, [rng.standard_normal((10, 64)) for _ in noise], 2000, 0.9) is None
    assert N.fitted(close[::20], [close[i + 1 : i + 11] for i in range(0, 1000, 20)], 10_000_000, 0.9) is not None


def test_full_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(N, "CAP", 40)
    rng = np.random.default_rng(4)
    m = np.vstack([rng.standard_normal((1, 16)) + 0.01 * rng.standard_normal((400, 16)), rng.standard_normal((200, 16))])
    v = frame(spark, m)
    out = N.indexed(v, v.select(F.col("sha_id").cast("long").alias("q"), "vector"), 5, 4, 2, 2)
    assert out.groupBy("q").count().count() == 600  # everyone finds something
    rows = N._ranked(out, "q", 5).where("q < 400").select("score").collect()
    assert min(r.score for r in rows) > 0.99


def test_an_index_that_moves_many_copies_is_not_taken():
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    queries = unit(rng.standard_normal((60, 64)))
    answers = [unit(0.5 * q + 0.108 * rng.standard_normal((10, 64))) for q in queries]  # cosines of about one half
    for n in (20_000, 51_282, 600_000):
        setting = N.fitted(queries, answers, n, 0.9)
        assert setting is None or setting[0] * (1 + setting[1]) <= N.COPIES
    assert N.fitted(queries, answers, 51_282, 0.9) is None


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
@pytest.mark.parametrize("scale", [1.0, 1e-12, 1e12])
def test_few_rows_are_scored_in_double_precision(monkeypatch, metric, scale):
    rng = np.random.default_rng(7)
    m = rng.standard_normal((3000, 16))
    m[:100], m[100:120], m[120:125] = np.round(m[:100]), m[99] + 1e-9 * rng.standard_normal((20, 16)), 0
    m, ids = m * scale, np.array([str(x) for x in rng.permutation(3000)])
    scored, count = N._scored, []
    want = [np.lexsort((ids, -(s := scored(metric, np.repeat(q[None], len(m), 0), m))))[:7] for q in m[:150]]
    monkeypatch.setattr(N, "_scored", lambda f, q, r: count.append(len(q)) or scored(f, q, r))
    held = N._compared(metric, m[:150], ids[:1700], m[:1700], 7)
    number, found, _ = N._compared(metric, m[:150], ids[1700:], m[1700:], 7, held)
    assert [found[number == i].tolist() for i in range(150)] == [ids[w].tolist() for w in want]
    if scale >= 1 or metric == "cosine":
        assert sum(count) < 0.1 * 150 * 3000


def test_no_row_of_a_full_bucket_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(N, "CAP", 40)
    rng = np.random.default_rng(12)
    m = np.vstack([rng.standard_normal((1, 16)) + 1e-7 * rng.standard_normal((300, 16)), rng.standard_normal((50, 16))])  # 300 that no plane parts
    v = frame(spark, m)
    asked = v.select(F.col("sha_id").cast("long").alias("q"), "vector")
    best = {(r.q, r["rank"]): r.sha_id for r in N._ranked(N.indexed(v, asked, 5, 2, 1, 2), "q", 5).where("q < 300").collect()}
    want = {(r.q, r["rank"]): r.sha_id for r in N._ranked(N.exact(v, asked, 5, "cosine"), "q", 5).where("q < 300").collect()}
    assert len(want) == 1500 and best == want


def test_where_buckets_are_full_the_exact_way_is_taken(spark, monkeypatch):
    monkeypatch.setattr(N, "MOVED", 1)
    rng = np.random.default_rng(13)
    spread, one = clustered(2000, 10), rng.standard_normal((1, 32)) + 1e-3 * rng.standard_normal((2000, 32))
    for m, taken in ((spread, True), (one, False)):
        v = frame(spark, m)
        asked = v.select(F.col("sha_id").cast("long").alias("q"), "vector")
        assert (N.indexed(v, asked, 5, 2, 1, 6, whole=True) is not None) == taken
    monkeypatch.setattr(N, "fitted", lambda *_: (2, 1, 6))
    assert N.neighbours(v, v, 5, recall=0.9).orderBy("query", "rank").collect() == N.neighbours(v, v, 5).orderBy("query", "rank").collect()

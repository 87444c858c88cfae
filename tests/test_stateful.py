import random
import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from listenlake.streaming import playback, stateful as Z

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    Z.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)


def run(df, path, mode="append"):
    q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(150)
    if q.exception():
        raise q.exception()


def events(n, seed):
    rng, out = random.Random(seed), []
    for s in range(n):
        at = T0 + timedelta(minutes=rng.randrange(90))
        kinds = [("start", 0)] * (s % 11 > 0) + [(rng.choice(["pause", "resume", "seek", "skip"]), rng.randrange(100_000)) for _ in range(rng.randrange(4))] + [(rng.choice(["complete", "end"]), rng.randrange(100_000))] * rng.randrange(3)
        for i, (kind, position) in enumerate(kinds):
            out.append((f"{s}-{i}", f"s{s}", f"song{s % 5}", 100_000 if s % 4 else None, kind, position, rng.choice([None, "next_song"]), at + timedelta(seconds=30 * i)))
    rng.shuffle(out)  # late within the watermark, and each session's events fall into both files
    return out + out[::9]  # some come twice


FLUSH = [("z", "zz", "x", 1, "start", 0, None, T0 + timedelta(days=3)), ("z2", "zz2", "x", 1, "start", 0, None, T0 + timedelta(days=6))]


def rows_of(df):
    return sorted((r.session_id, r.sha_id, r.started_at, r.ended_at, r.duration_played_ms, r.completion_percent, r.completed, r.skipped) for r in df.where("session_id NOT LIKE 'zz%'").collect())


def test_sessions_agree_with_the_batch_after_a_restart(spark, tmp_path):
    all_, path = events(40, 3), str(tmp_path)
    half = len(all_) // 2
    stream = lambda: Z.exact_sessions(spark.readStream.schema(playback.EVENTS).json(f"{path}/in"))
    write(spark, all_[:half], playback.EVENTS, f"{path}/in")
    run(stream(), path)
    write(spark, all_[half:], playback.EVENTS, f"{path}/in")
    run(stream(), path)  # a new query from the same checkpoint
    for f in FLUSH:
        write(spark, [f], playback.EVENTS, f"{path}/in")
        run(stream(), path)
    want = playback.sessions_batch(spark.createDataFrame(all_, playback.EVENTS))
    got = spark.read.parquet(f"{path}/out")
    assert rows_of(got) == rows_of(want) and got.count() >= 30


def test_sessions_begin_with_stored_events(spark, tmp_path):
    stored = [("1", "s", "x", 100_000, "start", 0, None, T0), ("2", "s", None, None, "pause", 500, None, T0 + timedelta(minutes=1))]
    new = [("3", "s", None, None, "end", 90_000, None, T0 + timedelta(minutes=2))]
    path = str(tmp_path)
    write(spark, new, playback.EVENTS, f"{path}/in")
    begun = spark.createDataFrame(stored, playback.EVENTS)
    stream = lambda: Z.exact_sessions(spark.readStream.schema(playback.EVENTS).json(f"{path}/in"), open_events=begun)
    run(stream(), path)
    write(spark, FLUSH[:1], playback.EVENTS, f"{path}/in")
    run(stream(), path)
    assert rows_of(spark.read.parquet(f"{path}/out")) == rows_of(playback.sessions_batch(spark.createDataFrame(stored + new, playback.EVENTS)))


def test_streaks_agree_with_the_batch(spark, tmp_path):
    rng, path = random.Random(9), str(tmp_path)
    schema = "user_id long, started_at timestamp, completed boolean, completion_percent double"
    plays = [(rng.randrange(6), T0 + timedelta(days=rng.randrange(40), hours=rng.randrange(24)), rng.random() < 0.3, rng.choice([5.0, 10.0, 90.0])) for _ in range(160)] + [(None, T0, True, 1.0)]
    seen = {}

    def keep(df, _):
        for r in df.collect():
            if r.gone:
                seen.pop((r.user_id, r.start_date), None)
            else:
                seen[r.user_id, r.start_date] = (r.end_date, r.length_days)

    for i in range(0, len(plays), 45):
        write(spark, plays[i : i + 45], schema, f"{path}/in")
        q = Z.streaks_stream(spark.readStream.schema(schema).json(f"{path}/in")).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    want = {(r.user_id, r.start_date): (r.end_date, r.length_days) for r in Z.user_streaks(spark.createDataFrame(plays, schema)).collect()}
    assert seen == want and any(n > 2 for _, n in want.values()) and all(isinstance(k[1], date) for k in want)


def test_changes_are_batched_by_number_and_time(spark, tmp_path):
    path, calls = str(tmp_path), []
    schema = "library string, kind string"
    lists = {"plays": {"play_count"}, "liked": {"is_liked", "play_count"}, "title": {"title"}}
    write(spark, [("a", "playback")] * 25, schema, f"{path}/in")
    stream = spark.readStream.schema(schema).json(f"{path}/in")
    q = Z.batched_changes(stream, 2, 10).writeStream.foreachBatch(lambda df, _: calls.extend((r.library, tuple(r.kinds), r.events, r.preferences_known) for r in df.collect())).option("checkpointLocation", f"{path}/cp").trigger(processingTime="500 milliseconds").start()

    def wait(n):
        end = time.time() + 60
        while len(calls) < n and time.time() < end:
            time.sleep(0.3)

    try:
        wait(3)
        assert calls == [("a", ("playback",), 10, False)] * 2 + [("a", ("playback",), 5, False)]  # the rest when its time is up
        write(spark, [("a", "preference"), ("b", "metadata")], schema, f"{path}/in")
        wait(5)
        assert sorted(calls[3:]) == [("a", ("preference",), 1, True), ("b", ("metadata",), 1, False)]
    finally:
        q.stop()
    assert Z.to_refresh(lists, {"playback"}, False) == ["plays"] and Z.to_refresh(lists, {"playback"}, True) == ["liked", "plays"]
    assert Z.to_refresh(lists, {"metadata"}, False) == ["plays", "title"]

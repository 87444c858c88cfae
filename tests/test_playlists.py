from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from listenlake.catalog import Catalog
from listenlake.operators import playlists as P, rules as R
from listenlake.operators.windows import positions
from listenlake.plans.rules import compiler
from listenlake.sources.files import export
from listenlake.streaming import playback

ROWS = [("t1", "Short", '{"version":1,"match":"all","conditions":[{"field":"duration_sec","operator":"less","value":180}]}', "duration_sec", "asc", 20, True, "duration", datetime(2024, 1, 1)), ("p1", "Mine", "{}", "added_at", "desc", None, False, None, datetime(2024, 1, 2)), ("p2", "Older", "{}", "added_at", "desc", 5, False, None, datetime(2023, 1, 2))]


@pytest.fixture(scope="module")
def stored(spark):
    return spark.createDataFrame(ROWS, P.COLUMNS)


def test_lists_and_edits(spark, stored):
    assert [r.playlist_id for r in P.listed(stored).collect()] == ["p1", "p2", "t1"]
    assert [r.playlist_id for r in P.templates(stored, "duration").collect()] == ["t1"] and P.templates(stored, "time").count() == 0
    new = P.from_template(stored, "t1", "p3", "From it", datetime(2024, 2, 1))
    saved = P.save(stored, new.union(stored.where("playlist_id = 't1'").withColumn("name", F.lit("Changed"))))
    got = {r.playlist_id: (r.name, r.is_template, r.limit_count) for r in saved.collect()}
    assert got["p3"] == ("From it", False, 20) and got["t1"] == ("Short", True, 20) and len(got) == 4
    members = spark.createDataFrame([("p1", "a", 0), ("p2", "b", 0), ("t1", "c", 0)], "playlist_id string, sha_id string, position int")
    left, rest = P.delete(stored, members, spark.createDataFrame([("p1",), ("t1",)], "playlist_id string"))
    assert {r.playlist_id for r in left.collect()} == {"p2", "t1"} == {r.playlist_id for r in rest.collect()}
    assert P.from_template(stored, "p1", "x", "y", datetime(2024, 1, 1)).count() == 0
    assert "Duration" in P.explanation(ROWS[0][2])


def test_conversion_and_plan(spark, sf):
    cat = Catalog.testdata(spark, sf)
    ids = cat.songs.where("release_year BETWEEN 1970 AND 1975")
    as_of = datetime(2024, 1, 31)
    assert P.convert(cat, ids, as_of, "years:1970-1975") == R._rule(("release_year", "between", [1970, 1975]))
    with pytest.raises(R.RuleError):
        P.convert(cat, ids, as_of, "artist:nobody")
    assert P.convert(cat, ids.limit(0), as_of) is None
    assert "Physical Plan" in P.rule_plan(compiler(cat), R.TEMPLATES["Short Songs"][0], limit=5)


def test_any_failure_is_noted_and_the_rest_goes_on(spark, sf, tmp_path):
    c = compiler(Catalog.testdata(spark, sf))
    rule = R.TEMPLATES["Short Songs"][0]
    bad = {"version": 1, "match": "all", "conditions": [{"field": "title", "operator": "regex", "value": "("}]}
    out = R.refresh_all(c, [{"playlist_id": "a", "rules": None}, {"playlist_id": "b", "rules": bad}, {"playlist_id": "c", "rules": rule}], str(tmp_path / "m"))
    assert out["c"] == "ok" and out["a"] != "ok" and out["b"] != "ok"


def test_positions_are_those_of_one_sort(spark):
    rows = [(i, (i * 7919) % 101 if i % 9 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, k int").repartition(7)
    got = {r.id: r.position for r in positions(df, [F.col("k").desc_nulls_last(), F.col("id")], "position").collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: i for i, r in enumerate(want)}
    assert positions(df.limit(0), [F.col("k")], "position").count() == 0


def test_export_takes_the_first_rows_of_an_order(spark, tmp_path):
    df = spark.range(100).selectExpr("id AS a", "100 - id AS b").repartition(5)
    export(df, str(tmp_path / "x"), limit=3, order=["b"])
    assert sorted(int(r.a) for r in spark.read.option("header", True).csv(str(tmp_path / "x")).collect()) == [97, 98, 99]


def test_a_session_in_several_chunks_is_folded_in_order():
    at = lambda s: pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)
    row = lambda i, kind, s, pos: {"event_id": str(i), "session_id": "s", "sha_id": "x", "song_duration_ms": 1000, "event_type": kind, "position_ms": pos, "reason": None, "timestamp": at(s)}

    class Group:
        exists, hasTimedOut, state = False, False, None

        def update(self, s):
            self.state = s

        def setTimeoutTimestamp(self, t): ...

        def getCurrentWatermarkMs(self):
            return 0

    chunks = [pd.DataFrame([row(3, "end", 30, 900)]), pd.DataFrame([row(1, "start", 0, 0), row(2, "pause", 10, 500)])]
    (out,) = playback._stateful(("s",), iter(chunks), Group())
    assert out.duration_played_ms[0] == 900 and out.ended_at[0] == at(30) and bool(out.completed[0])
    assert list(playback._stateful(("s",), iter([]), Group())) == []


def test_live_overview_and_types(spark, tmp_path):
    rows = spark.createDataFrame([("a", "click"), ("b", "view")], "event_id string, event_type string")
    assert playback.of_types(rows, ["view"]).count() == 1 and playback.of_types(rows, None).count() == 2
    source = str(tmp_path / "in")
    rows.write.parquet(source)
    stream = playback.of_types(spark.readStream.schema(rows.schema).parquet(source), ["click"])
    shown = []
    q = playback.live_overview(stream, lambda: rows.agg(F.count(F.lit(1)).alias("plays")), shown.append, str(tmp_path / "cp"), "1 second")
    q.processAllAvailable()
    q.stop()
    assert shown and shown[0] == {"plays": 2}

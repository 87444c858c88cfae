from datetime import datetime

import pytest
from pyspark.sql import functions as F

from listenlake.catalog import Catalog
from listenlake.operators import tables as M, views as W


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def play(i, at, sha="1"):
    return (str(i), sha, 1, at, at, 1000 * i, 50.0, True, False, None)


SCHEMA = "session_id string, sha_id string, user_id long, started_at timestamp_ntz, ended_at timestamp_ntz, duration_played_ms int, completion_percent double, completed boolean, skipped boolean, context_type string"


@pytest.fixture
def library(spark, sf):
    own = Catalog.testdata(spark, sf)

    def of(plays):
        return W._over(own, spark.createDataFrame(plays, SCHEMA))

    return of


OLD = [play(1, datetime(2023, 11, 30, 23)), play(2, datetime(2023, 12, 31, 9)), play(3, datetime(2024, 1, 1, 9)), play(4, datetime(2024, 2, 5), "2"), play(5, None)]
NEW = [play(6, datetime(2024, 2, 1, 1), "3"), play(7, datetime(2024, 2, 7))]


def test_a_batch_renews_only_the_months_it_touches(spark, library, tmp_path):
    root = str(tmp_path)
    first = W.refresh_views(library(OLD), root)
    both = library(OLD + NEW)
    second = W.refresh_views(both, root, spark.createDataFrame(NEW, SCHEMA))
    for name, view in W.VIEWS.items():
        assert rows(W.read_view(spark, root, name)) == rows(view.rows(both)), name
    kept = lambda name: {p for p, f in first["views"][name]["parts"].items() if second["views"][name]["parts"].get(p) == f}
    assert kept("daily") == {"0000-00", "2023-11", "2023-12", "2024-01"} and kept("monthly") == {"0000-00", "2023-11", "2023-12", "2024-01"}
    assert kept("weekly") == {"0000-00", "2023-11", "2023-12"}  # the week of 1 February begins in January
    # Plays that went empty a month: its part goes.
    W.refresh_views(library([p for p in OLD if p[0] != "1"]), root, spark.createDataFrame([OLD[0], *NEW], SCHEMA))
    assert "2023-11" not in W.manifest(spark, root)["views"]["daily"]["parts"]
    assert rows(W.read_view(spark, root, "daily")) == rows(M.listening_stats(library([p for p in OLD if p[0] != "1"]), "day"))
    assert W.refresh_views(both, root, spark.createDataFrame([], SCHEMA))["views"]["daily"] == W.manifest(spark, root, 3)["views"]["daily"]


def test_a_reader_never_sees_half_a_refresh(spark, library, tmp_path):
    root = str(tmp_path)
    W.refresh_views(library(OLD), root)
    held = W.manifest(spark, root)
    before = {n: rows(W.read_view(spark, root, n)) for n in W.VIEWS}
    failing = dict(W.VIEWS) | {"top_songs_monthly": W.View(lambda c: M.top_songs_monthly(c).withColumn("title", F.raise_error(F.lit("no")).cast("string")), "month", "month")}
    with pytest.raises(Exception, match="no"):
        W.refresh_views(library(OLD + NEW), root, spark.createDataFrame(NEW, SCHEMA), failing)
    assert {n: rows(W.read_view(spark, root, n)) for n in W.VIEWS} == before  # daily was written, but not published
    W.refresh_views(library(OLD + NEW), root, spark.createDataFrame(NEW, SCHEMA))
    assert rows(W.read_view(spark, root, "daily", held)) == before["daily"] != rows(W.read_view(spark, root, "daily"))
    assert any(g.startswith("daily/") for g in W.vacuum(spark, root))  # of the failed refresh
    assert rows(W.read_view(spark, root, "daily", held)) == before["daily"]
    W.vacuum(spark, root, keep=1)
    assert W.manifest(spark, root)["number"] == 2 and rows(W.read_view(spark, root, "daily")) == rows(M.listening_stats(library(OLD + NEW), "day"))


def test_of_two_writers_one_is_refused(spark, library, tmp_path, monkeypatch):
    root, cat = str(tmp_path), library(OLD)
    W.refresh_views(cat, root)
    stale = W.manifest(spark, root)
    W.refresh_views(cat, root, spark.createDataFrame(NEW, SCHEMA))
    with pytest.raises(RuntimeError, match="first"):
        monkeypatch.setattr(W, "manifest", lambda *_: stale)
        W.refresh_views(cat, root, spark.createDataFrame(NEW, SCHEMA))

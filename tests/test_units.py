import functools
import itertools
import math
import operator
import re
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from listenlake.catalog import Catalog
from listenlake.functions import audio, exprs as X, filenames, text
from listenlake.functions.period import parse_period
from listenlake.operators import refresh as RF, rules as R, similarity as V, tables as M
from listenlake.operators import windows as W
from listenlake.operators.windows import listening_sessions, streaks
from listenlake.sources import files
from listenlake.streaming import playback

AS_OF = datetime(2024, 1, 31)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_periods():
    assert parse_period("2024-12", AS_OF) == (datetime(2024, 12, 1), datetime(2025, 1, 1))
    assert parse_period("2023", AS_OF) == (datetime(2023, 1, 1), datetime(2024, 1, 1))
    assert parse_period("nonsense", AS_OF) == parse_period("month", AS_OF)
    with pytest.raises(ValueError):
        parse_period("2024-13", AS_OF)


@pytest.mark.parametrize("ms, want", [(0, "0m"), (None, "0m"), (999, "0s"), (59_999, "59s"), (60_000, "1m"), (3_600_000, "1h 0m"), (90_061_000, "1d 1h")])
def test_durations(spark, ms, want):
    assert one(spark, X.format_duration(F.lit(ms).cast("long"))) == want


def test_percent_change(spark):
    assert [one(spark, X.percent_change(F.lit(a), F.lit(b))) for a, b in ((0, 0), (3, 0), (3, 2))] == [0.0, 100.0, 50.0]


def plays(spark, *rows):
    return spark.createDataFrame([(f"{i}", 1, datetime.fromisoformat(s), e and datetime.fromisoformat(e), 1000, True, 100.0, "a") for i, (s, e) in enumerate(rows)], "session_id string, user_id long, started_at timestamp_ntz, ended_at timestamp_ntz, duration_played_ms int, completed boolean, completion_percent double, sha_id string")


def test_session_gap(spark):
    rows = [("2024-01-01 00:00:00", None), ("2024-01-01 00:30:00", "2024-01-01 00:40:00"), ("2024-01-01 01:10:00.000001", None), ("2024-01-01 01:10:00.000001", None)]
    got = sorted(r.songs for r in listening_sessions(plays(spark, *rows)).collect())
    assert got == [2, 2]


def test_streaks(spark):
    days = ["2024-01-30", "2024-01-31", "2024-02-01", "2024-02-03"]
    cat = Catalog(spark, {"play_sessions": plays(spark, *[(d, None) for d in days])})
    assert sorted(r.length_days for r in streaks(cat).collect()) == [1, 3]


def test_two_primary_artists_fan_out(spark):
    cat = Catalog(spark, {"song_artists": spark.createDataFrame([("a", 1, "primary"), ("a", 2, "primary"), ("b", 1, "featured")], "sha_id string, artist_id long, role string"), "artists": spark.createDataFrame([(1, "x"), (2, "y")], "artist_id long, name string")})
    got = cat.with_primary(spark.createDataFrame([("a",), ("b",)], "sha_id string")).collect()
    assert sorted((r.sha_id, r.artist) for r in got) == [("a", "x"), ("a", "y"), ("b", "Unknown Artist")]


def test_rules_are_checked():
    deep = {"conditions": []}
    for _ in range(4):
        deep = {"conditions": [deep]}
    bad = [{"version": 2}, {"version": 1, **deep}, {"version": 1, "conditions": [{"field": "title", "operator": "equals", "value": "x"}] * 51}]
    bad += [{"version": 1, "conditions": [c]} for c in ({"field": "nope", "operator": "equals", "value": 1}, {"field": "title", "operator": "greater", "value": 1}, {"field": "title", "operator": "regex", "value": "("}, {"field": "bpm", "operator": "between", "value": [1]}, {"field": "bpm", "operator": "in_list", "value": []})]
    for rules in bad:
        with pytest.raises(R.RuleError):
            R.parse(rules)


def test_rule_words_and_cost():
    g = R.parse({"version": 1, "match": "any", "conditions": [{"field": "artist", "operator": "contains", "value": "x"}, {"conditions": [{"field": "title", "operator": "regex", "value": "y"}]}]})
    assert R.explain(g).splitlines()[0] == "Match ANY of the following:"
    assert R.complexity(g)[0] == 1 + 2 + 2 + 1 + 1 + 5
    assert R.warnings(R.parse({"version": 1, "conditions": []})) == ["An empty group matches all songs"]


def test_refresh_replaces_one_playlist(spark, sf, tmp_path):
    k = R.Compiler(Catalog.testdata(spark, sf), AS_OF)
    path = str(tmp_path / "members")
    R.refresh(k, "a", R.TEMPLATES["Short Songs"][0], path)
    R.refresh(k, "b", R.TEMPLATES["Long Songs"][0], path, limit=5)
    R.refresh(k, "b", R.TEMPLATES["Long Songs"][0], path, limit=3)
    got = {r.playlist_id: r.n for r in spark.read.parquet(path).groupBy("playlist_id").agg(F.count("*").alias("n")).collect()}
    assert got["b"] == 3 and got["a"] > 0
    assert R.refresh_all(k, [{"playlist_id": "c", "rules": {"version": 9}}, {"playlist_id": "d", "rules": R.TEMPLATES["Long Songs"][0]}], path)["c"] != "ok"


def test_refresh_of_a_rule_that_matches_nothing_clears_the_playlist(spark, sf, tmp_path):
    k = R.Compiler(Catalog.testdata(spark, sf), AS_OF)
    path = str(tmp_path / "members")
    nothing = R._rule(("duration_sec", "less", 0))
    with pytest.raises(R.RuleError):
        RF.refresh(k, {"playlist_id": "t", "rules": nothing, "is_template": True}, path)
    assert RF.refresh(k, {"playlist_id": "first", "rules": nothing}, path).count() == 0
    one = {"playlist_id": "a b/c", "rules": R.TEMPLATES["Short Songs"][0]}
    other = {"playlist_id": "d", "rules": R.TEMPLATES["Long Songs"][0], "sort_by": "title", "sort_order": "asc"}
    assert RF.refresh_all(k, [one, other], path) == {"a b/c": "ok", "d": "ok"}
    assert RF.refresh_all(k, [one | {"rules": nothing}], path) == {"a b/c": "ok"}
    left = spark.read.schema(RF.MEMBERS).parquet(path)
    assert [r.playlist_id for r in left.select("playlist_id").distinct().collect()] == ["d"]
    stats = {r.playlist_id: tuple(r)[:2] for r in spark.read.schema(RF.STATS).parquet(f"{path}_stats").collect()}
    assert stats["a b/c"] == (0, 0) and stats["d"][0] == left.count()
    titles = [r.title for r in left.join(k.cat.songs.select("sha_id", "title"), "sha_id").orderBy("position").collect()]
    assert titles == sorted(titles)


def test_many_playlists_read_the_plays_once(spark, sf):
    k = R.Compiler(Catalog.testdata(spark, sf), AS_OF)
    rules = {str(i): R.parse(R._rule(("play_count", "greater", i % 9), ("artist", "contains", str(i % 10)), ("genre", "equals", f"Brand#{i % 50}"))) for i in range(100)}
    plan = RF.matched(k, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("event_id#") and sum("Relation" in x and "events" not in x and "event_type" in x for x in plan.splitlines()) == 1


def test_diversity_caps_interact(spark):
    rows = [("s", f"{i:02d}", 1 - i / 100, "album" if i < 6 else None, "artist" if i < 9 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "seed string, sha_id string, score double, album_id string, artist string")
    got = [r.sha_id for r in V.diversify(df, 10).orderBy("position").collect()]
    assert got == ["00", "01", "02", "06", "07", "09", "10", "11", "12", "13"]


def test_zero_vectors_and_segments(spark):
    df = spark.createDataFrame([("a", [0.0, 0.0], 0.0, 1.0), ("b", [1.0, 0.0], 0.0, 1.0), ("b", [0.0, 1.0], 1.0, 2.0), ("c", [3.0, 4.0], 0.0, -1.0), ("c", [9.0, 9.0], 0.0, 1.0)], "sha_id string, vector array<double>, segment_start_sec double, segment_end_sec double")
    v = V.song_vectors(df)
    assert {r.sha_id: list(r.vector) for r in v.collect()} == {"a": [0, 0], "b": [0.5, 0.5], "c": [3, 4]}
    assert {r.sha_id: round(r.score, 6) for r in V.nearest(v, np.array([3.0, 4.0]), 3).collect()}["a"] == 0.0


EVENT_ROWS = [
    ("1", "s1", "x", 100_000, "start", 0, None, "2024-01-01 00:00:00"), ("2", "s1", None, None, "pause", 50_000, None, "2024-01-01 00:01:00"), ("3", "s1", None, None, "end", 80_000, None, "2024-01-01 00:02:00"), ("4", "s1", None, None, "complete", 1, None, "2024-01-01 00:03:00"),
    ("5", "s2", "y", 100_000, "start", 0, None, "2024-01-01 00:00:01"), ("6", "s2", None, None, "end", 29_990, "next_song", "2024-01-01 00:02:01"), ("7", "s3", "z", None, "start", 0, None, "2024-01-01 00:00:02"), ("8", "s3", None, None, "complete", 5, None, "2024-01-01 00:02:02"),
    ("9", "s4", None, None, "end", 5, None, "2024-01-01 00:02:03"), ("2", "s1", None, None, "pause", 50_000, None, "2024-01-01 00:01:00"),
]


def test_stream_and_batch_sessions_agree(spark, tmp_path):
    rows = [(*r[:7], datetime.fromisoformat(r[7])) for r in EVENT_ROWS]
    spark.createDataFrame(rows, playback.EVENTS).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(playback.EVENTS).json(str(tmp_path / "in"))
    q = playback.sessions_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    streamed = {r.session_id: (r.completion_percent, r.completed, r.skipped) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r.session_id: (r.completion_percent, r.completed, r.skipped) for r in playback.sessions_batch(spark.read.schema(playback.EVENTS).json(str(tmp_path / "in"))).collect()}
    assert streamed == batch == {"s1": (80.0, True, False), "s2": (29.99, False, True), "s3": (100.0, True, False)}


def test_affected_playlists():
    lists = {"a": {"play_count"}, "b": {"title"}, "c": {"is_liked"}}
    assert playback.affected(lists, {"playback"}) == ["a"]
    assert playback.affected(lists, {"preference"}) == ["c"]
    assert playback.affected(lists, {"metadata"}) == ["a", "b", "c"]


def test_fuzzy_and_folded(spark):
    df = spark.createDataFrame([("Beyoncé", "beyonce"), (None, "x"), ("abc", "abc")], "a string, b string")
    assert [round(x, 3) for (x,) in df.select(text.fuzzy_ratio("a", "b")).collect()] == [0.857, 0.0, 1.0]
    assert df.select(text.fold_accents("a")).first()[0] == "Beyonce"


def test_filenames():
    assert text.parse_filename("01 - Artist Name - Song Title (Official Video).mp3")[0][:2] == ("Artist Name", "Song Title")
    assert text.parse_filename("Song by Someone.mp3")[0][:2] == ("Someone", "Song")
    assert text.parse_filename("") == []


def test_upsert_and_cascade(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, v int, w string")
    new = spark.createDataFrame([("b", None, "y"), ("c", 3, None)], "k string, v int, w string")
    assert sorted(map(tuple, M.upsert(old, new, ["k"]).collect())) == [("a", 1, None), ("b", 2, "y"), ("c", 3, None)]
    tables = {"songs": spark.createDataFrame([("a",), ("b",)], "sha_id string"), "other": spark.range(2)}
    out = M.delete_songs(spark.createDataFrame([("a",)], "sha_id string"), tables)
    assert (out["songs"].count(), out["other"].count()) == (1, 2)


def test_release_json(spark):
    payload = '{"title": "T  x", "artist": "A", "date": "1999-01-02", "media": [{"tracks": [{"number": "2/10", "title": "q", "length": 61499}]}]}'
    albums, tracks = M.album_tracks(spark.createDataFrame([("r", payload), ("bad", "{")], "release_id string, payload string"))
    assert tracks.collect()[0][1:] == (2, "q", 61)
    assert albums.where("release_id = 'r'").first().album_key == "t x::a"


def test_tempo_and_key(spark):
    assert [one(spark, audio.fold_bpm(F.lit(b))) for b in (30.0, 200.0, 120.0)] == [60.0, 100.0, 120.0]
    k = spark.createDataFrame([(audio.MAJOR[-7:] + audio.MAJOR[:-7],)], "c array<double>").select(audio.key_of("c").alias("k")).first().k
    assert (k.pitch, k.minor) == (7, False)
    assert [one(spark, audio.camelot(F.lit(p), F.lit(m))) for p, m in ((0, False), (9, True), (7, False))] == ["8B", "8A", "9B"]


def test_constant_column_scales(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double")
    assert [tuple(r) for r in audio.scaled(audio.scaled(df, "v", "z"), "v", "s", "range").select("z", "s").collect()] == [(0.0, 0.5), (0.0, 0.5), (None, None)]


def test_files(spark, tmp_path):
    (tmp_path / "hot.json").write_text('{"tracks": [{"name": "n", "artists": "[\\"a\\"]", "release": "r"}, {"title": " "}]}')
    assert [tuple(r) for r in files.read_hotlist(spark, str(tmp_path / "hot.json")).collect()] == [("n", "a", "r", None)]
    (tmp_path / "hot.csv").write_text("name,artist\nx,y\n")
    assert files.read_hotlist(spark, str(tmp_path / "hot.csv")).first().title == "x"
    (tmp_path / "src.jsonl").write_text('{"title": "a"}\n\n{"title": ""}\n')
    with pytest.raises(Exception, match="needs a title"):
        files.read_source_items(spark, str(tmp_path / "src.jsonl")).collect()
    assert files.from_share_token(files.share_token({"b": 1, "a": "é"})) == {"a": "é", "b": 1}
    files.export(spark.createDataFrame(pd.DataFrame({"a": [1, 2]})), str(tmp_path / "out"), limit=1)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1
    seg = files.segments(spark.createDataFrame([("a", [[1.0], [2.0]])], "sha_id string, frames array<array<double>>")).collect()
    assert [(r.segment_start_sec, r.segment_end_sec) for r in seg] == [(0.0, 0.96), (0.48, 1.44)]


def wav(width, samples, channels=1):
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(8000)
        w.writeframes(b"".join(int(s).to_bytes(width, "little", signed=width > 1) for s in samples))
    return out.getvalue()


def test_audio_files(spark, tmp_path):
    import io

    from listenlake.sources import audio as A

    for width in (1, 2, 3, 4):
        full = 2 ** (8 * width - 1)
        rate, x = A.decode_wav(wav(width, [s + full * (width == 1) for s in (0, full // 2, -full // 2)]))
        assert rate == 8000 and x[:, 0].tolist() == [0.0, 0.5, -0.5]
    assert A.prepare(np.array([[0.0, 0.0], [0.5, 0.1], [0.0, 0.0], [-0.2, -0.2], [0.0, 0.0]])).round(3).tolist() == [1.0, 0.0, -0.667]
    (tmp_path / "a.wav").write_bytes(wav(2, [0, 100, 0]))
    (tmp_path / "b.wav").write_bytes(b"nonsense")
    got = {r.path[-5:]: r for r in A.waveforms(A.list_audio(spark, str(tmp_path), "*.wav")).collect()}
    assert got["a.wav"].samples == [1.0] and got["b.wav"].rate is None and got["b.wav"].error
    buf = io.BytesIO()
    np.savez(buf, postprocessed=np.arange(3.0))
    files_df = spark.createDataFrame([("x.npz", bytearray(buf.getvalue()))], "path string, content binary")
    assert A.load_embeddings(files_df, 3).first().frames == [[0.0, 1.0, 2.0]]
    side = spark.createDataFrame([("a", bytearray(b'{"k": 1}')), ("b", bytearray(b"{"))], "path string, content binary")
    assert [r.meta and r.meta.k for r in A.sidecars(side, "k int").orderBy("path").collect()] == [1, None]


def test_preview_and_report(spark, sf, tmp_path):
    from listenlake.operators import reports

    k = R.Compiler(Catalog.testdata(spark, sf), AS_OF)
    rows, total = reports.preview(k, R.TEMPLATES["Short Songs"][0], 5)
    assert rows.count() == 5 <= total.first()[0]
    assert reports.preview(k, R.TEMPLATES["Short Songs"][0], 1000)[0].count() == min(100, total.first()[0])
    reports.write_report(Catalog.testdata(spark, sf), "month", AS_OF, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "overview")).first().total_plays == 1000


def test_reset_counts_what_goes(spark):
    from listenlake.operators import resolve as Z

    left, removed = Z.reset({"songs": spark.range(3), "albums": spark.range(2), "vectors": spark.range(4)}, ["songs", "albums"])
    assert {k: df.count() for k, df in left.items()} == {"songs": 0, "albums": 0, "vectors": 4}
    assert {r["table"]: r.removed for r in removed.collect()} == {"songs": 3, "albums": 2}


def test_names_and_imports(spark):
    from listenlake.operators import resolve as Z

    df = spark.createDataFrame([(["A", " a", "", None, "b", "B "],), ([],), (None,)], "n array<string>")
    assert [r[0] for r in df.select(Z.distinct_names("n")).collect()] == [["A", "b"], [], None]
    got = {r.path: (r.artist, r.title, r.status) for r in Z.imports(spark.createDataFrame([("x/A_B - C - D.mp3",), (".mp3",), ("noise",), ("q.FLAC",)], "path string")).collect()}
    assert got == {"x/A_B - C - D.mp3": ("A B", "C - D", "downloaded"), ".mp3": (None, "", "failed"), "noise": (None, "noise", "failed"), "q.FLAC": (None, "q", "converting")}


def test_resolution_gates(spark):
    from listenlake.operators import resolve as Z

    rows = [("a", 2, 0.9, 0.9, 80.0, "late"), ("a", 1, 0.2, 0.9, 99.0, "unsure"), ("b", 1, 0.5, 0.3, 99.0, "other artist"), ("b", 1, 0.5, None, 10.0, "no artist"), ("c", 1, 0.5, 0.5, 80.0, None)]
    df = spark.createDataFrame(rows, "key string, stage int, confidence double, artist_similarity double, score double, match string")
    assert {r.key: r.match for r in Z.resolve(df).collect()} == {"a": "late", "b": "no artist"}


def test_native_catalog(spark, tmp_path):
    spark.createDataFrame([("a", "t")], "sha_id string, title string").write.parquet(str(tmp_path / "songs.parquet"))
    assert Catalog.native(spark, str(tmp_path)).songs.first().title == "t"


@pytest.mark.parametrize(
    "name, guess",
    [
        ("Artist_Title.mp3", ("Artist", "Title", 0.6)),
        ("wonder_girls_tellme.mp3", ("wonder girls", "tellme", 0.55)),
        ("Title (Artist).mp3", ("Artist", "Title", 0.5)),
        ("(Artist) Title.mp3", ("Artist", "Title", 0.5)),
        ("ALLEYCVTBack2Life.mp3", ("ALLEYCVT", "Back2Life", 0.4)),
        ("ArtistSong.mp3", ("Artist", "Song", 0.3)),
        ("aespa Next Level.mp3", ("aespa", "Next Level", 0.35)),
        ("Band__Song.mp3", ("Band", "Song", 0.9)),
        ("Band-Song.mp3", ("Band", "Song", 0.7)),
        ("Track 01 - AOA - Miniskirt M V.mp3", ("AOA", "Miniskirt", 0.855)),
    ],
)
def test_filename_patterns(name, guess):
    assert guess in [(a, t, round(c, 6)) for a, t, c in text.parse_filename(name)]


@pytest.mark.parametrize(
    "name, artist, title",
    [
        ("AOA - Miniskirt M V", "AOA", "Miniskirt"), ("AOA - Miniskirt M V.mp3", "AOA", "Miniskirt"), ("ALLEYCVT - Throw it down", "ALLEYCVT", "Throw it down"),
        ("Singer - Title", "Singer", "Title"), ("Singer – Title", "Singer", "Title"), ("Singer — Title", "Singer", "Title"),
        ("Singer - Title (Official Audio) [HD]", "Singer", "Title"), ("Singer - Title (2024)", "Singer", "Title"), ("Singer - Title [dQw4w9WgXcQ]", "Singer", "Title"),
        ("Singer_-_Title_ft._Someone.webm", "Singer", "Title"), ("Ｓinger - Title", "Singer", "Title"), ("Artist - Title", None, "Artist - Title"),
    ],
)
def test_likeliest_guess(name, artist, title):
    assert text.parse_filename(name)[0][:2] == (artist, title)


def test_guesses_of_a_column(spark):
    names = ["Artist_Title_Song", "Just A Song Title", "the - x.mp3", "12 - 34 songs", None, " ", "a - b" + " (Live)" * 30, "Artist - artist - ARTIST"]
    got = [r.g for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(text.parsed_filenames("n").alias("g")).collect()]
    has = lambda i, a, t: any((x.artist, x.title) == (a, t) for x in got[i])
    assert has(0, "Artist", "Title Song") and has(0, "Artist Title", "Song") and has(1, None, "Just A Song Title") and not any(x.artist == "12" and x.title == "34 songs" for x in got[3])
    assert [x.confidence for x in got[2] if (x.artist, x.title) == ("the", "x")] == [0.4] and not got[4] and not got[5]
    assert has(6, "a", "b")  # endings go however many there are
    assert all(x.confidence >= y.confidence for g in got for x, y in zip(g, g[1:]))
    assert all(len({((x.artist or "-").lower(), x.title.lower()) for x in g}) == len(g) for g in got)


def test_artist_variants_and_names_worth_parsing(spark):
    variants = lambda x: one(spark, filenames.artist_variants(F.lit(x)))
    assert variants("The Beatles") == ["The Beatles", "Beatles"] and variants("P!nk") == ["P!nk", "P nk"] and variants("AC/DC") == ["AC/DC", "AC DC"] and variants("Artist") == ["Artist"]
    cases = [
        ("Singer - Title", None, True), ("AOA - Miniskirt M V", None, True), ("Song Title", "Some Name", False), ("Just A Title", "Known Name", False), ("NewSinger - Song Title", "OldSinger", True),
        ("NewSinger - Song Title", "newsinger", False), ("a_b", None, True), ("Title (Name)", "unknown", True), ("one", None, False), ("two words", "various", True), ("x", "the", False), ("x", "12", False),
    ]
    df = spark.createDataFrame(cases, "title string, artist string, want boolean")
    assert df.where(filenames.should_parse(F.col("title"), F.col("artist")) != F.col("want")).collect() == []


def test_registered_file_names_find_their_artists(spark, sf):
    from listenlake.plans import tables as PT

    c = Catalog.testdata(spark, sf)
    rows = PT._file_names(c).join(c.primary, "sha_id").join(PT.QUERIES["u04_filenames"](spark, sf).withColumnRenamed("artist", "guess"), "sha_id")
    best = rows.groupBy("sha_id", "name", "artist").agg(F.max_by("guess", "confidence").alias("guess")).collect()
    first = [r for r in best if re.match(re.escape(r.artist) + r"[ _-]", r.name)]
    assert len(first) > 50 and all(r.guess == r.artist for r in first)


def test_filenames_of_known_artists(spark):
    artists = spark.createDataFrame([(1, "Ed Sheeran", 5), (2, "The Beatles", 1), (3, "Ed Sheeranso", 1)], "artist_id int, name string, song_count int")
    names = spark.createDataFrame([("a", "edsheeran bad habits.mp3"), ("b", "beatles_help.mp3"), ("c", "Ed Sheerans - Shivers.mp3"), ("d", None)], "sha_id string, name string")
    best = {}
    for r in text.known_filenames(names, artists).orderBy("sha_id", F.desc("confidence")).collect():
        best.setdefault(r.sha_id, (r.artist, r.title))
    assert best == {"a": ("Ed Sheeran", "bad habits"), "b": ("The Beatles", "help"), "c": ("Ed Sheeran", "Shivers")}


def test_close_pairs_match_brute_force(spark):
    words = spark.range(60).select(F.concat(F.lit("Supplier#0000"), F.col("id") * 7 % 100, F.lit(" the")).alias("name"))
    asked = words.select(F.translate("name", "3", "4").alias("text"))
    both = asked.distinct().crossJoin(words).select("text", "name", text.similarity("text", "name").alias("s")).where("s >= 0.75")
    close = text.close_pairs(asked.distinct(), words, 0.75)
    assert sorted(tuple(r) for r in close.collect()) == sorted(tuple(r) for r in both.distinct().collect()) and close.count() > 60


def test_most_similar_reaches_down_to_the_operators_threshold(spark):
    one_, all_ = (spark.createDataFrame(x, "artist_id int, name string") for x in ([(1, "the beatles")], [(2, "beatles"), (3, "the beat"), (4, "nothing"), (5, "the eagles")]))
    rows = text.most_similar(one_, all_, "artist_id", "artist_id", "name", "name").collect()
    assert {r.r_key: r.similarity for r in rows} == {2: 0.666667, 3: 0.615385, 5: 0.352941}
    assert text.most_similar(one_, all_, "artist_id", "artist_id", "name", "name", n=1).count() == 1


def test_one_sequence_of_sessions_across_range_borders(spark):
    import random

    random.seed(8)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        at = start + timedelta(minutes=random.choice([0, 1, 2, 60, 61, 500, 501, 502, 503, 900]) + 1000 * random.randrange(4))
        until = random.choice([None, at + timedelta(minutes=random.choice([1, 30, 120])), at - timedelta(hours=2)])  # ends before the start: clocks may be wrong
        rows.append((f"{i:03}", at, until, 1000, True))
    rows += [(f"t{i:03}", start + timedelta(minutes=77), None, 1, False) for i in range(150)]  # one start that fills several ranges
    plays = spark.createDataFrame(rows, "session_id string, started_at timestamp_ntz, ended_at timestamp_ntz, duration_played_ms int, completed boolean")
    before, want = None, []
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    breaks = {r[1] for p, r in zip([None, *ordered], ordered) if p is None or r[1] - (p[2] or p[1]) > timedelta(minutes=30)}
    for r in ordered:
        if r[1] in breaks and r[1] != before:
            want.append([r[1], r[2] or r[1], 0])
            before = r[1]
        want[-1] = [want[-1][0], max(want[-1][1], r[2] or r[1]), want[-1][2] + 1]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = W.listening_sessions(plays, by_user=False)
        assert sorted((r.started_at, r.ended_at, r.songs) for r in got.collect()) == sorted(map(tuple, want))
        alone = [x for x in got._jdf.queryExecution().analyzed().toString().splitlines() if "Window [" in x and "windowspecdefinition(part#" not in x]
        assert not any("until" in x for x in alone)  # unpartitioned windows see a row a range, no plays
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_candidates_follow_the_answers_not_a_hot_trigram(spark):
    made = lambda i: "".join(chr(97 + int(x) * 5 % 26 + i % 3) for x in f"{i * 7919 % 99991:05}")
    names = spark.createDataFrame([(i, f"the {made(i)}") for i in range(600)], "id int, name string")
    asked = names.where("id % 50 = 0")
    brute = asked.select(F.col("id").alias("l_key"), F.col("name").alias("a")).crossJoin(names.select(F.col("id").alias("r_key"), F.col("name").alias("b")))
    brute = brute.select("l_key", "r_key", F.round(text.similarity("a", "b"), 6).alias("similarity"))
    for least in (0.3, 0.6):
        want = sorted(map(tuple, brute.where(F.col("similarity") >= least).collect()))
        assert sorted(map(tuple, text.similar_pairs(asked, names, "id", "id", "name", "name", least).collect())) == want
    sets = text._gram_sets(asked, "id", "name", "l"), text._gram_sets(names, "id", "name", "r")
    assert text.candidate_pairs(*sets, 0.6).count() < 0.2 * 12 * 600  # all 7,200 pairs share the trigrams of "the"
    best = {}
    for r in sorted(brute.where("similarity >= 0.3").collect(), key=lambda r: (-r.similarity, r.r_key)):
        best.setdefault(r.l_key, []).append((r.r_key, r.similarity))
    got = {}
    for r in text.most_similar(asked, names, "id", "id", "name", "name", n=2).orderBy(F.desc("similarity"), "r_key").collect():
        got.setdefault(r.l_key, []).append((r.r_key, r.similarity))
    assert got == {k: v[:2] for k, v in best.items()}


def test_equal_means_are_equal_in_any_order(spark):
    orders = list(itertools.permutations([95.33, 92.74, 82.62, 77.77, 85.34, 82.15]))
    total = lambda x: functools.reduce(operator.add, x)
    low, high = min(orders, key=total), max(orders, key=total)
    assert total(low) < total(high)  # in doubles
    plays = [(i, v) for i, values in (("a", low), ("b", high)) for v in values] + [("c", float("nan")), ("c", 1.0), ("d", 2e6), ("d", None), ("e", None)]
    df = spark.createDataFrame(plays, "sha_id string, v double").coalesce(1)
    got = {r.sha_id: r.m for r in df.groupBy("sha_id").agg(X.exact_mean("v").alias("m")).collect()}
    assert got["a"] == got["b"] == 515.95 / 6 and math.isnan(got["c"]) and got["d"] == 2e6 and got["e"] is None
    stored = df.where("sha_id < 'c'").selectExpr("sha_id", "timestamp_ntz '2024-01-30' AS started_at", "v AS completion_percent", "false AS skipped")
    means = [r.avg_completion for r in R.play_stats(Catalog(spark, tables={"play_sessions": stored}), AS_OF).collect()]
    assert means == [515.95 / 6] * 2


@pytest.mark.parametrize("least", [0.3, 0.6, 0.75])
def test_names_that_begin_alike_make_few_candidates(spark, least):
    names = [(i, f"Supplier#{i * 7919 % 90_000:09}") for i in range(400)] + [(900, "Al"), (901, "Al Al Bo"), (902, "x"), (903, "the supplier of suppliers 12345 and more")]
    df = spark.createDataFrame(names, "id int, name string").cache()
    sets = {r.id: set(r.g) for r in df.select("id", text.trigrams("name").alias("g")).collect()}
    want = {(a, b) for a in sets if a % 10 == 0 for b in sets if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}
    some = df.where("id % 10 = 0")
    got = text.similar_pairs(some, df, "id", "id", "name", "name", least)
    assert {(r.l_key, r.r_key) for r in got.collect()} == want
    if least == 0.6:
        pairs = text.candidate_pairs(text._gram_sets(some, "id", "name", "l"), text._gram_sets(df, "id", "name", "r"), least)
        assert pairs.count() < 0.35 * 41 * 404

"""Library, audio-feature and discovery statistics."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from listenlake.catalog import PITCHES, Catalog
from listenlake.functions import exprs as X
from listenlake.functions.period import parse_period, within
from listenlake.operators.windows import running_total


def _n() -> Column:
    return F.count(F.lit(1)).cast("long")
FEATURES = ["bpm", "energy", "danceability", "acousticness", "instrumentalness", "speechiness"]
PAIRS = [
    ("bpm", "energy"), ("bpm", "danceability"), ("energy", "danceability"), ("energy", "acousticness"), ("energy", "instrumentalness"), ("energy", "speechiness"),
    ("danceability", "acousticness"), ("danceability", "instrumentalness"), ("danceability", "speechiness"), ("acousticness", "instrumentalness"), ("acousticness", "speechiness"),
]


def library_stats(cat: Catalog) -> DataFrame:
    """One row: songs, durations, artists, storage, span of years."""
    songs = cat.songs.agg(
        _n().alias("songs"), F.sum("duration_sec").cast("long").alias("total_sec"), X.mean("duration_sec", 2).alias("avg_sec"), F.min("duration_sec").alias("min_sec"), F.max("duration_sec").alias("max_sec"),
        F.min(F.when(F.col("release_year") >= 1900, F.col("release_year"))).alias("first_year"), F.max(F.when(F.col("release_year") >= 1900, F.col("release_year"))).alias("last_year"),
        F.min_by("sha_id", F.struct(-F.col("duration_sec"), "sha_id")).alias("longest_song"), F.min_by("sha_id", F.struct("duration_sec", "sha_id")).alias("shortest_song"),
    )
    artists = cat.song_artists.agg(F.count_distinct("artist_id").alias("artists"))
    size = cat.song_files.agg(F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("storage_bytes"))
    most = cat.song_artists.groupBy("artist_id").agg(F.count_distinct("sha_id").alias("n")).agg(F.min_by("artist_id", F.struct(-F.col("n"), "artist_id")).alias("most_prolific"))
    return songs.crossJoin(artists).crossJoin(size).crossJoin(most).withColumn("storage", X.format_storage("storage_bytes"))  # one row each


def songs_by_decade(cat: Catalog) -> DataFrame:
    """Songs by decade of release, from 1900 on."""
    return cat.songs.where("release_year >= 1900").groupBy((F.floor(F.col("release_year") / 10) * 10).cast("int").alias("decade")).agg(_n().alias("songs"))


def library_growth(cat: Catalog, period: str, as_of: datetime) -> DataFrame:
    """Songs added by day (week), week (month) or month, with the running total."""
    unit = {"week": "day", "month": "week"}.get(period, "month")
    added = cat.songs.where(within("created_at", *parse_period(period, as_of)))
    by = added.groupBy(F.to_date(F.date_trunc(unit, "created_at")).alias("bucket")).agg(_n().alias("added"))
    return running_total(by, "bucket", "added")


def library_composition(cat: Catalog) -> DataFrame:
    """Long form (dimension, value, songs, percentage): ingestion source, verified, features, year, album."""
    n = lambda c: F.count_if(c).cast("long")
    songs = cat.songs.join(cat.audio_features.select("sha_id", F.lit(True).alias("has")), "sha_id", "left")
    flags = songs.agg(_n().alias("total"), n("verified").alias("verified"), n(F.col("has")).alias("with_features"), n(F.col("release_year").isNotNull()).alias("with_year"), n(F.col("album").isNotNull() & (F.col("album") != "")).alias("with_album"))
    names = ["verified", "with_features", "with_year", "with_album"]
    long = flags.select("total", F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.lit("true").alias("value"), F.col(k).alias("songs")) for k in names])).alias("x")).select("x.*", "total")
    source = cat.song_files.groupBy(F.coalesce("ingestion_source", F.lit("unknown")).alias("value")).agg(F.count_distinct("sha_id").alias("songs"))
    source = source.crossJoin(source.agg(F.sum("songs").alias("total"))).select(F.lit("source").alias("dimension"), "value", "songs", "total")
    return long.union(source).select("dimension", "value", "songs", X.percent("songs", "total").alias("percentage"))


def audio_feature_stats(cat: Catalog) -> DataFrame:
    """Least, most, mean and median of each feature over songs with bpm or energy."""
    some = cat.audio_features.where("bpm IS NOT NULL OR energy IS NOT NULL")
    long = some.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in FEATURES])).alias("x")).select("x.*").where("v IS NOT NULL")
    return long.groupBy("feature").agg(F.min("v").alias("min"), F.max("v").alias("max"), X.mean("v", 4).alias("avg"), F.percentile("v", 0.5).alias("median"))


def audio_feature_histogram(cat: Catalog) -> DataFrame:
    """Songs by bins of each feature: tempo by 20 from 60, the others by 20 percent."""
    tempo = X.bins("v", [(80, "60-80"), (100, "80-100"), (120, "100-120"), (140, "120-140"), (160, "140-160")], "160+")
    share = X.bins("v", [(20, "0-20"), (40, "20-40"), (60, "40-60"), (80, "60-80")], "80-100")
    long = cat.audio_features.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in FEATURES])).alias("x")).select("x.*").where("v IS NOT NULL")
    return long.groupBy("feature", F.when(F.col("feature") == "bpm", tempo).otherwise(share).alias("bin")).agg(_n().alias("songs"))


def _corr(x: str, y: str) -> Column:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def feature_correlations(cat: Catalog) -> DataFrame:
    """Pearson's r of feature pairs over songs with bpm, energy and danceability; null without variance."""
    some = cat.audio_features.where("bpm IS NOT NULL AND energy IS NOT NULL AND danceability IS NOT NULL")
    wide = some.agg(*[F.round(_corr(x, y), 3).alias(f"{x}__{y}") for x, y in PAIRS])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"{x}__{y}").alias("r")) for x, y in PAIRS])).alias("p")).select("p.*")


def feature_sample(cat: Catalog, n: int = 500, seed: int = 7) -> DataFrame:
    """A random sample of songs' features."""
    return cat.audio_features.where("bpm IS NOT NULL").orderBy(F.rand(seed)).limit(n).select("sha_id", *FEATURES)


def key_distribution(cat: Catalog) -> DataFrame:
    """Songs by key and mode, with shares and each mode's total; modes compare without case."""
    name = F.element_at(F.array(*[F.lit(p) for p in PITCHES]), F.col("pitch_class") + 1)
    by = cat.audio_features.where("pitch_class IS NOT NULL").groupBy(name.alias("key"), F.lower("key_mode").alias("mode")).agg(_n().alias("songs"))
    total = by.groupBy("mode").agg(F.sum("songs").alias("mode_songs"))
    return by.crossJoin(by.agg(F.sum("songs").alias("total"))).join(total, "mode").select("key", "mode", "songs", X.percent("songs", "total").alias("percentage"), "mode_songs")


def mood_distribution(cat: Catalog) -> DataFrame:
    """Songs by primary mood with mean energy, danceability and tempo, and by secondary mood, each with its share."""
    mean = lambda c: X.mean(c, 1).alias(f"avg_{c}")
    one = cat.audio_features.where("mood_primary IS NOT NULL").groupBy(F.col("mood_primary").alias("mood")).agg(_n().alias("songs"), mean("energy"), mean("danceability"), mean("bpm"))
    two = cat.audio_features.where("mood_secondary IS NOT NULL").groupBy(F.col("mood_secondary").alias("mood")).agg(_n().alias("songs"))
    share = lambda df, kind: df.crossJoin(df.agg(F.sum("songs").alias("total"))).withColumn("percentage", X.percent("songs", "total")).withColumn("kind", F.lit(kind)).drop("total")
    return share(one, "primary").unionByName(share(two, "secondary"), allowMissingColumns=True)


def recently_added(cat: Catalog, as_of: datetime, days: int = 30, limit: int = 50) -> DataFrame:
    """The latest added songs, grouped by day: ids in order of addition, the latest first."""
    latest = cat.songs.where(within("created_at", as_of - timedelta(days=days), as_of)).orderBy(F.desc("created_at"), "sha_id").limit(limit)
    by = latest.groupBy(F.to_date("created_at").alias("day")).agg(F.sort_array(F.collect_list("sha_id")).alias("ids"))
    return by.select("day", F.size("ids").cast("long").alias("songs"), F.array_join("ids", ",").alias("sha_ids"))


def new_artists(cat: Catalog, period: str, as_of: datetime, limit: int = 10) -> DataFrame:
    """Artists (any role) first played in the period: when, the first song, plays and songs in the period."""
    start, end = parse_period(period, as_of)
    inside = within("started_at", start, end)
    plays = cat.play_sessions.where(F.col("started_at") < F.lit(end)).join(cat.song_artists.select("sha_id", "artist_id"), "sha_id")
    by = plays.groupBy("artist_id").agg(
        F.min("started_at").alias("first_played"), F.min_by("sha_id", F.struct("started_at", "session_id")).alias("first_song"), F.count_if(inside).cast("long").alias("plays"), F.count_distinct(F.when(inside, F.col("sha_id"))).alias("unique_songs")
    )
    return by.where(F.col("first_played") >= F.lit(start)).join(cat.artists, "artist_id").orderBy(F.desc("first_played"), "artist_id").limit(limit).select("artist_id", F.col("name").alias("artist"), "first_played", "first_song", "plays", "unique_songs")


def genre_exploration(cat: Catalog, period: str, as_of: datetime) -> DataFrame:
    """Plays of each genre by month, and whether the genre was first played in the period."""
    start, end = parse_period(period, as_of)
    by = cat.play_sessions.where(F.col("started_at") < F.lit(end)).groupBy("sha_id", F.to_date(F.date_trunc("month", "started_at")).alias("month")).agg(F.count_if(F.col("started_at") >= F.lit(start)).alias("n"), F.min("started_at").alias("first"))
    g = by.join(cat.song_genres, "sha_id").groupBy("genre", "month").agg(F.sum("n").cast("long").alias("plays"), F.min("first").alias("first"))
    new = g.groupBy("genre").agg((F.min("first") >= F.lit(start)).alias("is_new"))
    return g.where("plays > 0").join(new, "genre").select("genre", "month", "plays", "is_new")


def unplayed_songs(cat: Catalog, limit: int = 50) -> DataFrame:
    """Songs without any play, the latest added first."""
    never = cat.songs.join(cat.play_sessions.select("sha_id"), "sha_id", "left_anti").orderBy(F.desc("created_at"), "sha_id").limit(limit)
    return cat.with_primary(never).select("sha_id", "title", "artist", "album", "created_at")


def unplayed_share(cat: Catalog) -> DataFrame:
    """How many songs have no play, and their share of the library."""
    played = cat.play_sessions.select("sha_id").distinct().withColumn("played", F.lit(True))
    x = cat.songs.join(played, "sha_id", "left").agg(F.count_if(F.col("played").isNull()).cast("long").alias("unplayed"), _n().alias("total"))
    return x.select("unplayed", "total", X.percent("unplayed", "total").alias("percentage"))


def one_hit_wonders(cat: Catalog, period: str, as_of: datetime, limit: int = 50) -> DataFrame:
    """Songs played exactly once in the period."""
    once = cat.play_sessions.where(within("started_at", *parse_period(period, as_of))).groupBy("sha_id").agg(_n().alias("n"), F.max("started_at").alias("played_at"), F.bool_or("completed").alias("completed")).where("n = 1").drop("n")
    named = cat.with_primary(once).join(cat.songs.select("sha_id", "title"), "sha_id")
    return named.orderBy(F.desc("played_at"), "sha_id", "artist").limit(limit).select("sha_id", "title", "artist", "played_at", "completed")


def hidden_gems(cat: Catalog, limit: int = 50) -> DataFrame:
    """Songs with 2 to 5 plays whose mean completion is 70 percent or more."""
    by = cat.play_sessions.groupBy("sha_id").agg(_n().alias("plays"), F.avg("completion_percent").alias("a")).where("plays BETWEEN 2 AND 5 AND a >= 70")
    named = cat.with_primary(by).join(cat.songs.select("sha_id", "title"), "sha_id")
    return named.orderBy(F.desc("a"), "plays", "sha_id", "artist").limit(limit).select("sha_id", "title", "artist", "plays", F.round("a", 2).alias("avg_completion"))


def discovery_summary(cat: Catalog, period: str, as_of: datetime) -> DataFrame:
    """Songs added; artists, genres and songs whose first play lies in the period."""
    start, end = parse_period(period, as_of)
    first = cat.play_sessions.where(F.col("started_at") < F.lit(end)).groupBy("sha_id").agg(F.min("started_at").alias("t"))
    new = lambda df, key, name: df.groupBy(key).agg(F.min("t").alias("t")).agg(F.count_if(F.col("t") >= F.lit(start)).cast("long").alias(name))
    added = cat.songs.where(within("created_at", start, end)).agg(_n().alias("songs_added"))
    return added.crossJoin(new(first.join(cat.song_artists, "sha_id"), "artist_id", "new_artists")).crossJoin(new(first.join(cat.song_genres, "sha_id"), "genre", "new_genres")).crossJoin(new(first, "sha_id", "first_listens"))  # one row each


def seed_ranking(cat: Catalog, what: str, limit: int = 20) -> DataFrame:
    """Most frequent genres, artists or albums of the library, as seeds for discovery."""
    source = {"genre": cat.song_genres, "artist": cat.song_artists.join(cat.artists, "artist_id").withColumnRenamed("name", "artist"), "album": cat.songs.where("album <> ''")}[what]
    return source.groupBy(F.col(what).alias("seed")).agg(F.count_distinct("sha_id").alias("songs")).orderBy(F.desc("songs"), "seed").limit(limit)


def data_summary(cat: Catalog) -> DataFrame:
    """Plays, their span, events, and an estimate of the space that both take (200 bytes a play, 100 an event)."""
    plays = cat.play_sessions.agg(_n().alias("sessions"), F.min("started_at").alias("oldest"), F.max("started_at").alias("newest"))
    kb = (F.col("sessions") * 200 + F.col("events") * 100) / 1024
    return plays.crossJoin(cat.play_events.agg(_n().alias("events"))).withColumn("estimated_kb", F.round(kb, 2))  # one row each


def context_preferences(cat: Catalog, as_of: datetime, days: int = 30) -> DataFrame:
    """Plays of each song in each context of the last days; a context that isn't known is 'unknown'."""
    plays = cat.play_sessions.where(within("started_at", as_of - timedelta(days=days), as_of))
    return plays.groupBy(F.coalesce("context_type", F.lit("unknown")).alias("context"), "sha_id").agg(_n().alias("plays"))


def songs_by_year(cat: Catalog) -> DataFrame:
    """Songs and their time by release year."""
    return cat.songs.where("release_year IS NOT NULL").groupBy("release_year").agg(_n().alias("songs"), F.sum("duration_sec").cast("long").alias("total_sec"))


def behaviour_signals(cat: Catalog, as_of: datetime, days: int = 30, least: int = 3) -> DataFrame:
    """One row a song: frequently played, often skipped (2 skips or completions under 30), completed often, last played."""
    plays = cat.play_sessions.where(within("started_at", as_of - timedelta(days=days), as_of))
    by = plays.groupBy("sha_id").agg(
        _n().alias("plays"), F.count_if(F.col("skipped") | (F.col("completion_percent") < 30)).cast("long").alias("skips"), F.count_if(F.col("completed") | (F.col("completion_percent") >= 80)).cast("long").alias("completions"), F.max("started_at").alias("last_played")
    )
    return by.select("sha_id", "plays", "skips", "completions", "last_played", (F.col("plays") >= least).alias("frequent"), (F.col("skips") >= 2).alias("often_skipped"))


def implicit_preference(cat: Catalog, as_of: datetime, days: int = 90) -> DataFrame:
    """0.4 of plays (up to 10) + 0.4 of mean completion + 0.2 of recency, for every played song."""
    by = cat.play_sessions.where(within("started_at", as_of - timedelta(days=days), as_of)).groupBy("sha_id").agg(_n().alias("n"), F.avg("completion_percent").alias("a"), F.max("started_at").alias("t"))
    age = F.datediff(F.lit(as_of.date()), F.to_date("t"))
    score = 0.4 * F.least(F.col("n") / 10.0, F.lit(1.0)) + 0.4 * F.col("a") / 100 + 0.2 * F.greatest(F.lit(0.0), 1 - age / F.lit(float(days)))
    return by.select("sha_id", F.round(score, 6).alias("score"))

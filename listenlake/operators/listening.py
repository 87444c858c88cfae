"""Listening statistics over play sessions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from listenlake.catalog import Catalog
from listenlake.functions import exprs as X
from listenlake.functions.period import days_of, parse_period, within
from listenlake.operators.windows import current_and_longest_streak, listening_sessions


def _n() -> Column:
    return F.count(F.lit(1)).cast("long")


def _plays(cat: Catalog, period: str, as_of: datetime) -> DataFrame:
    return cat.play_sessions.where(within("started_at", *parse_period(period, as_of)))


def _sum_ms() -> Column:
    return F.coalesce(F.sum("duration_played_ms"), F.lit(0)).cast("long")


def overview(cat: Catalog, period: str, as_of: datetime) -> DataFrame:
    """One row of headline figures; artists count in any role, albums count '' but not null."""
    plays = _plays(cat, period, as_of)
    base = plays.agg(
        _n().alias("total_plays"), F.count_if("completed").cast("long").alias("completed_plays"), F.count_distinct("sha_id").alias("unique_songs"),
        _sum_ms().alias("total_duration_ms"), F.coalesce(X.mean("completion_percent", 2), F.lit(0.0)).alias("avg_completion"),
    )
    songs = plays.select("sha_id").distinct()
    artists = songs.join(cat.song_artists, "sha_id").agg(F.count_distinct("artist_id").alias("unique_artists"))
    albums = songs.join(cat.songs.where("album IS NOT NULL"), "sha_id").agg(F.count_distinct("album").alias("unique_albums"))
    by_day = plays.groupBy(F.to_date("started_at").alias("d")).agg(_n().alias("n"))
    day = by_day.agg(F.max_by(F.struct("d", "n"), F.struct("n", -F.unix_date("d"))).alias("m")).select(F.col("m.d").alias("most_active_day"))
    days = days_of(period, as_of)
    return (
        base.crossJoin(artists).crossJoin(albums).crossJoin(day).crossJoin(current_and_longest_streak(cat, as_of).select("current_streak", "longest_streak"))  # one row each
        .withColumn("plays_per_day", F.round(F.col("total_plays") / F.lit(float(days)), 1))
    )


def top_songs(cat: Catalog, period: str, as_of: datetime, limit: int = 10) -> DataFrame:
    """Most played songs with their primary artist."""
    joined = cat.with_primary(_plays(cat, period, as_of).groupBy("sha_id").agg(_n().alias("play_count"), _sum_ms().alias("total_duration_ms"), X.mean("completion_percent", 2).alias("avg_completion")))
    named = joined.join(cat.songs.select("sha_id", "title", "album", "duration_sec"), "sha_id")
    return named.orderBy(F.desc("play_count"), F.desc("total_duration_ms"), "sha_id", "artist").limit(limit).select("sha_id", "title", "artist", "album", "duration_sec", "play_count", "total_duration_ms", "avg_completion")


def top_artists(cat: Catalog, period: str, as_of: datetime, limit: int = 10) -> DataFrame:
    """Most played artists, in any role."""
    plays = _plays(cat, period, as_of).groupBy("sha_id").agg(_n().alias("n"), _sum_ms().alias("ms"))
    by = plays.join(cat.song_artists.select("sha_id", "artist_id"), "sha_id").groupBy("artist_id").agg(F.sum("n").alias("play_count"), F.count_distinct("sha_id").alias("unique_songs"), F.sum("ms").alias("total_duration_ms"))
    return by.join(cat.artists, "artist_id").orderBy(F.desc("play_count"), F.desc("total_duration_ms"), "artist_id").limit(limit).select("artist_id", F.col("name").alias("artist"), "play_count", "unique_songs", "total_duration_ms")


def top_albums(cat: Catalog, period: str, as_of: datetime, limit: int = 10) -> DataFrame:
    """Most played albums by album and primary artist; without a name there is no album."""
    plays = _plays(cat, period, as_of).groupBy("sha_id").agg(_n().alias("n"), _sum_ms().alias("ms"))
    named = cat.with_primary(plays.join(cat.songs.where("album <> ''").select("sha_id", "album"), "sha_id"))
    by = named.groupBy("album", "artist").agg(F.sum("n").alias("play_count"), F.count_distinct("sha_id").alias("unique_songs"), F.sum("ms").alias("total_duration_ms"))
    return by.orderBy(F.desc("play_count"), F.desc("total_duration_ms"), "album", "artist").limit(limit)


def history(cat: Catalog, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of plays, the latest first."""
    page = cat.play_sessions.orderBy(F.desc("started_at"), "session_id").offset(offset).limit(limit)
    return cat.with_primary(page).join(cat.songs.select("sha_id", "title", "album"), "sha_id").select("session_id", "sha_id", "title", "artist", "album", "started_at", "duration_played_ms", "completion_percent", "completed", "skipped", "context_type")


def heatmap(cat: Catalog, year: int) -> DataFrame:
    """Plays by day of week (Sunday 0) and hour, UTC."""
    plays = cat.play_sessions.where(within("started_at", datetime(year, 1, 1), datetime(year + 1, 1, 1)))
    return plays.groupBy(X.day_of_week("started_at").alias("day"), F.hour("started_at").alias("hour")).agg(_n().alias("plays"))


def heatmap_peaks(cat: Catalog, year: int) -> DataFrame:
    """Busiest and quietest day and hour among those with plays; ties go to the first; without plays all are 0."""
    cells = heatmap(cat, year)
    out = None
    for what in ("day", "hour"):
        by = cells.groupBy(what).agg(F.sum("plays").alias("n"))
        one = by.agg(F.max_by(what, F.struct("n", -F.col(what))).alias(f"peak_{what}"), F.min_by(what, F.struct("n", F.col(what))).alias(f"quiet_{what}"))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out.na.fill(0)


def genre_breakdown(cat: Catalog, period: str, as_of: datetime, limit: int = 20) -> DataFrame:
    """Plays by genre and their share of all genre plays; a play of a song with k genres counts k times."""
    plays = _plays(cat, period, as_of).groupBy("sha_id").agg(_n().alias("n"), _sum_ms().alias("ms"))
    by = plays.join(cat.song_genres, "sha_id").groupBy("genre").agg(F.sum("n").alias("play_count"), F.sum("ms").alias("total_duration_ms"))
    total = by.agg(F.sum("play_count").alias("total"))
    return by.crossJoin(total).select("genre", "play_count", "total_duration_ms", X.percent("play_count", "total").alias("percentage")).orderBy(F.desc("play_count"), "genre").limit(limit)


def _two_periods(cat: Catalog, as_of: datetime, days: int) -> DataFrame:
    middle, first = as_of - timedelta(days=days), as_of - timedelta(days=2 * days)
    return cat.play_sessions.where(within("started_at", first, as_of)).withColumn("now", F.col("started_at") >= F.lit(middle))


def trends(cat: Catalog, as_of: datetime, days: int = 7) -> DataFrame:
    """Change of plays and time against the period before, and songs never played before."""
    both = _two_periods(cat, as_of, days)
    base = both.agg(
        F.count_if("now").cast("long").alias("plays"), F.count_if(~F.col("now")).cast("long").alias("previous_plays"),
        F.coalesce(F.sum(F.when(F.col("now"), F.col("duration_played_ms"))), F.lit(0)).cast("long").alias("ms"),
        F.coalesce(F.sum(F.when(~F.col("now"), F.col("duration_played_ms"))), F.lit(0)).cast("long").alias("previous_ms"),
    )
    before = cat.play_sessions.where(F.col("started_at") < F.lit(as_of - timedelta(days=days))).select("sha_id").distinct()
    new = both.where("now").join(before, "sha_id", "left_anti").agg(F.count_distinct("sha_id").alias("new_songs"))
    return base.crossJoin(new).select("plays", "previous_plays", X.percent_change("plays", "previous_plays").alias("plays_change"), X.percent_change("ms", "previous_ms").alias("duration_change"), "new_songs")


def trending_artists(cat: Catalog, as_of: datetime, days: int = 7, limit: int = 5) -> DataFrame:
    """Artists, by name, with over 1.5 times the plays of the period before (rising) or under half of them (declining)."""
    plays = _two_periods(cat, as_of, days).groupBy("sha_id").agg(F.count_if("now").alias("c"), F.count_if(~F.col("now")).alias("p"))
    by = plays.join(cat.song_artists.select("sha_id", "artist_id"), "sha_id").join(cat.artists, "artist_id").groupBy("name").agg(F.sum("c").alias("plays"), F.sum("p").alias("previous_plays"))
    up = by.where((F.col("plays") > 0) & (F.col("plays") > 1.5 * F.col("previous_plays"))).orderBy(F.desc("plays"), "name").limit(limit)
    down = by.where((F.col("previous_plays") > 0) & (F.col("plays") < 0.5 * F.col("previous_plays"))).orderBy(F.desc("previous_plays"), "name").limit(limit)
    return up.withColumn("trend", F.lit("rising")).union(down.withColumn("trend", F.lit("declining")))


def timeline(cat: Catalog, period: str, as_of: datetime, granularity: str = "day") -> DataFrame:
    """Plays and time by day (also for hour), week or month, beside the previous period's, moved forward by the period's days."""
    unit = {"hour": "day"}.get(granularity, granularity)
    start, end = parse_period(period, as_of)
    bucket = lambda ts: F.to_date(F.date_trunc(unit, ts))
    now = cat.play_sessions.where(within("started_at", start, end)).groupBy(bucket(F.col("started_at")).alias("bucket")).agg(_n().alias("plays"), _sum_ms().alias("duration_ms"))
    if period == "all":
        return now.withColumn("previous_plays", F.lit(0).cast("long"))
    span = end - start
    moved = F.col("started_at") + F.make_dt_interval(F.lit(span.days), F.lit(0), F.lit(0), F.lit(float(span.seconds)))
    old = cat.play_sessions.where(within("started_at", start - span, start)).groupBy(bucket(moved).alias("bucket")).agg(_n().alias("previous_plays"))
    return now.join(old, "bucket", "left").na.fill({"previous_plays": 0})


def completion_trend(cat: Catalog, period: str, as_of: datetime) -> DataFrame:
    """Per UTC day: plays, completion rate and skip rate."""
    rate = lambda c: F.round(F.count_if(c) * 100.0 / F.count(F.lit(1)), 1)
    return _plays(cat, period, as_of).groupBy(F.to_date("started_at").alias("day")).agg(_n().alias("plays"), rate("completed").alias("completion_rate"), rate("skipped").alias("skip_rate"))


def skipped_songs(cat: Catalog, period: str, as_of: datetime, limit: int = 10, least: int = 3) -> DataFrame:
    """Songs by skip rate among those with ``least`` plays."""
    by = _plays(cat, period, as_of).groupBy("sha_id").agg(_n().alias("plays"), F.count_if("skipped").cast("long").alias("skips")).where(F.col("plays") >= least)
    named = cat.with_primary(by.withColumn("skip_rate", F.round(F.col("skips") * 100.0 / F.col("plays"), 1))).join(cat.songs.select("sha_id", "title"), "sha_id")
    return named.orderBy(F.desc("skip_rate"), F.desc("skips"), "sha_id", "artist").limit(limit).select("sha_id", "title", "artist", "plays", "skips", "skip_rate")


def skipped_genres(cat: Catalog, period: str, as_of: datetime, least: int = 5) -> DataFrame:
    """Skip rate of genres with ``least`` plays."""
    by = _plays(cat, period, as_of).groupBy("sha_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("skipped").alias("k")).join(cat.song_genres, "sha_id").groupBy("genre").agg(F.sum("n").alias("plays"), F.sum("k").alias("skips"))
    return by.where(F.col("plays") >= least).withColumn("skip_rate", F.round(F.col("skips") * 100.0 / F.col("plays"), 1))


def skipped_hours(cat: Catalog, period: str, as_of: datetime) -> DataFrame:
    """Skip rate by hour of day."""
    by = _plays(cat, period, as_of).groupBy(F.hour("started_at").alias("hour")).agg(_n().alias("plays"), F.count_if("skipped").cast("long").alias("skips"))
    return by.withColumn("skip_rate", F.round(F.col("skips") * 100.0 / F.col("plays"), 1))


def context_distribution(cat: Catalog, period: str, as_of: datetime) -> DataFrame:
    """Plays by context and their share; no context is 'unknown'."""
    by = _plays(cat, period, as_of).groupBy(F.coalesce("context_type", F.lit("unknown")).alias("context")).agg(_n().alias("plays"), _sum_ms().alias("duration_ms"))
    return by.crossJoin(by.agg(F.sum("plays").alias("total"))).select("context", "plays", "duration_ms", X.percent("plays", "total").alias("percentage"))


def context_by_week(cat: Catalog, period: str, as_of: datetime, contexts: list[str]) -> DataFrame:
    """Plays by week (from Monday), with a column for each of ``contexts``."""
    week = F.to_date(F.date_trunc("week", "started_at")).alias("week")
    return _plays(cat, period, as_of).groupBy(week).pivot("context_type", contexts).agg(_n()).na.fill(0)


SESSION_BUCKETS = ["<15min", "15-30min", "30-60min", "1-2hr", ">2hr"]


def session_summary(cat: Catalog, period: str, as_of: datetime, by_user: bool = True) -> DataFrame:
    """Number of listening sessions in each length bucket, with all buckets, and the songs in them."""
    s = listening_sessions(_plays(cat, period, as_of), by_user)
    bucket = X.bins(F.col("length_ms") / 60000.0, [(15, SESSION_BUCKETS[0]), (30, SESSION_BUCKETS[1]), (60, SESSION_BUCKETS[2]), (120, SESSION_BUCKETS[3])], SESSION_BUCKETS[4])
    by = s.groupBy(bucket.alias("bucket")).agg(_n().alias("sessions"), F.sum("songs").alias("songs"))
    all_ = cat.spark.createDataFrame([(b,) for b in SESSION_BUCKETS], "bucket string")
    return all_.join(by, "bucket", "left").na.fill(0)


def longest_sessions(cat: Catalog, period: str, as_of: datetime, limit: int = 10, by_user: bool = True) -> DataFrame:
    """The longest listening sessions."""
    s = listening_sessions(_plays(cat, period, as_of), by_user)
    return s.orderBy(F.desc("length_ms"), "user_id", "started_at").limit(limit)


def enhanced_heatmap(cat: Catalog, year: int) -> DataFrame:
    """Every slot of the week with its plays and its most played song (ties: the smallest id); empty slots have 0."""
    plays = cat.play_sessions.where(within("started_at", datetime(year, 1, 1), datetime(year + 1, 1, 1)))
    by = plays.groupBy(X.day_of_week("started_at").alias("day"), F.hour("started_at").alias("hour"), "sha_id").agg(_n().alias("n"))
    slot = by.groupBy("day", "hour").agg(F.sum("n").alias("plays"), F.min_by("sha_id", F.struct(-F.col("n"), "sha_id")).alias("top_song"))
    spine = cat.spark.range(7 * 24).select(F.floor(F.col("id") / 24).cast("int").alias("day"), (F.col("id") % 24).cast("int").alias("hour"))
    return spine.join(slot, ["day", "hour"], "left").na.fill({"plays": 0})


PERSONALITY = [(5, 9, "Early Bird"), (9, 17, "Daytime Listener"), (17, 21, "Evening Enthusiast")]


def wrapped(cat: Catalog, year: int) -> DataFrame:
    """A year in one row: totals, top song, artist, album and genre, listener type by peak hour, busiest day."""
    as_of = datetime(year + 1, 1, 1)
    period = str(year)
    plays = _plays(cat, period, as_of)
    base = plays.agg(_n().alias("total_plays"), _sum_ms().alias("total_duration_ms"), F.count_distinct("sha_id").alias("unique_songs"))
    song = top_songs(cat, period, as_of, 1).select(F.col("sha_id").alias("top_song"))
    artist = top_artists(cat, period, as_of, 1).select(F.col("artist").alias("top_artist"))
    album = top_albums(cat, period, as_of, 1).select(F.col("album").alias("top_album"))
    genre = genre_breakdown(cat, period, as_of, 1).select(F.col("genre").alias("top_genre"))
    hour = plays.groupBy(F.hour("started_at").alias("h")).agg(_n().alias("n")).agg(F.min_by("h", F.struct(-F.col("n"), "h")).alias("peak_hour"))
    day = plays.groupBy(F.to_date("started_at").alias("d")).agg(_n().alias("n")).agg(F.min_by(F.struct("d", "n"), F.struct(-F.col("n"), "d")).alias("m")).select(F.col("m.d").alias("busiest_day"), F.col("m.n").alias("busiest_day_plays"))
    kind = F.lit(None).cast("string")
    for a, b, name in PERSONALITY:
        kind = F.when(F.col("peak_hour").between(a, b - 1), name).otherwise(kind)
    out = base
    for one in (song, artist, album, genre, hour, day):
        out = out.join(one, F.lit(True), "left")  # one row each
    return out.withColumn("personality", F.coalesce(kind, F.lit("Night Owl")))


def monthly_listening(cat: Catalog, year: int) -> DataFrame:
    """Plays and time of each month of a year."""
    return _plays(cat, str(year), datetime(year + 1, 1, 1)).groupBy(F.month("started_at").alias("month")).agg(_n().alias("plays"), _sum_ms().alias("duration_ms"))


def daily_activity(cat: Catalog, as_of: datetime, days: int = 30) -> DataFrame:
    """Plays and added songs on each of the last ``days`` days up to as_of's, zeros included."""
    last = as_of.date()
    first = last - timedelta(days=days - 1)
    spine = cat.spark.range(days).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
    of = lambda df, ts, name: df.where((F.to_date(ts) >= F.lit(first)) & (F.to_date(ts) <= F.lit(last))).groupBy(F.to_date(ts).alias("day")).agg(_n().alias(name))
    return spine.join(of(cat.play_sessions, "started_at", "plays"), "day", "left").join(of(cat.songs, "created_at", "additions"), "day", "left").na.fill(0)


def personality(cat: Catalog, period: str, as_of: datetime) -> DataFrame:
    """Variety (artists per 100 plays, 50 without plays), mean completion, energy and danceability, and the first listener type whose rule holds."""
    o = overview(cat, period, as_of).select("total_plays", "unique_artists", "avg_completion")
    audio = cat.audio_features.agg(F.round(F.avg("energy") / 100, 4).alias("avg_energy"), F.round(F.avg("danceability") / 100, 4).alias("avg_danceability"))
    variety = F.when(F.col("total_plays") > 0, F.round(F.col("unique_artists") * 100.0 / F.greatest("total_plays", F.lit(1)), 2)).otherwise(50.0)
    # The listener types and their rules, in order.
    kind = (
        F.when(F.col("variety") > 60, "The Explorer")
        .when((F.col("variety") < 25) & (F.col("avg_completion") > 70), "The Devotee")
        .when((F.col("avg_energy") > 0.7) & (F.col("avg_danceability") > 0.6), "The Energizer")
        .when(F.col("avg_energy") < 0.4, "The Chill Seeker")
        .when(F.col("avg_completion") > 85, "The Completionist")
        .when((F.col("avg_completion") < 50) & (F.col("total_plays") > 100), "The Sampler")
        .otherwise("The Balanced Listener")
    )
    return o.crossJoin(audio).withColumn("variety", variety).withColumn("listener_type", kind)  # one row each

"""Registered maintenance, text and audio queries and their SQL twins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from listenlake.catalog import oracle
from listenlake.functions import audio as U, exprs as X, fuzzy as FZ, text as TX
from listenlake.operators import tables as M, views as VW
from listenlake.plans.base import bind
from listenlake.runtime import scratch_path
from listenlake.streaming import playback, stateful as SF

QUERIES, ORACLE = {}, {}
P, S = "play_sessions", "songs"


def add(name, f, sql=None, *tables):
    QUERIES[name] = bind(f)
    if sql:
        ORACLE[name] = oracle(sql, *tables) if tables else sql


for _name, _unit in (("m01_daily", "day"), ("m02_weekly", "week"), ("m03_monthly", "month")):
    add(_name, lambda c, u=_unit: M.listening_stats(c, u), f"SELECT CAST(date_trunc('{_unit}', started_at) AS DATE) AS bucket, count(*) AS plays, count(*) FILTER (completed) AS completed, count(*) FILTER (skipped) AS skips, count(DISTINCT sha_id) AS unique_songs, CAST(sum(duration_played_ms) AS BIGINT) AS duration_ms, mean(completion_percent, 2) AS avg_completion FROM play_sessions GROUP BY 1", P)
add("m04_top_songs_monthly", M.top_songs_monthly, "WITH x AS (SELECT CAST(date_trunc('month', started_at) AS DATE) AS month, sha_id, count(*) AS plays, CAST(sum(duration_played_ms) AS BIGINT) AS duration_ms FROM play_sessions GROUP BY 1, 2) SELECT month, x.sha_id, title, coalesce(artist, 'Unknown Artist') AS artist, plays, duration_ms FROM x JOIN songs s ON s.sha_id = x.sha_id LEFT JOIN primary_artist a ON a.sha_id = x.sha_id", P, S)
add("m06_songs_with_features", M.songs_with_features, "SELECT s.*, a.* EXCLUDE (sha_id) FROM songs s LEFT JOIN audio_features a ON s.sha_id = a.sha_id", S, "audio_features")
add("m07_artist_variants", lambda c: M.artist_variants(c.artists), "WITH v AS (SELECT artist_id, name, unnest(list_distinct([lower(trim(name)), replace(lower(trim(name)), ' ', ''), CASE WHEN lower(trim(name)) LIKE 'the %' THEN substr(lower(trim(name)), 5) ELSE lower(trim(name)) END])) AS n FROM artists) SELECT n AS normalized_name, max(artist_id) AS artist_id, arg_max(name, artist_id) AS canonical_name FROM v GROUP BY 1", "artists")
add("m08_artist_song_counts", lambda c: c.song_artists.groupBy("artist_id").agg(F.count_distinct("sha_id").alias("song_count")), "SELECT artist_id, count(DISTINCT sha_id) AS song_count FROM song_artists GROUP BY 1", "song_artists")
add("d01_upsert", lambda c: M.upsert(c.songs.select("sha_id", "title", "album"), c.songs.where("release_year > 2000").select("sha_id", F.upper("title").alias("title"), F.lit(None).cast("string").alias("album")), ["sha_id"]), "SELECT sha_id, CASE WHEN release_year > 2000 THEN upper(title) ELSE title END AS title, album FROM songs", S)
add("d02_upsert_overwrite", lambda c: M.upsert(c.songs.select("sha_id", "title", "album"), c.songs.where("release_year > 2000").select("sha_id", F.upper("title").alias("title"), F.lit(None).cast("string").alias("album")), ["sha_id"], overwrite=True), "SELECT sha_id, CASE WHEN release_year > 2000 THEN upper(title) ELSE title END AS title, CASE WHEN release_year > 2000 THEN NULL ELSE album END AS album FROM songs", S)
add("d04_dedup_candidates", lambda c: M.dedup_candidates(c.download_queue.select(F.col("queue_id").alias("no"), "title", "artist")), """
WITH x AS (SELECT queue_id AS no, title, artist, lower(trim(title)) AS t, lower(trim(coalesce(artist, ''))) AS a FROM download_queue), f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY t, a ORDER BY no) = 1)
SELECT no, title, artist FROM f WHERE a <> '' OR t NOT IN (SELECT t FROM f WHERE a <> '')""", "download_queue")
add("d05_unknown_candidates", lambda c: M.unknown_candidates(c.download_queue.select(F.col("queue_id").alias("no"), "title", "artist"), c.download_queue.where("status = 'downloaded'")), """
WITH k AS (SELECT lower(trim(title)) AS t, lower(trim(coalesce(artist, ''))) AS a FROM download_queue WHERE status = 'downloaded')
SELECT queue_id AS no, title, artist FROM download_queue q WHERE CASE WHEN artist IS NULL THEN lower(trim(title)) NOT IN (SELECT t FROM k) ELSE NOT EXISTS (SELECT 1 FROM k WHERE t = lower(trim(q.title)) AND a = lower(trim(q.artist))) END""", "download_queue")
add("d06_content_dedup", lambda c: M.split_new_content(c.songs.select(F.col("sha_id").cast("long").alias("no"), "title"), c.songs.limit(0), "title").select("no", "sha_id", "duplicate"), "SELECT CAST(sha_id AS BIGINT) AS no, sha256(title) AS sha_id, row_number() OVER (PARTITION BY title ORDER BY CAST(sha_id AS BIGINT)) > 1 AS duplicate FROM songs", S)
add("d07_compact_log", lambda c: M.compact_log(c.play_sessions.select(F.col("session_id").cast("long").alias("no"), F.concat(F.lit('{"download_id":"'), F.col("user_id") % 50, F.lit('","stage":"'), "context_type", F.lit('"}')).alias("value"))).select("download_id", "stage", "no"), "SELECT CAST(user_id % 50 AS VARCHAR) AS download_id, context_type AS stage, max(CAST(session_id AS BIGINT)) AS no FROM play_sessions WHERE context_type IS NOT NULL GROUP BY 1, 2", P)
add("d10_replace_children", lambda c: M.replace_children(c.song_genres, c.songs.where("release_year = 1990").select("sha_id", F.lit("nineties").alias("genre")), "sha_id"), "SELECT sha_id, genre FROM song_genres WHERE sha_id NOT IN (SELECT sha_id FROM songs WHERE release_year = 1990) UNION ALL SELECT sha_id, 'nineties' FROM songs WHERE release_year = 1990", S, "song_genres")
add("t12_advance_queue", lambda c: M.advance_queue(c.download_queue, c.download_queue.where("status <> 'failed'").select("queue_id", F.when(F.col("status") == "downloaded", "stored").otherwise("hashed").alias("status"))), "SELECT * REPLACE (CASE WHEN status = 'pending' THEN 'hashed' ELSE status END AS status, CAST(attempts + CASE WHEN status = 'pending' THEN 1 ELSE 0 END AS INT) AS attempts) FROM download_queue WHERE status <> 'downloaded'", "download_queue")
add("t12_stage_times", lambda c: M.advance_queue_at(c.download_queue, c.download_queue.where("status <> 'failed'").select("queue_id", F.when(F.col("status") == "downloaded", "stored").otherwise("hashed").alias("status")), datetime(2024, 2, 1)).select("queue_id", "status", "attempts", "downloaded_at", "hashed_at", "updated_at"), "SELECT queue_id, CASE WHEN status = 'pending' THEN 'hashed' ELSE status END AS status, CAST(attempts + CASE WHEN status = 'pending' THEN 1 ELSE 0 END AS INT) AS attempts, CAST(NULL AS TIMESTAMP) AS downloaded_at, CASE WHEN status = 'pending' THEN TIMESTAMP '2024-02-01' END AS hashed_at, CASE WHEN status = 'pending' THEN TIMESTAMP '2024-02-01' END AS updated_at FROM download_queue WHERE status <> 'downloaded'", "download_queue")
add("t13_retention", lambda c: M.retain(c.play_sessions.select("session_id", F.col("started_at").alias("timestamp")), c.play_sessions, c.spark.sql("SELECT DATE '2024-01-01' AS start_date, DATE '2024-01-02' AS end_date, 2L AS length_days"), datetime(2024, 4, 20))[0], "SELECT session_id, started_at AS timestamp FROM play_sessions WHERE started_at >= TIMESTAMP '2024-01-21'", P)
_EVENTS = """SELECT CAST(event_id AS STRING) AS event_id, CAST(event_id % 3000 AS STRING) AS session_id, CAST(user_id AS STRING) AS sha_id, CAST(60000 AS BIGINT) AS song_duration_ms, CASE event_type WHEN 'click' THEN 'pause' WHEN 'error' THEN 'end' WHEN 'purchase' THEN 'complete' WHEN 'signup' THEN 'seek' ELSE 'start' END AS event_type, CAST(floor(value * 500) AS BIGINT) AS position_ms, CASE WHEN user_id % 2 = 0 THEN 'next_song' END AS reason, ts AS timestamp FROM events"""
add("t04_sessions_from_events", lambda c: playback.sessions_batch(c.spark.sql(_EVENTS.replace("FROM events", "FROM {e}"), e=c._stored["events"])).select("session_id", "started_at", "ended_at", "duration_played_ms", F.round("completion_percent", 6).alias("completion_percent"), "completed", "skipped"), f"""
WITH e AS ({_EVENTS}), s AS (SELECT * FROM e WHERE event_type = 'start' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY timestamp, event_id) = 1),
 a AS (SELECT e.*, s.timestamp AS s_at FROM e JOIN s USING (session_id) WHERE (e.timestamp, e.event_id) > (s.timestamp, s.event_id)),
 t AS (SELECT * FROM a WHERE event_type IN ('complete', 'end') QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY timestamp, event_id) = 1),
 m AS (SELECT a.session_id, arg_max(a.position_ms, (a.timestamp, a.event_id)) AS p FROM a LEFT JOIN t USING (session_id) WHERE a.event_type = 'pause' AND (t.session_id IS NULL OR (a.timestamp, a.event_id) < (t.timestamp, t.event_id)) GROUP BY 1),
 x AS (SELECT s.session_id, s.timestamp AS started_at, t.timestamp AS ended_at, coalesce(t.position_ms, p, s.position_ms) AS pos, t.event_type AS k, t.reason FROM s LEFT JOIN t USING (session_id) LEFT JOIN m USING (session_id)),
 y AS (SELECT *, CASE WHEN k IS NOT NULL THEN least(100.0, pos * 100.0 / 60000) END AS pct FROM x)
SELECT session_id, started_at, ended_at, pos AS duration_played_ms, round(CAST(pct AS DOUBLE), 6) AS completion_percent, coalesce(k = 'complete' OR pct >= 80, FALSE) AS completed, coalesce(k = 'end' AND pct < 30 AND reason = 'next_song', FALSE) AS skipped FROM y""")
add("p07_durations", lambda c: c.spark.sql("SELECT CAST(p_partkey * 977 * 977 AS BIGINT) AS ms FROM {part}", part=c._stored["part"]).select("ms", X.format_duration("ms").alias("text")), """
WITH x AS (SELECT CAST(p_partkey * 977 * 977 AS BIGINT) AS ms FROM part) SELECT ms, CASE WHEN ms = 0 THEN '0m' WHEN ms // 1000 < 60 THEN (ms // 1000) || 's' WHEN ms // 60000 < 60 THEN (ms // 60000) || 'm' WHEN ms // 3600000 < 24 THEN (ms // 3600000) || 'h ' || (ms // 60000 % 60) || 'm' ELSE (ms // 86400000) || 'd ' || (ms // 3600000 % 24) || 'h' END AS text FROM x""")
add("p06_album_keys", lambda c: c.with_primary(c.songs).select("sha_id", X.album_key("album", "artist").alias("album_key")), "SELECT s.sha_id, CASE WHEN coalesce(album, '') = '' THEN '' ELSE lower(album) || '::' || lower(coalesce(artist, 'Unknown Artist')) END AS album_key FROM songs s LEFT JOIN primary_artist a ON s.sha_id = a.sha_id", S)
add("u02_normalize", lambda c: c.songs.select("sha_id", TX.normalize_title(F.concat("title", F.lit(" (Live!) feat. X"))).alias("normal")), "SELECT sha_id, lower(title) AS normal FROM songs", S)
_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
#: A search: the queries are the artists whose id is divisible by 50, the answers come from all artists.
add("u03_similar_names", lambda c: TX.similar_pairs(c.artists.where("artist_id % 50 = 0"), c.artists, "artist_id", "artist_id", "name", "name", 0.6), f"""
WITH l AS (SELECT artist_id, {_GRAMS.format(c='name')} AS g FROM artists WHERE artist_id % 50 = 0), r AS (SELECT artist_id, {_GRAMS.format(c='name')} AS g FROM artists),
 x AS (SELECT l.artist_id AS l_key, r.artist_id AS r_key, round(len(list_intersect(l.g, r.g)) / (len(l.g) + len(r.g) - len(list_intersect(l.g, r.g))), 6) AS similarity FROM l, r) SELECT * FROM x WHERE similarity >= 0.6""", "artists")
#: The same search at the operator's own threshold: each query's ten most similar names.
add("u03_similar_best", lambda c: TX.most_similar(c.artists.where("artist_id % 50 = 0"), c.artists, "artist_id", "artist_id", "name", "name"), f"""
WITH l AS (SELECT artist_id, {_GRAMS.format(c='name')} AS g FROM artists WHERE artist_id % 50 = 0), r AS (SELECT artist_id, {_GRAMS.format(c='name')} AS g FROM artists),
 x AS (SELECT l.artist_id AS l_key, r.artist_id AS r_key, round(len(list_intersect(l.g, r.g)) / (len(l.g) + len(r.g) - len(list_intersect(l.g, r.g))), 6) AS similarity FROM l, r)
SELECT * FROM x WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY l_key ORDER BY similarity DESC, r_key) <= 10""", "artists")
#: File names of every shape that the parser knows; {a} is the artist and {t} the title.
SHAPES = ["01 - {a} - {t} (Official Video).mp3", "{a} - {t}.flac", "{t} - {a}.mp3", "{a}-{t}.mp3", "{a}_-_{t}.webm", "{a}_{t}.mp3", "{t} ({a}).mp3", "({a}) {t}.mp3", "{a}{T}.mp3", "{a} {t} [dQw4w9WgXcQ].mp3", "{t} by {a}.m4a", "{t}.mp3"]


def _file_names(c):
    t, a = F.col("title"), F.col("artist")
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (F.pmod(F.xxhash64("sha_id"), F.lit(len(SHAPES))) + 1).cast("int"))
    name = F.replace(F.replace(F.replace(shape, F.lit("{a}"), a), F.lit("{t}"), t), F.lit("{T}"), F.initcap(t))
    return c.with_primary(c.songs).select("sha_id", name.alias("name"))


def _counted(c):
    n = c.song_artists.groupBy("artist_id").agg(F.count_distinct("sha_id").alias("song_count"))
    return c.artists.join(n, "artist_id", "left")


add("u04_filenames", lambda c: TX.known_filenames(_file_names(c), _counted(c)))
#: Names that differ from an artist's by signs only: each means that artist. The queries are the artists whose id is divisible by 50.
add("u01_fuzzy_artists", lambda c: FZ.resolve_artists(c.artists.where("artist_id % 50 = 0").select(F.replace("name", F.lit("#"), F.lit(" - ")).alias("name")), c.artists), "SELECT replace(name, '#', ' - ') AS name, artist_id, name AS artist, CAST(1 AS DOUBLE) AS score FROM artists WHERE artist_id % 50 = 0", "artists")

#: Releases of the asked title in other letters for every second song, of another title or of none for the others.
_RELEASE = "CASE WHEN CAST(sha_id AS INT) % 2 = 0 THEN upper(album) || ' (Deluxe)' WHEN CAST(sha_id AS INT) % 3 = 0 THEN 'zzz' END"
add("u07_album_gate", lambda c: c.songs.select("sha_id", FZ.album_fits(F.col("album"), F.expr(_RELEASE)).alias("fits")), "SELECT sha_id, coalesce(album, '') = '' OR CAST(sha_id AS INT) % 2 = 0 AS fits FROM songs", S)


def _after_a_batch(c, name):
    """A view built from the plays before the 20th, then renewed where the later plays touch it."""
    root, late = scratch_path(c.spark, "views"), F.col("started_at") >= F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz")
    one = {name: VW.VIEWS[name]}
    VW.refresh_views(VW._over(c, c.play_sessions.where(~late)), root, views=one)
    VW.refresh_views(c, root, c.play_sessions.where(late), one)
    return VW.read_view(c.spark, root, name)


for _name, _same in (("daily", "m01_daily"), ("weekly", "m02_weekly"), ("top_songs_monthly", "m04_top_songs_monthly")):
    QUERIES[f"m05_{_name}_after_a_batch"] = bind(lambda c, n=_name: _after_a_batch(c, n))
    ORACLE[f"m05_{_name}_after_a_batch"] = ORACLE[_same]
add("t05_user_streaks", lambda c: SF.user_streaks(c.play_sessions), """
WITH d AS (SELECT DISTINCT user_id, CAST(started_at AS DATE) AS d FROM play_sessions WHERE (completed OR completion_percent >= 10) AND user_id IS NOT NULL),
 i AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INT) AS k FROM d)
SELECT user_id, min(d) AS start_date, max(d) AS end_date, count(*) AS length_days FROM i GROUP BY user_id, k""", P)
add("u11_tempo", lambda c: c.audio_features.select("sha_id", F.round(U.fold_bpm(F.col("bpm") * F.when(F.col("bpm") > 120, 3).otherwise(F.lit(0.25))), 6).alias("bpm")), "WITH x AS (SELECT sha_id, bpm * CASE WHEN bpm > 120 THEN 3 ELSE 0.25 END AS b FROM audio_features) SELECT sha_id, round(CASE WHEN b < 60 THEN b * pow(2.0, ceil(log2(60 / b))) WHEN b > 180 THEN b / pow(2.0, ceil(log2(b / 180))) ELSE b END, 6) AS bpm FROM x", "audio_features")
add("u13_scaled", lambda c: U.scaled(U.scaled(c.audio_features, "energy", "z"), "energy", "share", "range").select("sha_id", F.round("z", 6).alias("z"), F.round("share", 6).alias("share")), "SELECT sha_id, round((energy - avg(energy) OVER ()) / stddev_pop(energy) OVER (), 6) AS z, round((energy - min(energy) OVER ()) / (max(energy) OVER () - min(energy) OVER ()), 6) AS share FROM audio_features", "audio_features")

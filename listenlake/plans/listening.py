"""Registered listening queries and their SQL twins."""

from __future__ import annotations

from listenlake.catalog import oracle
from listenlake.operators import listening as L, reports as RP, windows as W
from listenlake.plans.base import AS_OF, MONTH, WEEK2, WEEK, bind

QUERIES, ORACLE = {}, {}
P, S = "play_sessions", "songs"


def add(name, f, sql=None, *tables):
    QUERIES[name] = bind(f)
    if sql:
        ORACLE[name] = oracle(sql, *tables)


_MS = "CAST(coalesce(sum(duration_played_ms), 0) AS BIGINT)"
_STREAK = """d AS (SELECT DISTINCT CAST(started_at AS DATE) AS d FROM play_sessions WHERE completed OR completion_percent >= 10),
 isl AS (SELECT min(d) AS a, max(d) AS b, count(*) AS n FROM (SELECT d, d - CAST(row_number() OVER (ORDER BY d) AS INT) AS k FROM d) GROUP BY k)"""

add("a01_overview", lambda c: L.overview(c, "month", AS_OF), f"""
WITH p AS (SELECT * FROM play_sessions WHERE {MONTH}), {_STREAK}
SELECT count(*) AS total_plays, count(*) FILTER (completed) AS completed_plays, count(DISTINCT sha_id) AS unique_songs, {_MS} AS total_duration_ms,
 mean(completion_percent, 2) AS avg_completion,
 (SELECT count(DISTINCT artist_id) FROM p JOIN song_artists USING (sha_id)) AS unique_artists,
 (SELECT count(DISTINCT album) FROM p JOIN songs USING (sha_id)) AS unique_albums,
 (SELECT d FROM (SELECT CAST(started_at AS DATE) AS d, count(*) AS n FROM p GROUP BY 1) ORDER BY n DESC, d LIMIT 1) AS most_active_day,
 (SELECT coalesce(max(n), 0) FROM isl WHERE b >= DATE '2024-01-30') AS current_streak, (SELECT coalesce(max(n), 0) FROM isl) AS longest_streak,
 round(count(*) / 30.0, 1) AS plays_per_day FROM p""", P, S, "song_artists")
add("a02_top_songs", lambda c: L.top_songs(c, "month", AS_OF), f"""
SELECT p.sha_id, title, coalesce(artist, 'Unknown Artist') AS artist, album, duration_sec, count(*) AS play_count, {_MS} AS total_duration_ms, mean(completion_percent, 2) AS avg_completion
FROM play_sessions p JOIN songs s ON p.sha_id = s.sha_id LEFT JOIN primary_artist a ON p.sha_id = a.sha_id WHERE {MONTH}
GROUP BY p.sha_id, title, 3, album, duration_sec, a.artist_id ORDER BY play_count DESC, total_duration_ms DESC, p.sha_id, 3 LIMIT 10""", P, S)
add("a03_top_artists", lambda c: L.top_artists(c, "month", AS_OF), f"""
SELECT a.artist_id, a.name AS artist, count(*) AS play_count, count(DISTINCT p.sha_id) AS unique_songs, {_MS} AS total_duration_ms
FROM play_sessions p JOIN song_artists sa USING (sha_id) JOIN artists a USING (artist_id) WHERE {MONTH} GROUP BY 1, 2 ORDER BY 3 DESC, 5 DESC, 1 LIMIT 10""", P, "song_artists", "artists")
add("a04_top_albums", lambda c: L.top_albums(c, "month", AS_OF), f"""
SELECT album, coalesce(artist, 'Unknown Artist') AS artist, count(*) AS play_count, count(DISTINCT p.sha_id) AS unique_songs, {_MS} AS total_duration_ms
FROM play_sessions p JOIN songs s ON p.sha_id = s.sha_id LEFT JOIN primary_artist a ON p.sha_id = a.sha_id WHERE album <> '' AND {MONTH} GROUP BY 1, 2 ORDER BY 3 DESC, 5 DESC, 1, 2 LIMIT 10""", P, S)
add("a05_history", lambda c: L.history(c, 50, 20), """
SELECT session_id, p.sha_id, title, coalesce(artist, 'Unknown Artist') AS artist, album, started_at, duration_played_ms, completion_percent, completed, skipped, context_type
FROM (SELECT * FROM play_sessions ORDER BY started_at DESC, session_id LIMIT 50 OFFSET 20) p JOIN songs s ON p.sha_id = s.sha_id LEFT JOIN primary_artist a ON p.sha_id = a.sha_id""", P, S)
add("a06_heatmap", lambda c: L.heatmap(c, 2024), "SELECT CAST(dayofweek(started_at) AS INT) AS day, CAST(hour(started_at) AS INT) AS hour, count(*) AS plays FROM play_sessions WHERE year(started_at) = 2024 GROUP BY 1, 2", P)
add("a06_heatmap_peaks", lambda c: L.heatmap_peaks(c, 2024), """
WITH d AS (SELECT CAST(dayofweek(started_at) AS INT) AS k, count(*) AS n FROM play_sessions WHERE year(started_at) = 2024 GROUP BY 1),
 h AS (SELECT CAST(hour(started_at) AS INT) AS k, count(*) AS n FROM play_sessions WHERE year(started_at) = 2024 GROUP BY 1)
SELECT (SELECT k FROM d ORDER BY n DESC, k LIMIT 1) AS peak_day, (SELECT k FROM d ORDER BY n, k LIMIT 1) AS quiet_day, (SELECT k FROM h ORDER BY n DESC, k LIMIT 1) AS peak_hour, (SELECT k FROM h ORDER BY n, k LIMIT 1) AS quiet_hour""", P)
add("a07_genre_breakdown", lambda c: L.genre_breakdown(c, "month", AS_OF), f"""
WITH g AS (SELECT genre, count(*) AS play_count, {_MS} AS total_duration_ms FROM play_sessions JOIN song_genres USING (sha_id) WHERE {MONTH} GROUP BY 1)
SELECT *, round(play_count * 100.0 / (SELECT sum(play_count) FROM g), 1) AS percentage FROM g ORDER BY play_count DESC, genre LIMIT 20""", P, "song_genres")
add("a08_trends", lambda c: L.trends(c, AS_OF, 7), f"""
WITH n AS (SELECT count(*) AS c, sum(duration_played_ms) AS m FROM play_sessions WHERE {WEEK}), o AS (SELECT count(*) AS c, sum(duration_played_ms) AS m FROM play_sessions WHERE {WEEK2})
SELECT n.c AS plays, o.c AS previous_plays, round((n.c - o.c) * 100.0 / o.c, 1) AS plays_change, round((n.m - o.m) * 100.0 / o.m, 1) AS duration_change,
 (SELECT count(DISTINCT sha_id) FROM play_sessions WHERE {WEEK} AND sha_id NOT IN (SELECT sha_id FROM play_sessions WHERE started_at < TIMESTAMP '2024-01-24')) AS new_songs FROM n, o""", P)
add("a08_trending_artists", lambda c: L.trending_artists(c, AS_OF, 7), f"""
WITH x AS (SELECT name, count(*) FILTER ({WEEK}) AS plays, count(*) FILTER ({WEEK2}) AS previous_plays FROM play_sessions JOIN song_artists USING (sha_id) JOIN artists USING (artist_id) GROUP BY 1)
SELECT * FROM (SELECT *, 'rising' AS trend FROM x WHERE plays > 0 AND plays > 1.5 * previous_plays ORDER BY plays DESC, name LIMIT 5)
UNION ALL SELECT * FROM (SELECT *, 'declining' AS trend FROM x WHERE previous_plays > 0 AND plays < 0.5 * previous_plays ORDER BY previous_plays DESC, name LIMIT 5)""", P, "song_artists", "artists")
add("a16_timeline", lambda c: L.timeline(c, "week", AS_OF, "day"), f"""
WITH n AS (SELECT CAST(started_at AS DATE) AS bucket, count(*) AS plays, {_MS} AS duration_ms FROM play_sessions WHERE {WEEK} GROUP BY 1),
 o AS (SELECT CAST(started_at + INTERVAL '7' DAY AS DATE) AS bucket, count(*) AS previous_plays FROM play_sessions WHERE {WEEK2} GROUP BY 1)
SELECT n.*, coalesce(previous_plays, 0) AS previous_plays FROM n LEFT JOIN o USING (bucket)""", P)
add("a17_completion_trend", lambda c: L.completion_trend(c, "month", AS_OF), f"""
SELECT CAST(started_at AS DATE) AS day, count(*) AS plays, round(count(*) FILTER (completed) * 100.0 / count(*), 1) AS completion_rate, round(count(*) FILTER (skipped) * 100.0 / count(*), 1) AS skip_rate FROM play_sessions WHERE {MONTH} GROUP BY 1""", P)
add("a18_skipped_songs", lambda c: L.skipped_songs(c, "month", AS_OF), f"""
WITH x AS (SELECT sha_id, count(*) AS plays, count(*) FILTER (skipped) AS skips FROM play_sessions WHERE {MONTH} GROUP BY 1 HAVING count(*) >= 3)
SELECT x.sha_id, title, coalesce(artist, 'Unknown Artist') AS artist, plays, skips, round(skips * 100.0 / plays, 1) AS skip_rate FROM x JOIN songs s ON x.sha_id = s.sha_id LEFT JOIN primary_artist a ON a.sha_id = x.sha_id ORDER BY 6 DESC, skips DESC, x.sha_id, 3 LIMIT 10""", P, S)
add("a18_skipped_genres", lambda c: L.skipped_genres(c, "month", AS_OF), f"""
SELECT genre, count(*) AS plays, count(*) FILTER (skipped) AS skips, round(count(*) FILTER (skipped) * 100.0 / count(*), 1) AS skip_rate FROM play_sessions JOIN song_genres USING (sha_id) WHERE {MONTH} GROUP BY 1 HAVING count(*) >= 5""", P, "song_genres")
add("a18_skipped_hours", lambda c: L.skipped_hours(c, "month", AS_OF), f"""
SELECT CAST(hour(started_at) AS INT) AS hour, count(*) AS plays, count(*) FILTER (skipped) AS skips, round(count(*) FILTER (skipped) * 100.0 / count(*), 1) AS skip_rate FROM play_sessions WHERE {MONTH} GROUP BY 1""", P)
add("a19_contexts", lambda c: L.context_distribution(c, "month", AS_OF), f"""
WITH x AS (SELECT coalesce(context_type, 'unknown') AS context, count(*) AS plays, {_MS} AS duration_ms FROM play_sessions WHERE {MONTH} GROUP BY 1)
SELECT *, round(plays * 100.0 / (SELECT sum(plays) FROM x), 1) AS percentage FROM x""", P)
add("a19_contexts_by_week", lambda c: L.context_by_week(c, "month", AS_OF, ["click", "purchase", "signup", "view"]), f"""
SELECT CAST(date_trunc('week', started_at) AS DATE) AS week, count(*) FILTER (context_type = 'click') AS click, count(*) FILTER (context_type = 'purchase') AS purchase, count(*) FILTER (context_type = 'signup') AS signup, count(*) FILTER (context_type = 'view') AS view FROM play_sessions WHERE {MONTH} GROUP BY 1""", P)


def _sessions(by: str) -> str:
    user = "user_id" if by else "CAST(NULL AS BIGINT)"
    over = f"PARTITION BY {user}"
    return f"""s0 AS (SELECT {user} AS user_id, session_id, started_at, coalesce(ended_at, started_at) AS until, duration_played_ms, completed,
   lag(coalesce(ended_at, started_at)) OVER ({over} ORDER BY started_at, session_id) AS prev FROM play_sessions WHERE {MONTH}),
 s1 AS (SELECT *, sum(CASE WHEN prev IS NULL OR started_at - prev > INTERVAL '30' MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY started_at) AS no FROM s0),
 ses AS (SELECT user_id, min(started_at) AS started_at, max(until) AS ended_at, count(*) AS songs, CAST(sum(duration_played_ms) AS BIGINT) AS duration_ms, count(*) FILTER (completed) AS completed,
   CAST(floor((epoch_us(max(until)) - epoch_us(min(started_at))) / 1000) AS BIGINT) AS length_ms FROM s1 GROUP BY user_id, no)"""


add("a20_sessions", lambda c: L.session_summary(c, "month", AS_OF), f"""
WITH {_sessions("user_id")}, b AS (SELECT unnest(['<15min', '15-30min', '30-60min', '1-2hr', '>2hr']) AS bucket),
 g AS (SELECT CASE WHEN length_ms < 900000 THEN '<15min' WHEN length_ms < 1800000 THEN '15-30min' WHEN length_ms < 3600000 THEN '30-60min' WHEN length_ms < 7200000 THEN '1-2hr' ELSE '>2hr' END AS bucket, count(*) AS n, CAST(sum(songs) AS BIGINT) AS k FROM ses GROUP BY 1)
SELECT bucket, coalesce(n, 0) AS sessions, coalesce(k, 0) AS songs FROM b LEFT JOIN g USING (bucket)""", P)
add("a20_longest_sessions", lambda c: L.longest_sessions(c, "month", AS_OF), f"WITH {_sessions('user_id')} SELECT * FROM ses ORDER BY length_ms DESC, user_id, started_at LIMIT 10", P)
add("w02_sessions_one_listener", lambda c: W.listening_sessions(c.play_sessions.where(MONTH), by_user=False), f"WITH {_sessions('')} SELECT * FROM ses", P)
add("w05_streaks", W.streaks, f"WITH {_STREAK} SELECT a AS start_date, b AS end_date, n AS length_days FROM isl", P)
add("a21_enhanced_heatmap", lambda c: L.enhanced_heatmap(c, 2024), """
WITH x AS (SELECT CAST(dayofweek(started_at) AS INT) AS day, CAST(hour(started_at) AS INT) AS hour, sha_id, count(*) AS n FROM play_sessions WHERE year(started_at) = 2024 GROUP BY 1, 2, 3),
 y AS (SELECT day, hour, CAST(sum(n) OVER (PARTITION BY day, hour) AS BIGINT) AS plays, sha_id AS top_song FROM x QUALIFY row_number() OVER (PARTITION BY day, hour ORDER BY n DESC, sha_id) = 1)
SELECT CAST(i // 24 AS INT) AS day, CAST(i % 24 AS INT) AS hour, coalesce(plays, 0) AS plays, top_song FROM range(168) t(i) LEFT JOIN y ON y.day = i // 24 AND y.hour = i % 24""", P)
add("a22_wrapped", lambda c: L.wrapped(c, 2024), f"""
WITH p AS (SELECT * FROM play_sessions WHERE year(started_at) = 2024),
 h AS (SELECT CAST(hour(started_at) AS INT) AS h, count(*) AS n FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1), d AS (SELECT CAST(started_at AS DATE) AS d, count(*) AS n FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT count(*) AS total_plays, {_MS} AS total_duration_ms, count(DISTINCT sha_id) AS unique_songs,
 (SELECT sha_id FROM p GROUP BY 1 ORDER BY count(*) DESC, sum(duration_played_ms) DESC, 1 LIMIT 1) AS top_song,
 (SELECT name FROM p JOIN song_artists USING (sha_id) JOIN artists a USING (artist_id) GROUP BY a.artist_id, name ORDER BY count(*) DESC, sum(duration_played_ms) DESC, a.artist_id LIMIT 1) AS top_artist,
 (SELECT album FROM p JOIN songs s ON p.sha_id = s.sha_id LEFT JOIN primary_artist a ON p.sha_id = a.sha_id WHERE album <> '' GROUP BY album, coalesce(artist, 'Unknown Artist') ORDER BY count(*) DESC, sum(duration_played_ms) DESC, album, coalesce(artist, 'Unknown Artist') LIMIT 1) AS top_album,
 (SELECT genre FROM p JOIN song_genres USING (sha_id) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_genre,
 (SELECT h FROM h) AS peak_hour, (SELECT d FROM d) AS busiest_day, (SELECT n FROM d) AS busiest_day_plays,
 (SELECT CASE WHEN h BETWEEN 5 AND 8 THEN 'Early Bird' WHEN h BETWEEN 9 AND 16 THEN 'Daytime Listener' WHEN h BETWEEN 17 AND 20 THEN 'Evening Enthusiast' ELSE 'Night Owl' END FROM h) AS personality FROM p""", P, S, "song_artists", "artists", "song_genres")
add("a22_months", lambda c: L.monthly_listening(c, 2024), f"SELECT CAST(month(started_at) AS INT) AS month, count(*) AS plays, {_MS} AS duration_ms FROM play_sessions WHERE year(started_at) = 2024 GROUP BY 1", P)
add("a23_daily_activity", lambda c: L.daily_activity(c, AS_OF, 30), """
WITH s AS (SELECT DATE '2024-01-02' + CAST(i AS INT) AS day FROM range(30) t(i)), p AS (SELECT CAST(started_at AS DATE) AS day, count(*) AS n FROM play_sessions GROUP BY 1), a AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM songs GROUP BY 1)
SELECT s.day, coalesce(p.n, 0) AS plays, coalesce(a.n, 0) AS additions FROM s LEFT JOIN p ON s.day = p.day LEFT JOIN a ON s.day = a.day""", P, S)
add("a33_personality", lambda c: L.personality(c, "month", AS_OF), f"""
WITH p AS (SELECT * FROM play_sessions WHERE {MONTH}), o AS (SELECT count(*) AS total_plays, (SELECT count(DISTINCT artist_id) FROM p JOIN song_artists USING (sha_id)) AS unique_artists, mean(completion_percent, 2) AS avg_completion FROM p),
 v AS (SELECT *, round(unique_artists * 100.0 / greatest(total_plays, 1), 2) AS variety FROM o)
SELECT *, CASE WHEN variety > 60 THEN 'The Explorer' WHEN variety < 25 AND avg_completion > 70 THEN 'The Devotee' WHEN avg_energy > 0.7 AND avg_danceability > 0.6 THEN 'The Energizer' WHEN avg_energy < 0.4 THEN 'The Chill Seeker'
 WHEN avg_completion > 85 THEN 'The Completionist' WHEN avg_completion < 50 AND total_plays > 100 THEN 'The Sampler' ELSE 'The Balanced Listener' END AS listener_type
FROM v, (SELECT round(avg(energy) / 100, 4) AS avg_energy, round(avg(danceability) / 100, 4) AS avg_danceability FROM audio_features)""", P, "song_artists", "audio_features")
add("s12_share_card", lambda c: RP.share_card(c, "month", AS_OF))

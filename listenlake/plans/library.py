"""Registered library and discovery queries and their SQL twins."""

from __future__ import annotations

from listenlake.catalog import PITCHES, oracle
from listenlake.operators import library as L
from listenlake.plans.base import AS_OF, MONTH, bind

QUERIES, ORACLE = {}, {}
P, S, A = "play_sessions", "songs", "audio_features"


def add(name, f, sql=None, *tables):
    QUERIES[name] = bind(f)
    if sql:
        ORACLE[name] = oracle(sql, *tables)


_LONG = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS v FROM audio_features" for f in L.FEATURES)

add("a09_library_stats", L.library_stats, """
SELECT count(*) AS songs, CAST(sum(duration_sec) AS BIGINT) AS total_sec, mean(duration_sec, 2) AS avg_sec, min(duration_sec) AS min_sec, max(duration_sec) AS max_sec, min(release_year) AS first_year, max(release_year) AS last_year,
 (SELECT sha_id FROM songs ORDER BY duration_sec DESC, sha_id LIMIT 1) AS longest_song, (SELECT sha_id FROM songs ORDER BY duration_sec, sha_id LIMIT 1) AS shortest_song,
 (SELECT count(DISTINCT artist_id) FROM song_artists) AS artists, (SELECT CAST(sum(file_size) AS BIGINT) FROM song_files) AS storage_bytes,
 (SELECT artist_id FROM song_artists GROUP BY 1 ORDER BY count(DISTINCT sha_id) DESC, 1 LIMIT 1) AS most_prolific, (SELECT CASE WHEN b < 1024 THEN CAST(b AS BIGINT) || ' B' WHEN b < 1048576 THEN format('{:.1f} KB', b / 1024.0) WHEN b < 1073741824 THEN format('{:.1f} MB', b / 1048576.0) ELSE format('{:.2f} GB', b / 1073741824.0) END FROM (SELECT sum(file_size) AS b FROM song_files)) AS storage FROM songs""", S, "song_artists", "song_files")
add("a09_decades", L.songs_by_decade, "SELECT CAST(floor(release_year / 10) * 10 AS INT) AS decade, count(*) AS songs FROM songs WHERE release_year >= 1900 GROUP BY 1", S)
add("a10_growth", lambda c: L.library_growth(c, "month", AS_OF), "WITH g AS (SELECT CAST(date_trunc('week', created_at) AS DATE) AS bucket, count(*) AS added FROM songs WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-01-31' GROUP BY 1) SELECT *, CAST(sum(added) OVER (ORDER BY bucket) AS BIGINT) AS running_total FROM g", S)
add("a11_composition", L.library_composition, """
WITH f AS (SELECT s.*, a.sha_id IS NOT NULL AS has FROM songs s LEFT JOIN audio_features a ON s.sha_id = a.sha_id),
 src AS (SELECT coalesce(ingestion_source, 'unknown') AS value, count(*) AS n FROM song_files GROUP BY 1),
 x AS (SELECT 'verified' AS dimension, 'true' AS value, count(*) FILTER (verified) AS songs, count(*) AS t FROM f UNION ALL SELECT 'with_features', 'true', count(*) FILTER (has), count(*) FROM f UNION ALL SELECT 'with_year', 'true', count(release_year), count(*) FROM f
  UNION ALL SELECT 'with_album', 'true', count(*) FILTER (album <> ''), count(*) FROM f UNION ALL SELECT 'source', value, n, (SELECT sum(n) FROM src) FROM src)
SELECT dimension, value, CAST(songs AS BIGINT) AS songs, round(songs * 100.0 / t, 1) AS percentage FROM x""", S, A, "song_files")
add("a12_feature_stats", L.audio_feature_stats, f"WITH l AS ({_LONG}) SELECT feature, min(v) AS min, max(v) AS max, mean(v, 4) AS avg, quantile_cont(v, 0.5) AS median FROM l WHERE v IS NOT NULL GROUP BY 1", A)
add("a12_feature_histogram", L.audio_feature_histogram, f"""WITH l AS ({_LONG}) SELECT feature, CASE WHEN feature = 'bpm' THEN CASE WHEN v < 80 THEN '60-80' WHEN v < 100 THEN '80-100' WHEN v < 120 THEN '100-120' WHEN v < 140 THEN '120-140' WHEN v < 160 THEN '140-160' ELSE '160+' END
 ELSE CASE WHEN v < 20 THEN '0-20' WHEN v < 40 THEN '20-40' WHEN v < 60 THEN '40-60' WHEN v < 80 THEN '60-80' ELSE '80-100' END END AS bin, count(*) AS songs FROM l WHERE v IS NOT NULL GROUP BY 1, 2""", A)
add("a13_correlations", L.feature_correlations, " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 3) AS r FROM audio_features" for x, y in L.PAIRS), A)
add("a13_sample", L.feature_sample)
add("a14_keys", L.key_distribution, f"WITH k AS (SELECT [{', '.join(repr(p) for p in PITCHES)}][pitch_class + 1] AS key, key_mode AS mode, count(*) AS songs FROM audio_features GROUP BY 1, 2) SELECT *, round(songs * 100.0 / (SELECT sum(songs) FROM k), 1) AS percentage, CAST(sum(songs) OVER (PARTITION BY mode) AS BIGINT) AS mode_songs FROM k", A)
add("a15_moods", L.mood_distribution, """
WITH a AS (SELECT mood_primary AS mood, count(*) AS songs, mean(energy, 1) AS avg_energy, mean(danceability, 1) AS avg_danceability, mean(bpm, 1) AS avg_bpm, 'primary' AS kind FROM audio_features GROUP BY 1
 UNION ALL SELECT mood_secondary, count(*), NULL, NULL, NULL, 'secondary' FROM audio_features WHERE mood_secondary IS NOT NULL GROUP BY 1)
SELECT *, round(songs * 100.0 / sum(songs) OVER (PARTITION BY kind), 1) AS percentage FROM a""", A)
add("a24_recently_added", lambda c: L.recently_added(c, AS_OF, 30, 50), """
WITH l AS (SELECT * FROM songs WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-01-31' ORDER BY created_at DESC, sha_id LIMIT 50)
SELECT CAST(created_at AS DATE) AS day, count(*) AS songs, string_agg(sha_id, ',' ORDER BY sha_id) AS sha_ids FROM l GROUP BY 1""", S)
add("a25_new_artists", lambda c: L.new_artists(c, "week", AS_OF), """
WITH p AS (SELECT artist_id, started_at, session_id, sha_id FROM play_sessions JOIN song_artists USING (sha_id) WHERE started_at < TIMESTAMP '2024-01-31'),
 f AS (SELECT artist_id, min(started_at) AS first_played, arg_min(sha_id, (started_at, session_id)) AS first_song, count(*) FILTER (started_at >= TIMESTAMP '2024-01-24') AS plays, count(DISTINCT sha_id) FILTER (started_at >= TIMESTAMP '2024-01-24') AS unique_songs FROM p GROUP BY 1)
SELECT f.artist_id, name AS artist, first_played, first_song, plays, unique_songs FROM f JOIN artists USING (artist_id) WHERE first_played >= TIMESTAMP '2024-01-24' ORDER BY first_played DESC, 1 LIMIT 10""", P, "song_artists", "artists")
add("a25_new_artists_of_year", lambda c: L.new_artists(c, "2024", AS_OF), """
WITH p AS (SELECT artist_id, started_at, session_id, sha_id FROM play_sessions JOIN song_artists USING (sha_id) WHERE started_at >= TIMESTAMP '2024-01-01'),
 f AS (SELECT artist_id, min(started_at) AS first_played, arg_min(sha_id, (started_at, session_id)) AS first_song, count(*) AS plays, count(DISTINCT sha_id) AS unique_songs FROM p GROUP BY 1)
SELECT f.artist_id, name AS artist, first_played, first_song, plays, unique_songs FROM f JOIN artists USING (artist_id) ORDER BY first_played DESC, 1 LIMIT 10""", P, "song_artists", "artists")
add("a26_genre_exploration", lambda c: L.genre_exploration(c, "month", AS_OF), f"""
WITH g AS (SELECT genre, CAST(date_trunc('month', started_at) AS DATE) AS month, started_at FROM play_sessions JOIN song_genres USING (sha_id) WHERE started_at < TIMESTAMP '2024-01-31')
SELECT genre, month, count(*) AS plays, min(min(started_at)) OVER (PARTITION BY genre) >= TIMESTAMP '2024-01-01' AS is_new FROM g WHERE {MONTH} GROUP BY 1, 2""", P, "song_genres")
add("a27_unplayed", lambda c: L.unplayed_songs(c, 50), "WITH n AS (SELECT * FROM songs WHERE sha_id NOT IN (SELECT sha_id FROM play_sessions) ORDER BY created_at DESC, sha_id LIMIT 50) SELECT n.sha_id, title, coalesce(artist, 'Unknown Artist') AS artist, album, created_at FROM n LEFT JOIN primary_artist a ON a.sha_id = n.sha_id", P, S)
add("a27_unplayed_share", L.unplayed_share, "SELECT count(*) FILTER (sha_id NOT IN (SELECT sha_id FROM play_sessions)) AS unplayed, count(*) AS total, round(count(*) FILTER (sha_id NOT IN (SELECT sha_id FROM play_sessions)) * 100.0 / count(*), 1) AS percentage FROM songs", P, S)
add("a28_one_hit_wonders", lambda c: L.one_hit_wonders(c, "month", AS_OF), f"""
WITH o AS (SELECT sha_id, max(started_at) AS played_at, bool_or(completed) AS completed FROM play_sessions WHERE {MONTH} GROUP BY 1 HAVING count(*) = 1)
SELECT o.sha_id, title, coalesce(artist, 'Unknown Artist') AS artist, played_at, completed FROM o JOIN songs s ON o.sha_id = s.sha_id LEFT JOIN primary_artist a ON a.sha_id = o.sha_id ORDER BY played_at DESC, o.sha_id, 3 LIMIT 50""", P, S)
add("a29_hidden_gems", lambda c: L.hidden_gems(c, 50), """
WITH o AS (SELECT sha_id, count(*) AS plays, avg(completion_percent) AS a FROM play_sessions GROUP BY 1 HAVING count(*) BETWEEN 2 AND 5 AND avg(completion_percent) >= 70)
SELECT o.sha_id, title, coalesce(artist, 'Unknown Artist') AS artist, plays, round(a, 2) AS avg_completion FROM o JOIN songs s ON o.sha_id = s.sha_id LEFT JOIN primary_artist p ON p.sha_id = o.sha_id ORDER BY a DESC, plays, o.sha_id, 3 LIMIT 50""", P, S)
add("a30_discovery", lambda c: L.discovery_summary(c, "week", AS_OF), """
WITH f AS (SELECT sha_id, min(started_at) AS t FROM play_sessions WHERE started_at < TIMESTAMP '2024-01-31' GROUP BY 1)
SELECT (SELECT count(*) FROM songs WHERE created_at >= TIMESTAMP '2024-01-24' AND created_at < TIMESTAMP '2024-01-31') AS songs_added,
 (SELECT count(*) FILTER (m >= TIMESTAMP '2024-01-24') FROM (SELECT min(t) AS m FROM f JOIN song_artists USING (sha_id) GROUP BY artist_id)) AS new_artists,
 (SELECT count(*) FILTER (m >= TIMESTAMP '2024-01-24') FROM (SELECT min(t) AS m FROM f JOIN song_genres USING (sha_id) GROUP BY genre)) AS new_genres, (SELECT count(*) FROM f WHERE t >= TIMESTAMP '2024-01-24') AS first_listens""", P, S, "song_artists", "song_genres")
for _w, _sql, _t in (("genre", "SELECT genre AS seed, count(DISTINCT sha_id) AS songs FROM song_genres", "song_genres"), ("artist", "SELECT name AS seed, count(DISTINCT sha_id) AS songs FROM song_artists JOIN artists USING (artist_id)", "song_artists"), ("album", "SELECT album AS seed, count(DISTINCT sha_id) AS songs FROM songs WHERE album <> ''", "songs")):
    add(f"a31_seed_{_w}s", lambda c, w=_w: L.seed_ranking(c, w), f"{_sql} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", _t, "artists")
add("a32_data_summary", L.data_summary, """
WITH e AS (SELECT count(*) AS events FROM play_events), s AS (SELECT count(*) AS sessions, min(started_at) AS oldest, max(started_at) AS newest FROM play_sessions)
SELECT sessions, oldest, newest, events, round((sessions * 200 + events * 100) / 1024, 2) AS estimated_kb FROM s, e""", P, "play_events")
add("a34_contexts", lambda c: L.context_preferences(c, AS_OF), f"SELECT coalesce(context_type, 'unknown') AS context, sha_id, count(*) AS plays FROM play_sessions WHERE {MONTH} GROUP BY 1, 2", P)
add("a09_years", L.songs_by_year, "SELECT release_year, count(*) AS songs, CAST(sum(duration_sec) AS BIGINT) AS total_sec FROM songs WHERE release_year IS NOT NULL GROUP BY 1", "songs")
add("a34_signals", lambda c: L.behaviour_signals(c, AS_OF), f"""
SELECT sha_id, count(*) AS plays, count(*) FILTER (skipped OR completion_percent < 30) AS skips, count(*) FILTER (completed OR completion_percent >= 80) AS completions, max(started_at) AS last_played, count(*) >= 3 AS frequent, count(*) FILTER (skipped OR completion_percent < 30) >= 2 AS often_skipped FROM play_sessions WHERE {MONTH} GROUP BY 1""", P)
add("a35_preference", lambda c: L.implicit_preference(c, AS_OF), """
SELECT sha_id, round(0.4 * least(count(*) / 10.0, 1) + 0.4 * avg(completion_percent) / 100 + 0.2 * greatest(0, 1 - (DATE '2024-01-31' - CAST(max(started_at) AS DATE)) / 90.0), 6) AS score FROM play_sessions WHERE started_at >= TIMESTAMP '2023-11-02' AND started_at < TIMESTAMP '2024-01-31' GROUP BY 1""", P)

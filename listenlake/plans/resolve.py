"""Registered resolution and edit queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from listenlake.catalog import oracle
from listenlake.functions import audio as U
from listenlake.operators import browse as B, resolve as R
from listenlake.plans.base import bind

QUERIES, ORACLE = {}, {}
S, QUEUE = "songs", "download_queue"


def add(name, f, sql, *tables):
    QUERIES[name] = bind(f)
    ORACLE[name] = oracle(sql, *tables) if tables else sql


add("b07_album_pages", B.album_pages, """
WITH pa AS (SELECT sha_id, arg_min(artist, artist_id) AS n FROM primary_artist GROUP BY 1), x AS (SELECT md5(lower(album) || '::' || lower(n)) AS album_id, sha_id, title, track_number, duration_sec FROM songs JOIN pa USING (sha_id) WHERE album <> '')
SELECT album_id, CAST(row_number() OVER (PARTITION BY album_id ORDER BY track_number NULLS LAST, title, sha_id) AS INT) AS position, sha_id, title, track_number, duration_sec FROM x""", S)

add("d08_distinct_names", lambda c: c.songs.select("sha_id", F.array_join(R.distinct_names(F.array("title", F.upper("title"), F.concat(F.lit(" "), F.coalesce("album", F.lit(""))), F.lower(F.coalesce("album", F.lit(""))))), "|").alias("names")),
    "SELECT sha_id, CASE WHEN coalesce(album, '') = '' THEN title ELSE title || '|' || album END AS names FROM songs", S)

_MATCHES = "SELECT sha_id, title || ' (new)' AS title, 'matched' AS album, CASE WHEN track_number > 7 THEN 61 END AS duration_sec, CAST(NULL AS INT) AS release_year, track_number + 1 AS track_number, 'discogs' AS source FROM songs WHERE release_year > 1985"


def _matches(c):
    return c.spark.sql(_MATCHES.replace("FROM songs", "FROM {songs}"), songs=c.songs)


add("d12_apply_matches", lambda c: R.apply_matches(c.songs, _matches(c)), f"""
WITH m AS ({_MATCHES}) SELECT s.* REPLACE (coalesce(m.title, s.title) AS title, CASE WHEN m.sha_id IS NULL THEN s.album ELSE m.album END AS album, coalesce(m.duration_sec, s.duration_sec) AS duration_sec, coalesce(m.track_number, s.track_number) AS track_number,
 m.sha_id IS NOT NULL OR verified AS verified, coalesce(m.source, verification_source) AS verification_source) FROM songs s LEFT JOIN m ON s.sha_id = m.sha_id""", S)

add("d13_link_album", lambda c: R.link_album(c.songs, c.songs.where("album IS NULL OR album = ''").select("sha_id", F.lit("Loose Songs").alias("album"), (F.col("track_number") > 5).alias("mark_verified"))), """
SELECT * REPLACE (CASE WHEN coalesce(album, '') = '' THEN 'Loose Songs' ELSE album END AS album, verified OR (coalesce(album, '') = '' AND track_number > 5) AS verified, CASE WHEN coalesce(album, '') = '' AND track_number > 5 THEN 'manual' ELSE verification_source END AS verification_source) FROM songs""", S)

add("d14_edited_artists", lambda c: R.edited_artists(c.download_queue.select(F.col("queue_id").cast("string").alias("sha_id"), F.concat(F.coalesce("artist", F.lit("")), F.lit("; Guest,guest ,"), "status").alias("artists"))), """
WITH x AS (SELECT CAST(queue_id AS VARCHAR) AS sha_id, list_filter([coalesce(artist, ''), 'Guest', status], lambda n: n <> '') AS l FROM download_queue), y AS (SELECT sha_id, unnest(l) AS name, generate_subscripts(l, 1) AS i FROM x)
SELECT sha_id, name, CASE WHEN i = 1 THEN 'primary' ELSE 'featured' END AS role FROM y""", QUEUE)

_PATHS = "SELECT '/in/' || CASE WHEN artist IS NULL THEN '' ELSE artist || ' - ' END || replace(title, ' ', '_') || CASE status WHEN 'pending' THEN '.MP3' WHEN 'downloaded' THEN '.flac' ELSE '.txt' END AS path FROM download_queue"
add("d16_imports", lambda c: R.imports(c.spark.sql(_PATHS.replace("FROM download_queue", "FROM {q}"), q=c.download_queue)), f"""
WITH p AS ({_PATHS}), q AS (SELECT path, replace(regexp_replace(substr(path, 5), '\\.[A-Za-z0-9]+$', ''), '_', ' ') AS stem, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS suffix FROM p)
SELECT path, CASE WHEN contains(stem, ' - ') THEN split_part(stem, ' - ', 1) END AS artist, CASE WHEN contains(stem, ' - ') THEN split_part(stem, ' - ', 2) ELSE stem END AS title,
 CASE suffix WHEN 'mp3' THEN 'downloaded' WHEN 'flac' THEN 'converting' ELSE 'failed' END AS status, CASE WHEN suffix NOT IN ('mp3', 'flac') THEN 'unsupported file type' END AS error FROM q""", QUEUE)

add("u05_title_variants", lambda c: c.songs.select("sha_id", F.array_join(R.title_variants(F.concat("title", F.lit(" feat. Someone (Official Video)"))), "|").alias("variants")),
    "SELECT sha_id, title || ' feat. Someone (Official Video)|' || title || ' feat. Someone|' || title AS variants FROM songs", S)

add("u06_placeholders", lambda c: c.download_queue.select("queue_id", R.is_placeholder(F.when(F.col("status") == "failed", " Unknown ARTIST").when(F.col("attempts") == 3, F.col("queue_id").cast("string")).otherwise(F.col("artist"))).alias("placeholder")),
    "SELECT queue_id, status = 'failed' OR attempts = 3 OR artist IS NULL AS placeholder FROM download_queue", QUEUE)

_RELEASES = "SELECT o_custkey AS recording_id, o_orderkey AS release_id, CAST(o_orderkey % 97 AS DOUBLE) / 97 AS title_similarity, CASE o_orderstatus WHEN 'O' THEN 'Official' ELSE 'Bootleg' END AS status, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Album' WHEN '2' THEN 'EP' WHEN '3' THEN 'Single' END AS kind FROM orders"
add("u08_chosen_releases", lambda c: R.choose_release(c.spark.sql(_RELEASES.replace("FROM orders", "FROM {o}"), o=c._stored["orders"])).select("recording_id", "release_id", F.round("score", 6).alias("score")), f"""
WITH x AS (SELECT recording_id, release_id, 100 * title_similarity + CASE kind WHEN 'Album' THEN 5 WHEN 'EP' THEN 3 WHEN 'Single' THEN -2 ELSE 0 END + CASE WHEN status = 'Official' THEN 10 ELSE 0 END AS score FROM ({_RELEASES}))
SELECT recording_id, release_id, round(score, 6) AS score FROM x QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY score DESC, release_id) = 1""")

_HITS = "SELECT user_id AS key, CASE event_type WHEN 'click' THEN 'discogs' WHEN 'error' THEN 'musicbrainz' WHEN 'signup' THEN 'spotify' ELSE 'elsewhere' END AS source, CAST(floor(value / 10) AS INT) AS variant, CASE WHEN value > 5 THEN event_id END AS match FROM events"
add("u10_first_hits", lambda c: R.first_hit(c.spark.sql(_HITS.replace("FROM events", "FROM {e}"), e=c._stored["events"])), f"""
SELECT key, source, variant, match FROM ({_HITS}) WHERE match IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE source WHEN 'musicbrainz' THEN 1 WHEN 'spotify' THEN 2 WHEN 'discogs' THEN 3 ELSE 4 END, variant, match) = 1""")

_CANDIDATES = "SELECT user_id AS key, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS stage, CAST(event_id % 11 AS DOUBLE) / 10 AS confidence, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 7 AS DOUBLE) / 7 END AS artist_similarity, floor(value) AS score, event_id AS match FROM events"
add("u10_resolved", lambda c: R.resolve(c.spark.sql(_CANDIDATES.replace("FROM events", "FROM {e}"), e=c._stored["events"])).select("key", "stage", "match", F.round("value", 6).alias("value")), f"""
WITH x AS (SELECT *, score * confidence AS v FROM ({_CANDIDATES}) WHERE confidence >= 0.3 AND coalesce(artist_similarity >= 0.4, TRUE))
SELECT key, stage, match, round(v, 6) AS value FROM x QUALIFY row_number() OVER (PARTITION BY key ORDER BY stage, v DESC, match) = 1""")

_FEATURES = "SELECT user_id, event_type AS feature, value, CAST(event_id % 5 AS DOUBLE) / 5 AS confidence FROM events"
add("u12_merged_features", lambda c: U.merge_by_confidence(c.spark.sql(_FEATURES.replace("FROM events", "FROM {e}"), e=c._stored["events"]), "user_id"), f"""
SELECT user_id, feature, value, confidence FROM ({_FEATURES}) QUALIFY row_number() OVER (PARTITION BY user_id, feature ORDER BY confidence DESC, value) = 1""")

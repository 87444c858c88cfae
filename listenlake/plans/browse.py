"""Registered browsing and similarity queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from listenlake.catalog import oracle
from listenlake.operators import browse as B, neighbours as NN, similarity as V
from listenlake.plans.base import AS_OF, bind

QUERIES, ORACLE = {}, {}
S, SA, AR, G = "songs", "song_artists", "artists", "song_genres"


def add(name, f, sql=None, *tables):
    QUERIES[name] = bind(f)
    if sql:
        ORACLE[name] = oracle(sql, *tables)


_DETAIL = """pa AS (SELECT sha_id, arg_min(artist, artist_id) AS primary_name FROM primary_artist GROUP BY 1),
 ar AS (SELECT sha_id, string_agg(name, ', ' ORDER BY CASE role WHEN 'primary' THEN 0 ELSE 1 END, artist_id) AS artists FROM song_artists JOIN artists USING (artist_id) GROUP BY 1)
SELECT p.sha_id, title, album, coalesce(artists, '') AS artists, CASE WHEN album <> '' AND primary_name IS NOT NULL THEN md5(lower(album) || '::' || lower(primary_name)) END AS album_id, release_year, created_at
FROM p LEFT JOIN ar ON p.sha_id = ar.sha_id LEFT JOIN pa ON p.sha_id = pa.sha_id"""
add("b01_search", lambda c: B.search(c, q="1", genre="brand#2", limit=60), f"""
WITH p AS (SELECT * FROM songs s WHERE (title ILIKE '%1%' OR album ILIKE '%1%' OR EXISTS (SELECT 1 FROM song_artists sa JOIN artists a USING (artist_id) WHERE sa.sha_id = s.sha_id AND name ILIKE '%1%'))
 AND EXISTS (SELECT 1 FROM song_genres g WHERE g.sha_id = s.sha_id AND genre ILIKE '%brand#2%') ORDER BY title, sha_id LIMIT 60), {_DETAIL}""", S, SA, AR, G)
add("b01_search_artist", lambda c: B.search(c, artist_id=7), f"WITH p AS (SELECT * FROM songs WHERE sha_id IN (SELECT sha_id FROM song_artists WHERE artist_id = 7) ORDER BY title, sha_id LIMIT 50), {_DETAIL}", S, SA, AR)
add("b08_newest", lambda c: B.newest(c, 40, 10), f"WITH p AS (SELECT * FROM songs ORDER BY created_at DESC, sha_id LIMIT 40 OFFSET 10), {_DETAIL}", S, SA, AR)
add("b02_catalog_page", lambda c: B.catalog_page(c, "2", 30, 5), f"WITH p AS (SELECT * FROM songs s WHERE title ILIKE '%2%' OR album ILIKE '%2%' OR sha_id IN (SELECT sha_id FROM song_artists JOIN artists USING (artist_id) WHERE name ILIKE '%2%') ORDER BY created_at DESC, sha_id LIMIT 30 OFFSET 5), {_DETAIL}", S, SA, AR)
add("b05_popular_albums", B.popular_albums, """
WITH pa AS (SELECT sha_id, arg_min(artist, artist_id) AS n FROM primary_artist GROUP BY 1)
SELECT md5(lower(album) || '::' || lower(n)) AS album_id, min(album) AS album, max(n) AS artist, min(release_year) AS release_year, count(*) AS songs, CAST(sum(duration_sec) AS BIGINT) AS duration_sec FROM songs JOIN pa USING (sha_id) WHERE album <> '' GROUP BY 1 ORDER BY 5 DESC, 1 LIMIT 10""", S)
add("b06_artist_albums", lambda c: B.artist_albums(c, 3), "SELECT album, min(release_year) AS release_year, count(*) AS songs FROM songs JOIN primary_artist USING (sha_id) WHERE artist_id = 3 AND album <> '' GROUP BY 1", S)
add("b15_unverified", B.unverified, "WITH p AS (SELECT * FROM songs WHERE NOT verified ORDER BY created_at, sha_id LIMIT 100) SELECT sha_id, title, (SELECT string_agg(DISTINCT name, ', ' ORDER BY name) FROM song_artists sa JOIN artists USING (artist_id) WHERE sa.sha_id = p.sha_id) AS artists, album FROM p", S, SA, AR)
add("b03_artists", B.artists, """
SELECT a.artist_id, name, count(DISTINCT s.sha_id) AS song_count, count(DISTINCT CASE WHEN album <> '' THEN album END) AS album_count FROM artists a LEFT JOIN song_artists sa ON a.artist_id = sa.artist_id LEFT JOIN songs s ON s.sha_id = sa.sha_id GROUP BY 1, 2""", S, SA, AR)
add("b04_albums", B.albums, """
WITH pa AS (SELECT sha_id, arg_min(artist, artist_id) AS n FROM primary_artist GROUP BY 1)
SELECT md5(lower(album) || '::' || lower(n)) AS album_id, min(album) AS album, max(n) AS artist, min(release_year) AS release_year, count(*) AS songs, CAST(sum(duration_sec) AS BIGINT) AS duration_sec FROM songs JOIN pa USING (sha_id) WHERE album <> '' GROUP BY 1""", S)
add("b05_popular_artists", B.popular_artists, "SELECT artist_id, name, count(DISTINCT sha_id) AS songs FROM song_artists JOIN artists USING (artist_id) GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10", SA, AR)
add("b06_artist_songs", lambda c: B.artist_songs(c, 3), "SELECT sha_id, title, album, release_year, track_number FROM songs WHERE sha_id IN (SELECT sha_id FROM song_artists WHERE artist_id = 3)", S, SA)
add("b09_unlinked", B.unlinked, """
WITH p AS (SELECT * FROM songs WHERE album IS NULL OR album = '' OR sha_id NOT IN (SELECT sha_id FROM song_artists) ORDER BY created_at DESC, sha_id LIMIT 50),
 n AS (SELECT sha_id, coalesce(max(name) FILTER (role = 'primary'), max(name)) AS artist FROM song_artists JOIN artists USING (artist_id) GROUP BY 1) SELECT p.sha_id, title, artist, album FROM p LEFT JOIN n ON p.sha_id = n.sha_id""", S, SA, AR)
add("b09_unlinked_count", B.unlinked_count, "SELECT count(*) AS songs FROM songs WHERE album IS NULL OR album = '' OR sha_id NOT IN (SELECT sha_id FROM song_artists)", S, SA)
add("b10_song_detail", lambda c: B.song_detail(c, "12"), """
SELECT sha_id, title, album, (SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM song_artists JOIN artists USING (artist_id) WHERE sha_id = '12') AS artists, (SELECT string_agg(DISTINCT genre, ',' ORDER BY genre) FROM song_genres WHERE sha_id = '12') AS genres FROM songs WHERE sha_id = '12'""", S, SA, AR, G)
add("b11_genres", B.genres, "SELECT genre, count(DISTINCT sha_id) AS songs FROM song_genres GROUP BY 1", G)
add("b12_queue_by_status", B.queue_by_status, "SELECT status, count(*) AS n FROM download_queue GROUP BY 1", "download_queue")
add("b13_queue", lambda c: B.queue(c, ["pending", "failed"]), "SELECT * FROM download_queue WHERE status IN ('pending', 'failed') ORDER BY created_at DESC, queue_id LIMIT 100", "download_queue")
add("b14_feature_status", B.feature_status, """
SELECT count(*) AS total, count(*) FILTER (a.sha_id IS NOT NULL AND error_message IS NULL) AS analysed, count(error_message) AS failed, count(*) FILTER (a.sha_id IS NULL) AS pending, round(avg(analysis_duration_ms) FILTER (error_message IS NULL), 2) AS avg_ms FROM songs s LEFT JOIN audio_features a ON s.sha_id = a.sha_id""", S, "audio_features")
add("b14_pending_features", B.pending_features, "SELECT sha_id, title FROM songs WHERE sha_id NOT IN (SELECT sha_id FROM audio_features)", S, "audio_features")

_SEED = "seed AS (SELECT CAST(vector AS DOUBLE[]) AS q FROM vectors WHERE sha_id = '5'), own AS (SELECT sha_id, CAST(vector AS DOUBLE[]) AS v FROM vectors WHERE sha_id IN (SELECT sha_id FROM songs) AND sha_id <> '5')"
for _m, _f in (("cosine", "list_cosine_similarity(v, q)"), ("euclidean", "1 / (1 + list_distance(v, q))"), ("dot", "1 / (1 + abs(list_dot_product(v, q)))")):
    add(f"v01_similar_{_m}", lambda c, m=_m: V.similar_songs(c, "5", 20, m), f"WITH {_SEED} SELECT sha_id, round({_f}, 6) AS score FROM own, seed ORDER BY {_f} DESC, sha_id LIMIT 20", S, "vectors")
add("v02_pairwise", lambda c: c.vectors.join(c.vectors.where("sha_id = '5'").select(F.col("vector").alias("q")), F.lit(True)).select("sha_id", *[F.round(V.pairwise(m, "vector", "q"), 5).alias(m) for m in V.METRICS]), """
WITH s AS (SELECT CAST(vector AS DOUBLE[]) AS q FROM vectors WHERE sha_id = '5') SELECT sha_id, round((list_cosine_similarity(CAST(vector AS DOUBLE[]), q) + 1) / 2, 5) AS cosine, round(1 - least(list_distance(CAST(vector AS DOUBLE[]), q) / 2, 1), 5) AS euclidean, round(greatest(0, list_dot_product(CAST(vector AS DOUBLE[]), q)), 5) AS dot FROM vectors, s""", "vectors")
add("v03_song_radio", lambda c: V.song_radio(c, "5", 20))
add("v05_artist_radio", lambda c: V.artist_radio(c, 3, 20))
add("v06_preferences", lambda c: V.preference_playlist(c, c.songs.where("sha_id IN ('1', '2', '3')").select("sha_id", F.lit(1.0).alias("weight")), c.songs.where("sha_id IN ('9')").select("sha_id", F.lit(1.0).alias("weight")), 20))
add("v07_for_you", lambda c: V.for_you(c, c.songs.where("sha_id IN ('1', '2', '3')"), c.songs.where("sha_id = '9'"), AS_OF, 20))


def _neighbours(c, metric, recall=None):
    """The ten nearest songs of every song."""
    own = V.with_songs(c)
    return NN.neighbours(own, own, 10, metric, recall).withColumn("score", F.round("score", 6))


_ALL = "own AS (SELECT sha_id, CAST(vector AS DOUBLE[]) AS v FROM vectors WHERE sha_id IN (SELECT sha_id FROM songs))"
_PAIRS = "SELECT a.sha_id AS query, b.sha_id, {f} AS s FROM own a JOIN own b ON a.sha_id <> b.sha_id"
for _m, _f in (("cosine", "list_cosine_similarity(a.v, b.v)"), ("euclidean", "1 / (1 + list_distance(a.v, b.v))"), ("dot", "1 / (1 + abs(list_dot_product(a.v, b.v)))")):
    add(f"v01_neighbours_{_m}", lambda c, m=_m: _neighbours(c, m), f"""
WITH {_ALL}, pair AS ({_PAIRS.format(f=_f)}), placed AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, sha_id) AS INT) AS rank, sha_id, round(s, 6) AS score FROM pair)
SELECT * FROM placed WHERE rank <= 10""", S, "vectors")
add("v01_neighbours_indexed", lambda c: _neighbours(c, "cosine", 0.95))


def _stored(c):
    """Stored albums: those of even years, with a track that the library lacks."""
    own = B.albums(c).where("release_year % 2 = 0")
    return own.select("album_id", F.col("album").alias("title"), F.col("artist").alias("artist_name"), "release_year", (F.col("songs") + 1).alias("track_count"), F.col("duration_sec").alias("total_duration_sec"))


_STORED = """pa AS (SELECT sha_id, arg_min(artist, artist_id) AS n FROM primary_artist GROUP BY 1),
 own AS (SELECT md5(lower(album) || '::' || lower(n)) AS album_id, min(album) AS title, max(n) AS artist_name, min(release_year) AS release_year, count(*) AS track_count, CAST(sum(duration_sec) AS BIGINT) AS total_duration_sec
  FROM songs JOIN pa USING (sha_id) WHERE album <> '' GROUP BY 1),
 stored AS (SELECT * REPLACE (track_count + 1 AS track_count) FROM own WHERE release_year % 2 = 0)"""
add("b04_stored_albums", lambda c: B.stored_albums(c, _stored(c)), f"""
WITH {_STORED}, k AS (SELECT md5(lower(album) || '::' || lower(coalesce(artist, ''))) AS album_id, count(*) AS song_count FROM songs s LEFT JOIN primary_artist a ON s.sha_id = a.sha_id WHERE album <> '' GROUP BY 1)
SELECT stored.*, coalesce(song_count, 0) AS song_count FROM stored LEFT JOIN k USING (album_id) ORDER BY release_year DESC NULLS LAST, title, album_id LIMIT 50""", S)
add("b07_album_headers", lambda c: B.album_headers(c, _stored(c)), f"WITH {_STORED} SELECT * FROM stored UNION ALL SELECT * FROM own WHERE album_id NOT IN (SELECT album_id FROM stored)", S)
#: Labels are brands and producers are types of the parts that songs are made of.
add("b10_song_details", lambda c: B.song_details(c, *[c._stored["part"].select(F.col("p_partkey").cast("string").alias("sha_id"), F.col(x).alias("name")) for x in ("p_brand", "p_type")]), """
SELECT s.sha_id, title, album, duration_sec, release_year, track_number, verified, verification_source,
  coalesce((SELECT string_agg(name, ',' ORDER BY role <> 'primary', artist_id) FROM song_artists sa JOIN artists USING (artist_id) WHERE sa.sha_id = s.sha_id), '') AS artists,
  coalesce((SELECT string_agg(DISTINCT genre, ',' ORDER BY genre) FROM song_genres g WHERE g.sha_id = s.sha_id), '') AS genres, p_brand AS labels, p_type AS producers,
  (SELECT count(*) FROM song_files f WHERE f.sha_id = s.sha_id) AS files, CAST(coalesce((SELECT sum(file_size) FROM song_files f WHERE f.sha_id = s.sha_id), 0) AS BIGINT) AS bytes
FROM songs s JOIN part ON CAST(p_partkey AS STRING) = s.sha_id""", S, SA, AR, G, "song_files")
add("b14_failed_features", B.failed_features, "SELECT sha_id, title, error_message FROM audio_features JOIN songs USING (sha_id) WHERE error_message IS NOT NULL", S, "audio_features")

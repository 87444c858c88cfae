"""Registered queries of stored playlists and of what browsing adds to them, with their SQL twins."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from listenlake.catalog import TESTDATA, Catalog, oracle
from listenlake.operators import browse as B, playlists as P, rules as R
from listenlake.plans.base import AS_OF, bind
from listenlake.plans.rules import compiler
from listenlake.streaming import playback

QUERIES, ORACLE = {}, {}

#: Stored playlists made from suppliers, in SQL that both engines read alike.
_PLAYLISTS = """SELECT CAST(s_suppkey AS STRING) AS playlist_id, s_name AS name, s_suppkey % 4 = 0 AS is_template,
  CASE s_suppkey % 3 WHEN 0 THEN 'time' WHEN 1 THEN 'discovery' END AS category, CAST(DATE '2024-01-01' + CAST(s_nationkey AS INT) AS TIMESTAMP) AS updated_at FROM supplier"""
_PROFILES = """SELECT s_name AS artist_name, '{"artist":{"id":"mb-' || CAST(s_suppkey * 7 AS STRING) || '"}}' AS profile_json FROM supplier WHERE s_suppkey % 3 <> 0"""
_FOUND = "s.sha_id IN (SELECT sha_id FROM song_artists WHERE artist_id = 7)"


def add(name, f, sql):
    QUERIES[name], ORACLE[name] = bind(f), sql


def _stored(c, sql, table="supplier"):
    text = sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {table}", "FROM {t}")
    return c.spark.sql(text, t=c._stored[table])


add("r49_playlists", lambda c: P.listed(_stored(c, _PLAYLISTS)).limit(20).select("playlist_id", "name", "is_template", "updated_at"), f"SELECT playlist_id, name, is_template, updated_at FROM ({_PLAYLISTS}) ORDER BY is_template, updated_at DESC, playlist_id LIMIT 20")
add("r49_templates", lambda c: P.templates(_stored(c, _PLAYLISTS), "time").limit(10).select("playlist_id", "name"), f"SELECT playlist_id, name FROM ({_PLAYLISTS}) WHERE is_template AND category = 'time' ORDER BY name, playlist_id LIMIT 10")
add("r49_categories", lambda c: P.categories(_stored(c, _PLAYLISTS)), f"SELECT DISTINCT category FROM ({_PLAYLISTS}) WHERE is_template AND category IS NOT NULL")


def _saved(c):
    stored = _stored(c, _PLAYLISTS)
    new = stored.where("playlist_id IN ('3', '4', '5')").select("playlist_id", F.concat("name", F.lit(" (new)")).alias("name"), F.lit(None).cast("string").alias("category"))
    return P.save(stored, new.union(c.spark.createDataFrame([("x1", "Own", "time")], new.schema))).select("playlist_id", "name", "category")


add("r49_saved", _saved, f"""SELECT playlist_id, CASE WHEN playlist_id IN ('3', '5') THEN name || ' (new)' ELSE name END AS name, category FROM ({_PLAYLISTS}) UNION ALL SELECT 'x1', 'Own', 'time'""")


def _detail(c):
    members = compiler(c).playlist(R.parse(R.TEMPLATES["Short Songs"][0]), "duration_sec", "asc", 60).select(F.lit("p").alias("playlist_id"), "position", "sha_id")
    return P.detail(c, members, "p")


add("r48_detail", _detail, oracle("""
WITH m AS (SELECT CAST(row_number() OVER (ORDER BY duration_sec, sha_id) - 1 AS INT) AS position, * FROM songs WHERE duration_sec < 180 ORDER BY duration_sec, sha_id LIMIT 60),
 ar AS (SELECT sha_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS artists FROM song_artists JOIN artists USING (artist_id) GROUP BY 1), pa AS (SELECT sha_id, arg_min(artist, artist_id) AS p FROM primary_artist GROUP BY 1)
SELECT position, m.sha_id, title, artists, album, CASE WHEN album <> '' AND p IS NOT NULL THEN md5(lower(album) || '::' || lower(p)) END AS album_id, duration_sec FROM m LEFT JOIN ar ON ar.sha_id = m.sha_id LEFT JOIN pa ON pa.sha_id = m.sha_id""", "songs", "song_artists", "artists"))


def _converted(c):
    rule = P.convert(c, c.songs.where("album = 'Brand#11'"), AS_OF)
    part = (rule or {"conditions": [{}]})["conditions"][0]
    return c.spark.createDataFrame([(part.get("field"), part.get("operator"), json.dumps(part.get("value")))], "field string, operator string, value string")


add("r47_converted", _converted, oracle("""
WITH s AS (SELECT * FROM songs WHERE album = 'Brand#11'), t AS (SELECT count(*) AS t FROM s), r AS (SELECT count(*) AS n FROM s WHERE created_at >= TIMESTAMP '2024-01-01'),
 a AS (SELECT name AS v, count(DISTINCT sha_id) AS n FROM s JOIN song_artists USING (sha_id) JOIN artists USING (artist_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
 g AS (SELECT genre AS v, count(DISTINCT sha_id) AS n FROM s JOIN song_genres USING (sha_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
 x AS (SELECT 'artist' AS field, 'equals' AS operator, '"' || v || '"' AS value, n / t AS score FROM a, t WHERE n >= 0.6 * t UNION ALL SELECT 'genre', 'equals', '"' || v || '"', n / t FROM g, t WHERE n >= 0.6 * t
  UNION ALL SELECT 'release_year', 'between', '[' || min(release_year) || ', ' || max(release_year) || ']', 0.4 FROM s HAVING max(release_year) - min(release_year) <= 10
  UNION ALL SELECT 'added_at', 'within_days', '30', n / t FROM r, t WHERE n >= 5 AND n >= 0.2 * t)
SELECT max(field) AS field, max(operator) AS operator, coalesce(max(value), 'null') AS value FROM (SELECT * FROM x ORDER BY score DESC, field LIMIT 1)""", "songs", "song_artists", "artists", "song_genres"))

add("b01_search_total", lambda c: B.search_total(c, q="1", genre="brand#2"), oracle("""
SELECT count(*) AS total FROM songs s WHERE (title ILIKE '%1%' OR album ILIKE '%1%' OR EXISTS (SELECT 1 FROM song_artists sa JOIN artists a USING (artist_id) WHERE sa.sha_id = s.sha_id AND name ILIKE '%1%'))
 AND EXISTS (SELECT 1 FROM song_genres g WHERE g.sha_id = s.sha_id AND genre ILIKE '%brand#2%')""", "songs", "song_artists", "artists", "song_genres"))


def _albums(c):
    """Songs found by the id of the album of the song '8' (or of '22', if that has none)."""
    named = c.songs.where("album <> '' AND sha_id IN ('8', '22')").join(B.first_primary(c), "sha_id").select(B.X.album_id("album", "primary_artist").alias("i"), "sha_id")
    row = named.orderBy("sha_id").first()
    return B.search(c, album_id=row[0] if row else "none").select("sha_id", "title", "album_id")


add("b01_search_album", _albums, oracle("""
WITH pa AS (SELECT sha_id, arg_min(artist, artist_id) AS p FROM primary_artist GROUP BY 1), x AS (SELECT songs.*, md5(lower(album) || '::' || lower(p)) AS album_id FROM songs JOIN pa ON pa.sha_id = songs.sha_id WHERE album <> '')
SELECT sha_id, title, album_id FROM x WHERE album_id = (SELECT album_id FROM x WHERE sha_id IN ('8', '22') ORDER BY sha_id LIMIT 1) ORDER BY title, sha_id LIMIT 50""", "songs", "song_artists", "artists"))
add("b12_library_counts", B.library_counts, oracle("""
SELECT (SELECT count(*) FROM songs) AS songs, (SELECT count(DISTINCT artist_id) FROM song_artists) AS artists, (SELECT count(DISTINCT album) FROM songs WHERE album <> '') AS albums, (SELECT count(DISTINCT genre) FROM song_genres) AS genres,
 (SELECT count(DISTINCT sha_id) FROM song_files) AS with_files, (SELECT count(DISTINCT sha_id) FROM vectors) AS with_vectors""", "songs", "song_artists", "song_genres", "song_files", "vectors"))


def _images(c):
    n = F.col("sha_id").cast("int")
    songs = c.songs.withColumns({"release_id": F.when(n % 3 == 0, F.concat(F.lit("r"), "sha_id")), "updated_at": F.col("created_at")})
    return B.image_candidates(Catalog(c.spark, tables={"songs": songs}, stored=c._stored, binding=TESTDATA), 80)


add("b15_image_candidates", _images, oracle("""
WITH pa AS (SELECT sha_id, arg_min(artist, artist_id) AS p FROM primary_artist GROUP BY 1)
SELECT s.sha_id, title, album, CASE WHEN CAST(s.sha_id AS INT) % 3 = 0 THEN 'r' || s.sha_id END AS release_id, p AS artist FROM songs s LEFT JOIN pa ON pa.sha_id = s.sha_id WHERE verified
ORDER BY CASE WHEN CAST(s.sha_id AS INT) % 3 = 0 THEN 0 ELSE 1 END, created_at, s.sha_id LIMIT 80""", "songs", "song_artists", "artists"))
add("j17_artist_profiles", lambda c: B.artist_profiles(c, _stored(c, _PROFILES)), "SELECT s_suppkey AS artist_id, s_name AS name, CASE WHEN s_suppkey % 3 <> 0 THEN 'mb-' || (s_suppkey * 7) END AS external_id FROM supplier")
add("t11_event_types", lambda c: playback.of_types(c.play_events, ["click", "view"]).select("event_id", "event_type"), oracle("SELECT event_id, event_type FROM play_events WHERE event_type IN ('click', 'view')", "play_events"))

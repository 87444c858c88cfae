"""Tables by name, lazily built from a binding of native names to stored tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

NATIVE = ("songs", "artists", "song_artists", "song_genres", "song_files", "albums", "play_sessions", "audio_features", "vectors", "download_queue", "play_events")

#: The driver's tables bound to native names, in SQL that Spark and DuckDB read alike.
TESTDATA = {
    "songs": """SELECT CAST(p_partkey AS STRING) AS sha_id, p_name AS title,
         CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 10 = 1 THEN '' ELSE p_brand END AS album,
         CAST(60 + p_size * 10 AS INT) AS duration_sec,
         CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(1960 + p_size AS INT) END AS release_year,
         CAST(p_partkey % 15 + 1 AS INT) AS track_number, p_partkey % 2 = 0 AS verified,
         CASE WHEN p_partkey % 2 = 0 THEN 'musicbrainz' END AS verification_source,
         CAST(DATE '2023-12-15' + CAST(p_partkey % 45 AS INT) AS TIMESTAMP) AS created_at FROM part""",
    "artists": "SELECT s_suppkey AS artist_id, s_name AS name FROM supplier",
    "song_artists": """SELECT CAST(p_partkey AS STRING) AS sha_id, p_partkey % (SELECT count(*) FROM supplier) AS artist_id, 'primary' AS role
         FROM part WHERE p_partkey % 23 <> 0
         UNION ALL SELECT CAST(p_partkey AS STRING), (p_partkey * 7 + 1) % (SELECT count(*) FROM supplier), 'featured' FROM part WHERE p_partkey % 3 = 0""",
    "song_genres": """SELECT CAST(p_partkey AS STRING) AS sha_id, p_type AS genre FROM part
         UNION ALL SELECT CAST(p_partkey AS STRING), p_brand FROM part WHERE p_partkey % 4 = 0""",
    "song_files": """SELECT CAST(p_partkey AS STRING) AS sha_id, CAST(p_size * 100000 AS BIGINT) AS file_size,
         CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'upload' ELSE 'download' END AS ingestion_source FROM part""",
    "play_sessions": """SELECT CAST(event_id AS STRING) AS session_id,
         CAST((user_id * user_id + event_id % 11) % (SELECT count(*) FROM part) AS STRING) AS sha_id, user_id, ts AS started_at,
         CASE WHEN event_type = 'signup' THEN NULL ELSE ts + INTERVAL '1' SECOND * CAST(floor(value) AS INT) END AS ended_at,
         CAST(floor(value * 1000) AS INT) AS duration_played_ms, CAST(least(value, 100.0) AS DOUBLE) AS completion_percent,
         value >= 80 AS completed, value < 30 AND event_type = 'click' AS skipped,
         CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS context_type FROM events""",
    "audio_features": """SELECT CAST(p_partkey AS STRING) AS sha_id, CAST(60 + (p_partkey * 31) % 121 AS DOUBLE) AS bpm,
         CAST((p_partkey * 37) % 101 AS DOUBLE) AS energy, CAST(p_size * 2 AS DOUBLE) AS danceability,
         CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST((p_partkey * 53) % 101 AS DOUBLE) END AS acousticness,
         CAST((p_partkey * 17) % 101 AS DOUBLE) AS instrumentalness, CAST((p_partkey * 71) % 101 AS DOUBLE) AS speechiness,
         CAST(p_partkey % 12 AS INT) AS pitch_class, CASE WHEN p_partkey % 2 = 0 THEN 'major' ELSE 'minor' END AS key_mode,
         p_type AS mood_primary, CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS mood_secondary,
         CAST(p_partkey % 700 AS INT) AS analysis_duration_ms,
         CASE WHEN p_partkey % 50 = 0 THEN 'decode failed' END AS error_message FROM part WHERE p_partkey % 9 <> 0""",
    "play_events": """SELECT CAST(event_id AS STRING) AS event_id, CAST(user_id AS STRING) AS session_id, event_type, CAST(floor(value * 1000) AS INT) AS position_ms,
         ts AS timestamp FROM events WHERE event_id % 3 <> 0""",
    "vectors": "SELECT CAST(vec_id AS STRING) AS sha_id, embedding AS vector FROM embeddings",
    "download_queue": """SELECT o_orderkey AS queue_id, 'Song ' || CAST(o_custkey AS STRING) AS title,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Artist ' || CAST(o_custkey % 40 AS STRING) END AS artist,
         CASE o_orderstatus WHEN 'F' THEN 'pending' WHEN 'O' THEN 'downloaded' ELSE 'failed' END AS status,
         CAST(o_orderkey % 4 AS INT) AS attempts, o_orderdate AS created_at FROM orders""",
}
#: Names of the pitch classes, and the stored tables that the testdata binding reads.
PITCHES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
_STORED = ("part", "supplier", "events", "embeddings", "orders")


class Catalog:
    """Native tables of one library: ``catalog.songs``, ``catalog.play_sessions`` and so on, as DataFrames."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, stored: dict[str, DataFrame] | None = None, binding: dict[str, str] | None = None, root: str = ""):
        self.spark, self._tables, self._stored, self._binding, self._root = spark, dict(tables or {}), stored or {}, binding or {}, root

    @classmethod
    def native(cls, spark: SparkSession, root: str) -> Catalog:
        """Parquet tables with native names and schemas below ``root``."""
        return cls(spark, root=root)

    @classmethod
    def testdata(cls, spark: SparkSession, sf_dir: str) -> Catalog:
        return cls(spark, stored={t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _STORED}, binding=TESTDATA)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NATIVE:
            raise AttributeError(name)
        if name not in self._tables:
            if name in self._binding:
                text = self._binding[name]
                used = {t: df for t, df in self._stored.items() if f"FROM {t}" in text}
                for t in used:
                    text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
                self._tables[name] = self.spark.sql(text, **used)
            else:
                self._tables[name] = self.spark.read.parquet(f"{self._root}/{name}.parquet")
        return self._tables[name]

    @functools.cached_property
    def primary(self) -> DataFrame:
        """(sha_id, artist_id, artist) of primary artists; a song with two gives two rows."""
        return self.song_artists.where("role = 'primary'").join(self.artists, "artist_id").select("sha_id", "artist_id", F.col("name").alias("artist"))

    def with_primary(self, df: DataFrame) -> DataFrame:
        """``df`` with artist_id and artist of its songs' primary artists, one row for each; unknown ones are named so."""
        return df.join(self.primary, "sha_id", "left").withColumn("artist", F.coalesce("artist", F.lit("Unknown Artist")))


def oracle(body: str, *tables: str) -> str:
    """DuckDB SQL: the bindings of ``tables`` as common tables before a SELECT (or further common tables)."""
    names = list(tables) + (["artists"] if "primary_artist" in body and "artists" not in tables else [])
    names += ["song_artists"] if "primary_artist" in body and "song_artists" not in names else []
    ctes = [f"{t} AS ({TESTDATA[t]})" for t in dict.fromkeys(names)]
    if "primary_artist" in body:
        ctes.append("primary_artist AS (SELECT sha_id, a.artist_id, a.name AS artist FROM song_artists sa JOIN artists a ON sa.artist_id = a.artist_id WHERE role = 'primary')")
    body = body.strip()
    return "WITH " + ",\n".join(ctes) + (",\n" + body[5:] if body[:5].upper() == "WITH " else "\n" + body)

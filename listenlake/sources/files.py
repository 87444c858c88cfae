"""Readers and writers of files."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_source_items(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (title, artist, album, genre, search_query, source_url); a line without a title fails the read."""
    schema = "title string, artist string, album string, genre string, search_query string, source_url string"
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.withColumn("title", F.when(F.trim("title") != "", F.col("title")).otherwise(F.raise_error(F.lit("a source item needs a title")).cast("string")))


def append_source_items(items: DataFrame, path: str) -> None:
    items.write.mode("append").json(path)


def read_hotlist(spark: SparkSession, path: str) -> DataFrame:
    """Songs of a JSON list (or one under songs, items, tracks or data) or a CSV with a header; fields have fallbacks."""
    if path.endswith(".csv"):
        raw = spark.read.option("header", True).csv(path)
        col = lambda *names: F.coalesce(*[F.col(n) for n in names if n in raw.columns], F.lit(None).cast("string"))
    else:
        text = spark.read.text(path, wholetext=True)
        item = "array<map<string,string>>"
        listed = F.coalesce(*[F.from_json(F.get_json_object("value", f"$.{k}"), item) for k in ("songs", "items", "tracks", "data")], F.from_json("value", item))
        raw = text.select(F.explode(listed).alias("m"))
        col = lambda *names: F.coalesce(*[F.col("m")[n] for n in names])
    artists = col("artists")
    first = F.coalesce(F.from_json(artists, "array<string>")[0], artists)
    out = raw.select(col("title", "name").alias("title"), F.coalesce(col("artist"), first).alias("artist"), col("album", "release").alias("album"), col("source_url", "url").alias("source_url"))
    return out.where(F.trim("title") != "")


def release_year(tag: str) -> Column:
    """First four-digit number of a date tag."""
    return F.regexp_extract(tag, r"(\d{4})", 1).try_cast("int")


def track_number(tag: str) -> Column:
    """n of a track tag 'n' or 'n/m'."""
    return F.regexp_extract(tag, r"^\s*(\d+)", 1).try_cast("int")


def segments(vectors: DataFrame, hop: float = 0.48, frame: float = 0.96) -> DataFrame:
    """One row a frame of (sha_id, frames: array of vectors), with its start and end in seconds."""
    rows = vectors.select("sha_id", F.posexplode("frames").alias("i", "vector"))
    return rows.select("sha_id", "vector", F.round(F.col("i") * hop, 6).alias("segment_start_sec"), F.round(F.col("i") * hop + frame, 6).alias("segment_end_sec"))


def export(df: DataFrame, path: str, kind: str = "csv", limit: int = 100_000, order: list | None = None) -> None:
    """The first ``limit`` rows in an order (that of all columns, if none is given) as CSV with a header or as JSON lines, times in ISO form."""
    out = df.orderBy(*(order or df.columns)).limit(limit)
    writer = out.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def store_assets(known: DataFrame, blobs: DataFrame) -> DataFrame:
    """Binary assets by content: ``known`` (sha256, content) with the new contents of ``blobs`` (content)."""
    new = blobs.select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"]).join(known, "sha256", "left_anti")
    return known.select("sha256", "content").union(new)


def share_token(playlist: dict) -> str:
    """A playlist as URL-safe text without padding."""
    return base64.urlsafe_b64encode(json.dumps(playlist, sort_keys=True, separators=(",", ":")).encode()).decode().rstrip("=")


def from_share_token(token: str) -> dict:
    return json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))

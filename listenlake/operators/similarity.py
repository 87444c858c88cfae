"""Vector similarity, radio and recommendations."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from listenlake.catalog import Catalog
from listenlake.functions import exprs as X
from listenlake.functions.period import within
from listenlake.operators.browse import first_primary

METRICS = ("cosine", "euclidean", "dot")
ALBUM_CAP, ARTIST_CAP, OVERFETCH = 3, 5, 3


def song_vectors(vectors: DataFrame) -> DataFrame:
    """One vector a song: its whole-song one (segment 0 to -1) where there is one, else the mean of its segments."""
    if "segment_end_sec" not in vectors.columns:
        return vectors.select("sha_id", F.col("vector").cast("array<double>").alias("vector"))
    whole = F.col("segment_end_sec") == -1
    parts = vectors.select("sha_id", whole.alias("w"), F.posexplode(F.col("vector").cast("array<double>")).alias("i", "x"))
    mean = parts.groupBy("sha_id", "i").agg(F.coalesce(F.avg(F.when(F.col("w"), F.col("x"))), F.avg("x")).alias("x"))
    return mean.groupBy("sha_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


def score(metric: str, query: np.ndarray):
    """An Arrow UDF from vectors to similarity with one query: 1 - cosine distance, 1 / (1 + distance), or 1 / (1 + |dot|)."""
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is not one of {METRICS}")
    q = np.asarray(query, np.float64)

    @F.pandas_udf("double")
    def run(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in vectors:
            v = np.stack(s.to_numpy()).astype(np.float64) if len(s) else np.zeros((0, len(q)))
            if metric == "cosine":
                norm = np.linalg.norm(v, axis=1) * np.linalg.norm(q)
                yield pd.Series(np.where(norm > 0, v @ q / np.where(norm > 0, norm, 1), 0.0))
            elif metric == "euclidean":
                yield pd.Series(1 / (1 + np.linalg.norm(v - q, axis=1)))
            else:
                yield pd.Series(1 / (1 + np.abs(v @ q)))

    return run


def pairwise(metric: str, x: str, y: str) -> Column:
    """Similarity of two vector columns in 0..1: (cosine + 1) / 2, 1 - distance / 2, or the dot product, each cut at 0."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    if metric == "cosine":
        norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
        return F.when(norm == 0, 0.0).otherwise((dot(x, y) / F.nullif(norm, F.lit(0.0)) + 1) / 2)
    if metric == "euclidean":
        return 1 - F.least(F.sqrt(dot(x, x) + dot(y, y) - 2 * dot(x, y)) / 2, F.lit(1.0))
    if metric == "dot":
        return F.greatest(F.lit(0.0), dot(x, y))
    raise ValueError(f"metric {metric!r} is not one of {METRICS}")


def nearest(vectors: DataFrame, query: np.ndarray, k: int, metric: str = "cosine", exclude: DataFrame | None = None) -> DataFrame:
    """The k most similar songs (sha_id, score): one scan, a score per batch, a top-k; nothing is shuffled whole."""
    rows = vectors if exclude is None else vectors.join(exclude.select("sha_id").distinct(), "sha_id", "left_anti")
    return rows.select("sha_id", score(metric, query)(F.col("vector")).alias("score")).orderBy(F.desc("score"), "sha_id").limit(k)


def centroid(vectors: DataFrame, weights: DataFrame) -> np.ndarray | None:
    """Weighted mean vector of songs (sha_id, weight), a song counting as often as it comes; None without vectors."""
    held = vectors.join(weights, "sha_id").select("weight", F.posexplode("vector").alias("i", "x"))
    mean = held.groupBy("i").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("x")).orderBy("i").collect()  # as many rows as dimensions
    return np.array([r.x for r in mean]) if mean else None


def diversify(candidates: DataFrame, limit: int, album_cap: int = ALBUM_CAP, artist_cap: int = ARTIST_CAP) -> DataFrame:
    """Greedy choice in order of score: at most album_cap of an album and artist_cap of an artist per ``seed``; unknown ones are free.

    Candidates (seed, sha_id, score, album_id, artist) are a bounded over-fetch per seed, so a group is small.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        albums, artists, keep = {}, {}, []
        for r in pdf.sort_values(["score", "sha_id"], ascending=[False, True]).itertuples():
            a, b = r.album_id, r.artist
            if len(keep) == limit:
                break
            if (a is not None and albums.get(a, 0) >= album_cap) or (b is not None and artists.get(b, 0) >= artist_cap):
                continue
            albums[a], artists[b] = albums.get(a, 0) + 1, artists.get(b, 0) + 1
            keep.append(r.Index)
        out = pdf.loc[keep].copy()
        out["position"] = range(len(keep))
        return out[["seed", "position", "sha_id", "score", "album_id", "artist"]]

    return candidates.select("seed", "sha_id", "score", "album_id", "artist").groupBy("seed").applyInPandas(pick, "seed string, position int, sha_id string, score double, album_id string, artist string")


def _named(cat: Catalog, found: DataFrame, seed: str) -> DataFrame:
    own = found.join(cat.songs.select("sha_id", "album"), "sha_id").join(first_primary(cat), "sha_id", "left")
    return own.select(F.lit(seed).alias("seed"), "sha_id", "score", X.album_id("album", "primary_artist").alias("album_id"), F.col("primary_artist").alias("artist"))


def _ids(cat: Catalog, ids: list[str]) -> DataFrame:
    return cat.spark.createDataFrame([(i,) for i in ids], "sha_id string")


def with_songs(cat: Catalog) -> DataFrame:
    """(sha_id, vector) of the songs that have vectors."""
    return song_vectors(cat.vectors).join(cat.songs.select("sha_id"), "sha_id", "left_semi")


def song_radio(cat: Catalog, sha_id: str, limit: int = 20, metric: str = "cosine") -> DataFrame:
    """Songs like a song, most similar first, with diversity limits."""
    vectors = with_songs(cat)
    seed = vectors.where(F.col("sha_id") == sha_id).select("vector").first()
    if seed is None:
        raise LookupError(f"song {sha_id} has no vector")
    found = nearest(vectors, np.array(seed[0]), OVERFETCH * limit, metric, _ids(cat, [sha_id]))
    return diversify(_named(cat, found, sha_id), limit)


def similar_songs(cat: Catalog, sha_id: str, limit: int = 10, metric: str = "cosine") -> DataFrame:
    """Songs like a song, without diversity limits."""
    vectors = with_songs(cat)
    seed = vectors.where(F.col("sha_id") == sha_id).select("vector").first()
    if seed is None:
        raise LookupError(f"song {sha_id} has no vector")
    return nearest(vectors, np.array(seed[0]), limit, metric, _ids(cat, [sha_id])).select("sha_id", F.round("score", 6).alias("score"))


def artist_radio(cat: Catalog, artist_id: int, limit: int = 20, metric: str = "cosine") -> DataFrame:
    """Songs like an artist's mean vector, without the artist's own."""
    own = cat.song_artists.where(F.col("artist_id") == artist_id).select("sha_id").distinct()
    vectors = with_songs(cat)
    q = centroid(vectors, own.withColumn("weight", F.lit(1.0)))
    if q is None:
        raise LookupError(f"artist {artist_id} has no vectors")
    return diversify(_named(cat, nearest(vectors, q, OVERFETCH * limit, metric, own), f"artist {artist_id}"), limit)


def preference_playlist(cat: Catalog, liked: DataFrame, disliked: DataFrame, limit: int = 50, dislike_weight: float = 0.5, metric: str = "cosine", seed: str = "preferences") -> DataFrame:
    """Songs near the likes' centroid and far from the dislikes' (always by cosine); both sets have sha_id and weight."""
    vectors = with_songs(cat)
    up, down = centroid(vectors, liked), centroid(vectors, disliked)
    if up is None:
        raise LookupError("no liked song has a vector")
    known = liked.select("sha_id").union(disliked.select("sha_id"))
    found = nearest(vectors, up, 5 * limit, metric, known)
    if down is not None:
        away = found.join(vectors, "sha_id").select("sha_id", (F.col("score") - dislike_weight * score("cosine", down)(F.col("vector"))).alias("score"))
        found = away
    return diversify(_named(cat, found, seed), limit)


def for_you(cat: Catalog, liked: DataFrame, disliked: DataFrame, as_of: datetime, limit: int = 50, days: int = 30, dislike_weight: float = 0.5) -> DataFrame:
    """Preferences from likes (1.0), frequent plays (0.8), completions (0.7) against dislikes (1.0) and skips (0.5)."""
    plays = cat.play_sessions.where(within("started_at", as_of - timedelta(days=days), as_of))
    top = lambda df, least, n, w: df.where(F.col("n") >= least).orderBy(F.desc("n"), "sha_id").limit(n).select("sha_id", F.lit(w).alias("weight"))
    by = lambda df: df.groupBy("sha_id").agg(F.count(F.lit(1)).alias("n"))
    half = plays.where(F.col("started_at") >= F.lit(as_of - timedelta(days=days // 2)))
    plus = liked.select("sha_id", F.lit(1.0).alias("weight")).union(top(by(plays), 3, 50, 0.8)).union(top(by(half.where("completed OR completion_percent >= 80")), 1, 30, 0.7))
    minus = disliked.select("sha_id", F.lit(1.0).alias("weight")).union(top(by(plays.where("skipped OR completion_percent < 30")), 2, 30, 0.5))
    return preference_playlist(cat, plus, minus, limit, dislike_weight, seed="for you")

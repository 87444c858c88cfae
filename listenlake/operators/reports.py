"""Reports and share cards, put together from the statistics, and previews of rules."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from listenlake.catalog import Catalog
from listenlake.functions.period import days_of
from listenlake.operators import library, listening, rules


def sections(cat: Catalog, period: str, as_of: datetime) -> dict[str, DataFrame]:
    """The frames of a listening report; each is a few rows."""
    return {
        "overview": listening.overview(cat, period, as_of),
        "top_songs": listening.top_songs(cat, period, as_of, 10),
        "top_artists": listening.top_artists(cat, period, as_of, 10),
        "top_albums": listening.top_albums(cat, period, as_of, 10),
        "genres": listening.genre_breakdown(cat, period, as_of, 10),
        "moods": library.mood_distribution(cat),
        "activity": listening.daily_activity(cat, as_of, min(days_of(period, as_of), 90)),
        "personality": listening.personality(cat, period, as_of),
    }


def write_report(cat: Catalog, period: str, as_of: datetime, root: str, kind: str = "json") -> None:
    """A folder for each section below ``root``, as JSON lines or CSV with a header."""
    for name, df in sections(cat, period, as_of).items():
        writer = df.coalesce(1).write.mode("overwrite")  # a few rows
        writer.json(f"{root}/{name}") if kind == "json" else writer.option("header", True).csv(f"{root}/{name}")


def share_card(cat: Catalog, period: str, as_of: datetime) -> DataFrame:
    """One row: headline figures, the top song and artist, and the listener type."""
    o = listening.overview(cat, period, as_of).select("total_plays", "total_duration_ms", "unique_songs", "avg_completion")
    song = listening.top_songs(cat, period, as_of, 1).selectExpr("title AS top_song")
    artist = listening.top_artists(cat, period, as_of, 1).selectExpr("artist AS top_artist")
    return o.crossJoin(song).crossJoin(artist).crossJoin(listening.personality(cat, period, as_of).select("listener_type"))  # one row each


def preview(compiler: rules.Compiler, rule: dict, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """At most 100 rows of a rule, and its total. Results that are read often are held by ``DataFrame.cache`` or as views."""
    tree = rules.parse(rule)
    return compiler.playlist(tree, limit=max(1, min(limit, 100))), compiler.count(tree)

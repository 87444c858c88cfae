"""Stored playlists: lists, details, edits of the playlists' table, and static playlists turned into rules."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from listenlake.catalog import Catalog
from listenlake.functions import exprs as X
from listenlake.operators import rules as R
from listenlake.operators.browse import first_primary
from listenlake.operators.tables import upsert

COLUMNS = "playlist_id string, name string, rules string, sort_by string, sort_order string, limit_count int, is_template boolean, category string, updated_at timestamp"


def listed(playlists: DataFrame) -> DataFrame:
    """Playlists, the latest changed first and templates last; ties by id."""
    return playlists.orderBy(F.coalesce("is_template", F.lit(False)), F.desc_nulls_last("updated_at"), "playlist_id")


def templates(playlists: DataFrame, category: str | None = None) -> DataFrame:
    """Templates (of a category) by name."""
    some = playlists.where("is_template")
    return (some.where(F.col("category") == category) if category else some).orderBy("name", "playlist_id")


def categories(playlists: DataFrame) -> DataFrame:
    """Distinct categories of templates, in order."""
    return playlists.where("is_template AND category IS NOT NULL").select("category").distinct().orderBy("category")


def save(playlists: DataFrame, changed: DataFrame) -> DataFrame:
    """The table with playlists created or changed; a null leaves the stored value. Templates can't be changed: their rows stay."""
    fixed = playlists.where("is_template").select("playlist_id")
    return upsert(playlists, changed.join(fixed, "playlist_id", "left_anti"), ["playlist_id"])


def delete(playlists: DataFrame, members: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without some playlists; templates stay."""
    gone = ids.select("playlist_id").distinct().join(playlists.where("is_template").select("playlist_id"), "playlist_id", "left_anti")
    return playlists.join(gone, "playlist_id", "left_anti"), members.join(gone, "playlist_id", "left_anti")


def from_template(playlists: DataFrame, template_id: str, playlist_id: str, name: str, now: datetime) -> DataFrame:
    """One new playlist with a template's rules, order and limit; no row if there is no such template."""
    row = playlists.where(F.col("is_template") & (F.col("playlist_id") == template_id))
    new = {"playlist_id": F.lit(playlist_id), "name": F.lit(name), "is_template": F.lit(False), "updated_at": F.lit(now)}
    return row.withColumns(new)


def detail(cat: Catalog, members: DataFrame, playlist_id: str) -> DataFrame:
    """A playlist's songs by position: their artists in order of name, and the id of their album by its title and primary artist."""
    rows = members.where(F.col("playlist_id") == playlist_id).select("position", "sha_id").join(cat.songs, "sha_id")
    artists = cat.song_artists.join(cat.artists, "artist_id").groupBy("sha_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("artists"))
    first = first_primary(cat)
    album = F.when(F.col("album") != "", X.album_id("album", "primary_artist"))
    out = rows.join(artists, "sha_id", "left").join(first, "sha_id", "left")
    return out.select("position", "sha_id", "title", "artists", "album", album.alias("album_id"), "duration_sec").orderBy("position", "sha_id")


def explanation(rules: str | dict) -> str:
    """A stored playlist's rules in words."""
    return R.explain(R.parse(json.loads(rules) if isinstance(rules, str) else rules))


def rule_plan(compiler: R.Compiler, rules: dict, **options) -> str:
    """The formatted plan of a rule's query."""
    df = compiler.playlist(R.parse(rules), **options)
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def suggested_rule(suggestion: str) -> dict:
    """The rule of a suggestion's id: artist:, genre:, years:from-to or recent:days."""
    kind, _, value = suggestion.partition(":")
    if kind in ("artist", "genre"):
        return R._rule((kind, "equals", value))
    if kind == "years":
        a, b = (int(x) for x in value.split("-"))
        return R._rule(("release_year", "between", [a, b]))
    if kind == "recent":
        return R._rule(("added_at", "within_days", int(value)))
    raise R.RuleError(f"no suggestion {suggestion}")


def convert(cat: Catalog, ids: DataFrame, as_of: datetime, suggestion: str | None = None) -> dict | None:
    """The rules that a static playlist's songs turn into: of the suggestion named, else of the best one (then the least id); None without any."""
    found = {r.id: r.score for r in R.suggest(cat, ids, as_of).collect()}  # four rows at most
    if suggestion is not None and suggestion not in found:
        raise R.RuleError(f"no suggestion {suggestion}")
    best = suggestion or min(found, key=lambda i: (-found[i], i), default=None)
    return suggested_rule(best) if best else None

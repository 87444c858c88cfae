"""Table maintenance: upserts, dedup, state transitions, materialised aggregates, retention."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from listenlake.catalog import Catalog
from listenlake.functions import exprs as X


def _n() -> Column:
    return F.count(F.lit(1)).cast("long")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: Iterable[str] = (), overwrite: bool = False) -> DataFrame:
    """``old`` with the rows of ``new`` merged in by ``keys``: one full outer join.

    A new value replaces an old one where it is not null; with ``overwrite`` also where it is null, but for columns of
    ``keep_old``. Keys must be unique on either side (see :func:`latest`).
    """
    fresh = new.select(*keys, F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in new.columns if c not in keys])
    out = []
    for c in old.columns:
        if c in keys or c not in new.columns:
            out.append(F.col(c))
        elif overwrite and c not in set(keep_old):
            out.append(F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.coalesce(f"__{c}", c).alias(c))
    return old.join(fresh, keys, "full").select(*out)


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row a key, the one with the greatest ``by``; a map-side combined maximum, so hot keys stay small."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("__r")).select(*keys, "__r.*").select(*df.columns)


def get_or_create(known: DataFrame, names: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """``known`` with an id for each new non-empty name; ids are hashes of names, so concurrent writers agree."""
    new = names.select(F.trim(name_col).alias(name_col)).where(F.col(name_col) != "").distinct().join(known, name_col, "left_anti")
    return known.select(id_col, name_col).union(new.select(F.xxhash64(name_col).alias(id_col), name_col))


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key has none in ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def dedup_candidates(items: DataFrame) -> DataFrame:
    """Candidates (no, title, artist) once a title and artist, ignoring case and outer space; those without artist go if the title has one with."""
    norm = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    rows = items.select("*", norm(F.col("title")).alias("__t"), norm(F.col("artist")).alias("__a"))
    first = rows.groupBy("__t", "__a").agg(F.min_by(F.struct(*items.columns), "no").alias("r"))
    with_artist = first.where("__a <> ''")
    bare = first.where("__a = ''").join(with_artist.select("__t").distinct(), "__t", "left_anti").select("__t", "__a", "r")
    return with_artist.union(bare).select("r.*")


def unknown_candidates(items: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose title and artist, or bare title, aren't in ``known`` (title, artist)."""
    norm = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    have = known.select(norm(F.col("title")).alias("__t"), norm(F.col("artist")).alias("__a")).distinct()
    rows = items.select("*", norm(F.col("title")).alias("__t"), norm(F.col("artist")).alias("__a"))
    named = rows.where("__a <> ''").join(have, ["__t", "__a"], "left_anti").select(*items.columns)
    bare = rows.where("__a = ''").join(have.select("__t").distinct(), "__t", "left_anti").select(*items.columns)
    return named.union(bare)


def split_new_content(items: DataFrame, known: DataFrame, content: str) -> DataFrame:
    """Items with sha256 of ``content`` and whether it is known already or repeats an earlier item (by ``no``)."""
    rows = items.withColumn("sha_id", F.sha2(F.col(content), 256))
    first = rows.groupBy("sha_id").agg(F.min("no").alias("__first"))
    out = rows.join(first, "sha_id").join(known.select("sha_id", F.lit(True).alias("__known")).distinct(), "sha_id", "left")
    return out.withColumn("duplicate", F.coalesce("__known", F.lit(False)) | (F.col("no") > F.col("__first"))).drop("__first", "__known")


def compact_log(lines: DataFrame) -> DataFrame:
    """Of log lines (no, value: JSON) the last record of each download and stage; broken or incomplete lines are skipped."""
    rec = lines.select("no", F.get_json_object("value", "$.download_id").alias("download_id"), F.get_json_object("value", "$.stage").alias("stage"), "value").where("download_id IS NOT NULL AND stage IS NOT NULL")
    return rec.groupBy("download_id", "stage").agg(F.max("no").alias("no"), F.max_by("value", "no").alias("value"))


#: The states of a queue entry, in order, and those that end it.
STAGES = ["pending", "downloaded", "converting", "pcm_raw_ready", "hashed", "embedded", "stored"]
ENDED = ["stored", "duplicate"]


def advance_queue(queue: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply updates (queue_id, status[, download_path, stored_path, sha_id, error]): one attempt more, paths kept where an update has none, ended entries gone."""
    paths = [c for c in ("download_path", "stored_path", "sha_id", "error") if c in updates.columns and c in queue.columns]
    up = updates.select("queue_id", F.col("status").alias("__status"), *[F.col(c).alias(f"__{c}") for c in paths])
    out = queue.join(up, "queue_id", "left")
    hit = F.col("__status").isNotNull()
    new = {"status": F.coalesce("__status", "status"), "attempts": F.col("attempts") + hit.cast("int")} | {c: F.coalesce(f"__{c}", c) for c in paths}
    return out.withColumns(new).where(~F.col("status").isin(ENDED)).select(*queue.columns)


#: The time that entering a state sets.
STAGE_TIMES = {"downloaded": "downloaded_at", "pcm_raw_ready": "processed_at", "hashed": "hashed_at", "embedded": "embedded_at"}


def advance_queue_at(queue: DataFrame, updates: DataFrame, at: datetime) -> DataFrame:
    """:func:`advance_queue` with the time of each stage: an update sets its state's time and updated_at; other times, and entries without an update, keep theirs."""
    times = [c for c in (*STAGE_TIMES.values(), "updated_at") if c not in queue.columns]
    rows = queue.withColumns({c: F.lit(None).cast("timestamp_ntz") for c in times})
    moved = advance_queue(rows, updates).join(updates.select("queue_id", F.lit(True).alias("__moved")), "queue_id", "left")
    now, hit = F.lit(at).cast("timestamp_ntz"), F.col("__moved").isNotNull()
    new = {c: F.when(hit & (F.col("status") == state), now).otherwise(F.col(c)) for state, c in STAGE_TIMES.items()}
    return moved.withColumns(new | {"updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}).drop("__moved")


def listening_stats(cat: Catalog, unit: str) -> DataFrame:
    """Plays, completions, skips, songs, time and mean completion by day, week or month."""
    return cat.play_sessions.groupBy(F.to_date(F.date_trunc(unit, "started_at")).alias("bucket")).agg(
        _n().alias("plays"), F.count_if("completed").cast("long").alias("completed"), F.count_if("skipped").cast("long").alias("skips"), F.count_distinct("sha_id").alias("unique_songs"),
        F.sum("duration_played_ms").cast("long").alias("duration_ms"), X.mean("completion_percent", 2).alias("avg_completion"),
    )


def top_songs_monthly(cat: Catalog) -> DataFrame:
    """Plays and time by month, song and primary artist."""
    by = cat.play_sessions.groupBy(F.to_date(F.date_trunc("month", "started_at")).alias("month"), "sha_id").agg(_n().alias("plays"), F.sum("duration_played_ms").cast("long").alias("duration_ms"))
    return cat.with_primary(by).join(cat.songs.select("sha_id", "title"), "sha_id").select("month", "sha_id", "title", "artist", "plays", "duration_ms")


def songs_with_features(cat: Catalog) -> DataFrame:
    return cat.songs.join(cat.audio_features, "sha_id", "left")


def artist_variants(artists: DataFrame) -> DataFrame:
    """Normalised names to artists: lower case, without spaces, without a leading 'the'; the latest artist wins a name."""
    base = F.lower(F.trim("name"))
    forms = F.array_distinct(F.array(base, F.regexp_replace(base, " ", ""), F.when(base.startswith("the "), F.substring(base, 5, 1000)).otherwise(base)))
    return artists.select("artist_id", "name", F.explode(forms).alias("normalized_name")).groupBy("normalized_name").agg(F.max("artist_id").alias("artist_id"), F.max_by("name", "artist_id").alias("canonical_name"))


def retain(events: DataFrame, sessions: DataFrame, streaks: DataFrame, as_of: datetime, event_days: int = 90, session_days: int = 365) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays: events and sessions young enough (and events of kept sessions only), and streaks that are young, current or the longest."""
    kept = sessions.where(F.col("started_at") >= F.lit(as_of - timedelta(days=session_days)))
    young = events.where(F.col("timestamp") >= F.lit(as_of - timedelta(days=event_days))).join(kept.select("session_id"), "session_id", "left_semi")
    longest = streaks.agg(F.max("length_days").alias("__m"))
    old_day = F.lit((as_of - timedelta(days=session_days)).date())
    rows = streaks.crossJoin(longest).where((F.col("end_date") >= old_day) | (F.col("end_date") >= F.lit(as_of.date() - timedelta(days=1))) | (F.col("length_days") == F.col("__m"))).drop("__m")  # one row
    return young, kept, rows


def album_tracks(releases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Albums and tracks from release JSON (release_id, payload): media and their tracks flattened, milliseconds to seconds, 'n/m' to n."""
    kind = "title string, artist string, date string, media array<struct<tracks: array<struct<number: string, title: string, length: long>>>>"
    r = releases.select("release_id", F.from_json("payload", kind).alias("p")).where("p IS NOT NULL")
    tracks = r.select("release_id", F.explode("p.media").alias("m")).select("release_id", F.explode("m.tracks").alias("t"))
    tracks = tracks.select("release_id", F.regexp_extract("t.number", r"^(\d+)", 1).try_cast("int").alias("track_number"), F.col("t.title").alias("title"), F.round(F.col("t.length") / 1000).cast("int").alias("duration_sec"))
    total = tracks.groupBy("release_id").agg(_n().alias("track_count"), F.sum("duration_sec").cast("long").alias("total_duration_sec"))
    albums = r.select("release_id", F.col("p.title").alias("title"), F.col("p.artist").alias("artist"), F.regexp_extract("p.date", r"(\d{4})", 1).try_cast("int").alias("release_year"))
    albums = albums.withColumns({"album_key": X.album_key("title", "artist"), "album_id": F.md5(F.concat(F.lower("title"), F.lit("::"), F.lower(F.coalesce("artist", F.lit("")))))})
    return albums.join(total, "release_id", "left"), tracks


def delete_songs(ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table without the rows of some songs."""
    gone = ids.select("sha_id").distinct()
    return {k: df.join(gone, "sha_id", "left_anti") if "sha_id" in df.columns else df for k, df in tables.items()}


def quarantine(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audio features inside their ranges, and the others."""
    inside: Column = F.col("bpm").isNull() | F.col("bpm").between(30, 300)
    for c in ("energy", "danceability", "acousticness"):
        inside = inside & (F.col(c).isNull() | F.col(c).between(0, 100))
    return features.where(inside), features.where(~inside)

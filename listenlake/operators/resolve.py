"""Metadata resolution and edits: name lists, variants, choice among candidates, and their effect on songs and artists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listenlake.functions import fuzzy

#: Suffixes of files that need no conversion, and of those that do.
READY, CONVERTIBLE = ("mp3",), ("flac", "wav", "m4a", "ogg", "opus", "aac")
#: Points for the kind of a release and for being official, and for a title's likeness.
KIND_POINTS, OFFICIAL_POINTS, TITLE_POINTS = {"album": 5, "ep": 3, "single": -2}, 10, 100
#: Sources of matches in order of trust.
SOURCES = ["musicbrainz", "spotify", "discogs"]
#: Artist names that say nothing.
PLACEHOLDERS = ["unknown", "unknown artist", "various", "various artists", "n/a", "none", "artist"]


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def distinct_names(names: str | Column) -> Column:
    """An array of names trimmed, without empty ones and without repeats in any case; the first spelling stays, in order."""
    clean = F.filter(F.transform(_c(names), lambda x: F.trim(x)), lambda x: x != "")
    lower = F.transform(clean, F.lower)
    return F.filter(clean, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def title_variants(title: str | Column) -> Column:
    """A title, then with its brackets, featured artists and trailing qualifiers taken off one after another; distinct and not empty."""
    strip = lambda x, p: F.trim(F.regexp_replace(x, p, ""))
    whole = F.trim(_c(title))
    no_brackets = strip(whole, r"\s*[\(\[][^\)\]]*[\)\]]")
    no_guests = strip(no_brackets, r"(?i)\s+(feat|ft|featuring)\b.*$")
    bare = strip(no_guests, r"(?i)(\s+(official|lyrics?|music|audio|video|visuali[sz]er|hd|hq|4k|remaster(ed)?))+$")
    return distinct_names(F.array(whole, no_brackets, no_guests, bare))


def is_placeholder(name: str | Column) -> Column:
    """Whether an artist's name says nothing: null, empty, a number or a stock phrase."""
    x = F.lower(F.trim(F.coalesce(_c(name), F.lit(""))))
    return (x == "") | x.isin(PLACEHOLDERS) | x.rlike(r"^\d+$")


def choose_release(releases: DataFrame) -> DataFrame:
    """Per recording the best of its releases (recording_id, release_id, title_similarity, status, kind) and its score; ties go to the least release_id."""
    kind = F.lower("kind")
    points = F.lit(0)
    for name, p in KIND_POINTS.items():
        points = F.when(kind == name, p).otherwise(points)
    score = TITLE_POINTS * F.coalesce("title_similarity", F.lit(0.0)) + points + F.when(F.lower("status") == "official", OFFICIAL_POINTS).otherwise(0)
    scored = releases.withColumn("score", score.cast("double"))
    best = F.min_by(F.struct("release_id", "score"), F.struct(-F.col("score"), "release_id"))
    return scored.groupBy("recording_id").agg(best.alias("b")).select("recording_id", "b.release_id", "b.score")


def first_hit(hits: DataFrame, sources: list[str] = SOURCES) -> DataFrame:
    """Per key the match of the first source that has one, and in it the one of the first variant (key, source, variant, match); unknown sources come last."""
    place = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source"))
    rank = F.when(place > 0, place).otherwise(len(sources) + 1)
    return hits.where("match IS NOT NULL").groupBy("key").agg(F.min_by(F.struct("source", "variant", "match"), F.struct(rank, "variant", "match")).alias("h")).select("key", "h.*")


def resolve(candidates: DataFrame, least_confidence: float = 0.3, least_artist: float = 0.4) -> DataFrame:
    """Per key the match of the first stage with one (key, stage, confidence, artist_similarity, score, match).

    In a stage the greatest score times confidence wins, then the least match. Candidates under either gate are left
    out; without an artist to compare (null similarity) only the confidence counts.
    """
    ok = candidates.where((F.col("confidence") >= least_confidence) & F.coalesce(F.col("artist_similarity") >= least_artist, F.lit(True)) & F.col("match").isNotNull())
    value = F.col("score") * F.col("confidence")
    return ok.groupBy("key").agg(F.min_by(F.struct("stage", "match", value.alias("value")), F.struct("stage", -value, "match")).alias("b")).select("key", "b.*")


def apply_matches(songs: DataFrame, matches: DataFrame) -> DataFrame:
    """Songs with matches (sha_id, title, album, duration_sec, release_year, track_number, source) applied.

    Title and album are replaced, numbers only where the match has them; matched songs are verified. At most one match a song.
    """
    columns = ("title", "album", "duration_sec", "release_year", "track_number")
    m = matches.select("sha_id", F.lit(True).alias("__hit"), F.col("source").alias("__source"), *[F.col(c).alias(f"__{c}") for c in columns])
    new = {c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns[:2]}
    new |= {c: F.coalesce(f"__{c}", c) for c in columns[2:]}
    new |= {"verified": F.coalesce("__hit", "verified"), "verification_source": F.coalesce("__source", "verification_source")}
    return songs.join(m, "sha_id", "left").withColumns(new).select(*songs.columns)


def link_album(songs: DataFrame, links: DataFrame) -> DataFrame:
    """Songs put on albums (sha_id, album, mark_verified): the album is replaced, and the song verified by hand where asked."""
    m = links.select("sha_id", F.col("album").alias("__album"), F.lit(True).alias("__hit"), F.coalesce("mark_verified", F.lit(False)).alias("__mark"))
    mark = F.coalesce("__mark", F.lit(False))
    new = {"album": F.when(F.col("__hit"), F.col("__album")).otherwise(F.col("album")), "verified": mark | F.col("verified"), "verification_source": F.when(mark, "manual").otherwise(F.col("verification_source"))}
    return songs.join(m, "sha_id", "left").withColumns(new).select(*songs.columns)


def edited_artists(edits: DataFrame) -> DataFrame:
    """Edits (sha_id, artists: names split by ; or ,) as rows (sha_id, name, role): the first is primary, the others are featured."""
    names = distinct_names(F.split("artists", "[;,]"))
    return edits.select("sha_id", F.posexplode(names).alias("i", "name")).select("sha_id", "name", F.when(F.col("i") == 0, "primary").otherwise("featured").alias("role"))


def resolved_edits(edits: DataFrame, artists: DataFrame) -> DataFrame:
    """Edits (sha_id, artists) as rows (sha_id, name, role, artist_id): names that mean a known artist become its name, others are new (null id).

    Of names of one song that mean the same artist, the first stays.
    """
    names = edited_artists(edits)
    known = fuzzy.resolve_artists(names, artists)
    rows = names.join(known, "name", "left").select("sha_id", F.coalesce("artist", "name").alias("name"), "role", "artist_id")
    first = F.max("role")  # primary comes after featured
    return rows.groupBy("sha_id", "name").agg(first.alias("role"), F.min("artist_id").alias("artist_id"))


def imports(paths: DataFrame) -> DataFrame:
    """Queue entries of files (path): artist and title of the name, and downloaded, converting or failed with an error, by suffix."""
    name = F.substring_index(F.col("path"), "/", -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    stem = F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), "_", " "))
    halves = F.split(stem, r"\s+-\s+", 2)
    two = F.size(halves) == 2
    title, artist = F.when(two, F.trim(F.get(halves, F.lit(1)))).otherwise(stem), F.when(two, F.trim(F.get(halves, F.lit(0))))
    error = F.when(stem == "", "empty name").when(~suffix.isin(*READY, *CONVERTIBLE), "unsupported file type")
    status = F.when(error.isNotNull(), "failed").when(suffix.isin(*READY), "downloaded").otherwise("converting")
    return paths.select("path", artist.alias("artist"), title.alias("title"), status.alias("status"), error.alias("error"))


def reset(tables: dict[str, DataFrame], names: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables with those of ``names`` emptied, and how many rows each of them had (table, removed)."""
    left = {k: df.limit(0) if k in names else df for k, df in tables.items()}
    counts = [tables[n].agg(F.lit(n).alias("table"), F.count(F.lit(1)).cast("long").alias("removed")) for n in names]
    removed = counts[0]
    for c in counts[1:]:
        removed = removed.union(c)
    return left, removed

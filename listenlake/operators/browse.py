"""Catalog search and browsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from listenlake.catalog import Catalog
from listenlake.functions import exprs as X


def _n() -> Column:
    return F.count(F.lit(1)).cast("long")


def artist_arrays(cat: Catalog) -> DataFrame:
    """Per song its artists' names and ids in order: role descending ('primary' before 'featured'), then id."""
    rows = cat.song_artists.join(cat.artists, "artist_id").select("sha_id", F.struct((F.when(F.col("role") == "primary", 0).when(F.col("role") == "featured", 1).otherwise(2)).alias("rank"), "artist_id", "name").alias("a"))
    by = rows.groupBy("sha_id").agg(F.array_sort(F.collect_list("a")).alias("a"))
    return by.select("sha_id", F.col("a.name").alias("artists"), F.col("a.artist_id").alias("artist_ids"))


def first_primary(cat: Catalog) -> DataFrame:
    """One primary artist a song, the one with the least id."""
    return cat.primary.groupBy("sha_id").agg(F.min_by("artist", "artist_id").alias("primary_artist"))


def with_details(cat: Catalog, songs: DataFrame) -> DataFrame:
    """Songs with their artists in order (none: empty) and album id."""
    out = songs.join(artist_arrays(cat), "sha_id", "left").join(first_primary(cat), "sha_id", "left")
    return out.select("*", X.album_id("album", "primary_artist").alias("album_id")).select(
        "sha_id", "title", "album", F.array_join(F.coalesce("artists", F.array().cast("array<string>")), ", ").alias("artists"), "album_id", "release_year", "created_at"
    )


def _has_artist(cat: Catalog, where: Column) -> DataFrame:
    return cat.song_artists.join(cat.artists, "artist_id").where(where).select("sha_id").distinct()


def search(cat: Catalog, q: str | None = None, genre: str | None = None, artist_id: int | None = None, limit: int = 50, offset: int = 0, album_id: str | None = None) -> DataFrame:
    """Songs by text in title, album or any artist's name, by genre, artist and album, all of which must hold; by title, then id."""
    return with_details(cat, _found(cat, q, genre, artist_id, album_id).orderBy("title", "sha_id").offset(offset).limit(limit))


def search_total(cat: Catalog, q: str | None = None, genre: str | None = None, artist_id: int | None = None, album_id: str | None = None) -> DataFrame:
    """How many songs :func:`search` has on all its pages."""
    return _found(cat, q, genre, artist_id, album_id).agg(_n().alias("total"))


def _found(cat: Catalog, q: str | None, genre: str | None, artist_id: int | None, album_id: str | None) -> DataFrame:
    out = cat.songs
    if q:
        hit = _has_artist(cat, F.col("name").ilike(f"%{q}%")).withColumn("__hit", F.lit(True))
        text = F.col("title").ilike(f"%{q}%") | F.coalesce(F.col("album").ilike(f"%{q}%"), F.lit(False)) | F.col("__hit").isNotNull()
        out = out.join(hit, "sha_id", "left").where(text).drop("__hit")
    if genre:
        out = out.join(cat.song_genres.where(F.col("genre").ilike(f"%{genre}%")).select("sha_id"), "sha_id", "left_semi")
    if artist_id is not None:
        out = out.join(cat.song_artists.where(F.col("artist_id") == artist_id).select("sha_id"), "sha_id", "left_semi")
    if album_id is not None:
        named = out.where("album <> ''").join(first_primary(cat), "sha_id")
        out = out.join(named.where(X.album_id("album", "primary_artist") == album_id).select("sha_id"), "sha_id", "left_semi")
    return out


def newest(cat: Catalog, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the catalog, the latest added first."""
    return with_details(cat, cat.songs.orderBy(F.desc("created_at"), "sha_id").offset(offset).limit(limit))


def artists(cat: Catalog, q: str | None = None) -> DataFrame:
    """Artists with their songs and named albums."""
    some = cat.artists.where(F.col("name").ilike(f"%{q}%")) if q else cat.artists
    songs = cat.song_artists.join(cat.songs.select("sha_id", F.when(F.col("album") != "", F.col("album")).alias("album")), "sha_id")
    by = songs.groupBy("artist_id").agg(F.count_distinct("sha_id").alias("song_count"), F.count_distinct("album").alias("album_count"))
    return some.join(by, "artist_id", "left").na.fill(0).select("artist_id", "name", "song_count", "album_count")


def albums(cat: Catalog) -> DataFrame:
    """Albums by title and primary artist: songs, first year, total duration."""
    named = cat.songs.where("album <> ''").join(first_primary(cat), "sha_id").withColumn("album_id", X.album_id("album", "primary_artist"))
    return named.groupBy("album_id").agg(F.min("album").alias("album"), F.max("primary_artist").alias("artist"), F.min("release_year").alias("release_year"), _n().alias("songs"), F.sum("duration_sec").cast("long").alias("duration_sec"))


def popular_artists(cat: Catalog, limit: int = 10) -> DataFrame:
    """Artists with the most songs."""
    by = cat.song_artists.groupBy("artist_id").agg(F.count_distinct("sha_id").alias("songs"))
    return by.join(cat.artists, "artist_id").orderBy(F.desc("songs"), "artist_id").limit(limit).select("artist_id", "name", "songs")


def artist_songs(cat: Catalog, artist_id: int) -> DataFrame:
    """An artist's songs in any role; order: year descending (unknown last), album, track, title."""
    own = cat.songs.join(cat.song_artists.where(F.col("artist_id") == artist_id).select("sha_id"), "sha_id", "left_semi")
    return own.orderBy(F.col("release_year").desc_nulls_last(), "album", F.col("track_number").asc_nulls_last(), "title", "sha_id").select("sha_id", "title", "album", "release_year", "track_number")


def unlinked(cat: Catalog, limit: int = 50) -> DataFrame:
    """Songs without an album or without any artist."""
    any_artist = cat.song_artists.select("sha_id").distinct().withColumn("__has", F.lit(True))
    bad = cat.songs.join(any_artist, "sha_id", "left").where("album IS NULL OR album = '' OR __has IS NULL").drop("__has")
    name = cat.song_artists.join(cat.artists, "artist_id").groupBy("sha_id").agg(F.coalesce(F.max(F.when(F.col("role") == "primary", F.col("name"))), F.max("name")).alias("artist"))
    return bad.orderBy(F.desc("created_at"), "sha_id").limit(limit).join(name, "sha_id", "left").select("sha_id", "title", "artist", "album")


def unlinked_count(cat: Catalog) -> DataFrame:
    any_artist = cat.song_artists.select("sha_id").distinct().withColumn("__has", F.lit(True))
    return cat.songs.join(any_artist, "sha_id", "left").where("album IS NULL OR album = '' OR __has IS NULL").agg(F.count_distinct("sha_id").alias("songs"))


def song_detail(cat: Catalog, sha_id: str) -> DataFrame:
    """A song with its distinct artists and genres, each bridge aggregated before it is joined."""
    one = cat.songs.where(F.col("sha_id") == sha_id)
    names = lambda df, c, out: df.where(F.col("sha_id") == sha_id).groupBy("sha_id").agg(F.array_join(F.array_sort(F.collect_set(c)), ",").alias(out))
    return one.join(names(cat.song_artists.join(cat.artists, "artist_id"), "name", "artists"), "sha_id", "left").join(names(cat.song_genres, "genre", "genres"), "sha_id", "left").select("sha_id", "title", "album", "artists", "genres")


def song_details(cat: Catalog, labels: DataFrame, producers: DataFrame) -> DataFrame:
    """Songs with artists (primary first, then by id), genres, labels, producers (distinct, sorted) and their files' number and bytes.

    ``labels`` and ``producers`` have (sha_id, name). Every bridge is aggregated before it is joined, so no row multiplies another's.
    """
    names = lambda df, c, out: df.groupBy("sha_id").agg(F.array_join(F.array_sort(F.collect_set(c)), ",").alias(out))
    by_role = F.array_sort(F.collect_list(F.struct((F.col("role") != "primary").alias("other"), "artist_id", "name")))
    artists = cat.song_artists.join(cat.artists, "artist_id").groupBy("sha_id").agg(F.array_join(F.transform(by_role, lambda x: x["name"]), ",").alias("artists"))
    files = cat.song_files.groupBy("sha_id").agg(_n().alias("files"), F.sum("file_size").cast("long").alias("bytes"))
    out = cat.songs.select("sha_id", "title", "album", "duration_sec", "release_year", "track_number", "verified", "verification_source")
    for own in (artists, names(cat.song_genres, "genre", "genres"), names(labels, "name", "labels"), names(producers, "name", "producers"), files):
        out = out.join(own, "sha_id", "left")
    return out.na.fill({"artists": "", "genres": "", "labels": "", "producers": "", "files": 0, "bytes": 0})


def failed_features(cat: Catalog) -> DataFrame:
    """Songs whose analysis failed, and why."""
    return cat.audio_features.where("error_message IS NOT NULL").join(cat.songs, "sha_id").select("sha_id", "title", "error_message")


def genres(cat: Catalog) -> DataFrame:
    return cat.song_genres.groupBy("genre").agg(F.count_distinct("sha_id").alias("songs"))


def queue_by_status(cat: Catalog) -> DataFrame:
    return cat.download_queue.groupBy("status").agg(_n().alias("n"))


def library_counts(cat: Catalog) -> DataFrame:
    """One row: songs, artists with songs, named albums, genres, files and vectors."""
    one = lambda df, c, name: df.agg(F.count_distinct(c).alias(name))
    out = cat.songs.agg(_n().alias("songs"))
    for df, c, name in (
        (cat.song_artists, "artist_id", "artists"), (cat.songs.where("album <> ''"), "album", "albums"), (cat.song_genres, "genre", "genres"),
        (cat.song_files, "sha_id", "with_files"), (cat.vectors, "sha_id", "with_vectors"),
    ):
        out = out.crossJoin(one(df, c, name))  # one row each
    return out


def image_candidates(cat: Catalog, limit: int = 100) -> DataFrame:
    """Verified songs to find cover images for: those with a release's id first, then the longest unchanged."""
    songs = cat.songs.where("verified")
    return songs.join(first_primary(cat), "sha_id", "left").orderBy(F.when(F.col("release_id").isNotNull(), 0).otherwise(1), "updated_at", "sha_id").limit(limit).select("sha_id", "title", "album", "release_id", F.col("primary_artist").alias("artist"))


def artist_profiles(cat: Catalog, profiles: DataFrame) -> DataFrame:
    """Artists with the identity that a profile of their name gives (artist_name, profile_json), null without one; of several the least."""
    ids = profiles.select(F.col("artist_name").alias("name"), F.get_json_object("profile_json", "$.artist.id").alias("external_id"))
    return cat.artists.select("artist_id", "name").join(ids.groupBy("name").agg(F.min("external_id").alias("external_id")), "name", "left").select("artist_id", "name", "external_id")


def queue(cat: Catalog, statuses: list[str], limit: int = 100) -> DataFrame:
    """Queue entries in some states, the latest first."""
    return cat.download_queue.where(F.col("status").isin(statuses)).orderBy(F.desc("created_at"), "queue_id").limit(limit)


def feature_status(cat: Catalog) -> DataFrame:
    """Songs analysed, failed and pending, and the mean time of an analysis."""
    x = cat.songs.select("sha_id").join(cat.audio_features.select("sha_id", "error_message", "analysis_duration_ms", F.lit(True).alias("has")), "sha_id", "left")
    failed = F.col("error_message").isNotNull()
    return x.agg(_n().alias("total"), F.count_if(F.col("has") & ~failed).cast("long").alias("analysed"), F.count_if(failed).cast("long").alias("failed"), F.count_if(F.col("has").isNull()).cast("long").alias("pending"), F.round(F.avg(F.when(~failed, F.col("analysis_duration_ms"))), 2).alias("avg_ms"))


def pending_features(cat: Catalog) -> DataFrame:
    return cat.songs.join(cat.audio_features, "sha_id", "left_anti").select("sha_id", "title")


def catalog_page(cat: Catalog, q: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Songs with a text in title, album or any artist's name, the latest added first."""
    hit = _has_artist(cat, F.col("name").ilike(f"%{q}%")).withColumn("__hit", F.lit(True))
    text = F.col("title").ilike(f"%{q}%") | F.coalesce(F.col("album").ilike(f"%{q}%"), F.lit(False)) | F.col("__hit").isNotNull()
    return with_details(cat, cat.songs.join(hit, "sha_id", "left").where(text).drop("__hit").orderBy(F.desc("created_at"), "sha_id").offset(offset).limit(limit))


def stored_albums(cat: Catalog, stored: DataFrame, search: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Stored albums (album_id, title, artist_name, release_year, track_count, total_duration_sec) with the songs that the library has of them.

    Songs count for the album that their title and each of their primary artists name. The latest year comes first, then titles; ``search``
    is looked for in titles and artists.
    """
    named = cat.songs.where("album <> ''").join(cat.primary, "sha_id", "left")
    counts = named.groupBy(F.md5(F.concat(F.lower("album"), F.lit("::"), F.lower(F.coalesce("artist", F.lit(""))))).alias("album_id")).agg(_n().alias("song_count"))
    text = (search or "").strip()
    some = stored.where(F.col("title").ilike(f"%{text}%") | F.col("artist_name").ilike(f"%{text}%")) if text else stored
    out = some.orderBy(F.col("release_year").desc_nulls_last(), "title", "album_id").offset(offset).limit(limit).join(counts, "album_id", "left")
    return out.select("album_id", "title", "artist_name", "release_year", "track_count", "total_duration_sec", F.coalesce("song_count", F.lit(0)).cast("long").alias("song_count"))


def album_headers(cat: Catalog, stored: DataFrame) -> DataFrame:
    """(album_id, title, artist_name, release_year, track_count, total_duration_sec) of every album: as stored, else made of its songs."""
    own = albums(cat).join(stored.select("album_id"), "album_id", "left_anti")
    made = own.select("album_id", F.col("album").alias("title"), F.col("artist").alias("artist_name"), "release_year", F.col("songs").alias("track_count"), F.col("duration_sec").alias("total_duration_sec"))
    return stored.select(*made.columns).unionByName(made)


def popular_albums(cat: Catalog, limit: int = 10) -> DataFrame:
    """Albums with the most songs."""
    return albums(cat).orderBy(F.desc("songs"), "album_id").limit(limit)


def album_songs(cat: Catalog, album_id: str) -> DataFrame:
    """An album's songs by track."""
    named = cat.songs.join(first_primary(cat), "sha_id").where(X.album_id("album", "primary_artist") == album_id)
    return named.orderBy(F.col("track_number").asc_nulls_last(), "title", "sha_id").select("sha_id", "title", "track_number", "duration_sec")


def album_pages(cat: Catalog) -> DataFrame:
    """Every album's songs with their places by track (unknown last), title and id; an album is a small group."""
    named = cat.songs.where("album <> ''").join(first_primary(cat), "sha_id").withColumn("album_id", X.album_id("album", "primary_artist"))
    order = Window.partitionBy("album_id").orderBy(F.col("track_number").asc_nulls_last(), "title", "sha_id")
    return named.select("album_id", F.row_number().over(order).alias("position"), "sha_id", "title", "track_number", "duration_sec")


def artist_albums(cat: Catalog, artist_id: int, stored: DataFrame | None = None) -> DataFrame:
    """An artist's albums: the stored ones, or, where none are stored, those of the songs."""
    derived = cat.songs.where("album <> ''").join(cat.primary.where(F.col("artist_id") == artist_id), "sha_id").groupBy("album").agg(F.min("release_year").alias("release_year"), _n().alias("songs"))
    if stored is None:
        return derived
    own = stored.where(F.col("artist_id") == artist_id).select(F.col("title").alias("album"), "release_year", F.col("track_count").cast("long").alias("songs"))
    none = own.agg(_n().alias("n")).where("n = 0").drop("n")
    return own.union(derived.join(none.withColumn("__k", F.lit(1)), F.lit(True)).drop("__k"))


def unverified(cat: Catalog, limit: int = 100) -> DataFrame:
    """Songs not verified yet, with their distinct artists."""
    names = cat.song_artists.join(cat.artists, "artist_id").groupBy("sha_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("artists"))
    return cat.songs.where(~F.col("verified")).orderBy("created_at", "sha_id").limit(limit).join(names, "sha_id", "left").select("sha_id", "title", "artists", "album")

"""Scores of measured audio and of metadata candidates, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Least and greatest of each measure of energy, and its weight.
ENERGY = {"rms": (0.0, 0.3, 0.4), "centroid": (1000.0, 5000.0, 0.3), "onset": (0.0, 2.0, 0.2), "flux": (0.0, 1.0, 0.1)}
#: Tempos that suit dancing best, how fast it falls below and above them, and how far.
DANCE_TEMPO, DANCE_FALL, DANCE_LEAST = (115, 130), (50, 60), (0.5, 0.6)
#: The moods in the order that breaks ties; when each holds, and its raw score then.
MOODS = {
    "happy": ("major AND tempo > 100 AND energy > 0.08", "0.5 + 0.3 * least(1, tempo / 140) + 0.2 * least(1, energy / 0.2)"),
    "sad": ("NOT major AND tempo < 100 AND energy < 0.15", "0.5 + 0.3 * (1 - tempo / 100) + 0.2 * (1 - energy / 0.15)"),
    "energetic": ("tempo > 115 AND energy > 0.12", "0.4 + 0.35 * least(1, energy / 0.25) + 0.25 * least(1, tempo / 160)"),
    "calm": ("tempo < 95 AND energy < 0.12", "0.5 + 0.3 * (1 - tempo / 95) + 0.2 * (1 - energy / 0.12)"),
    "aggressive": ("energy > 0.18 AND percussiveness > 0.08 AND tempo > 100", "0.4 + 0.4 * least(1, energy / 0.3) + 0.2 * least(1, percussiveness / 0.15)"),
    "romantic": ("tempo > 70 AND tempo < 110 AND energy > 0.05 AND energy < 0.15", "0.4 + if(major, 0.2, 0) + 0.2 * (1 - abs(tempo - 90) / 40)"),
    "dark": ("NOT major AND brightness < 2500 AND energy < 0.2", "0.5 + 0.3 * (1 - brightness / 2500) + 0.2 * (1 - energy / 0.2)"),
    "uplifting": ("major AND tempo > 90 AND energy > 0.1", "least(1, 0.4 + if(tempo > 110, 0.15, 0) + if(contrast > 20, 0.15, 0) + 0.1 * least(1, energy / 0.2))"),
}
#: Gates and weights of a recording, with a known artist and without: title, artist, and the source's score.
RECORDING_GATES = {"score": 75, "title": 0.72, "title_alone": 0.85, "artist": 0.6}
RECORDING = {True: (25, 45, 0.3), False: (40, 10, 0.5)}
#: Gates and weights of a release, with a known artist and without: title, artist, album, track.
RELEASE_GATES = {"total": 70, "title": 0.72, "artist": 0.6}
RELEASE = {True: (35, 40, 10, 5), False: (50, 15, 15, 10)}
#: Points of the first kind of release, and of the first medium, that a format names.
KINDS = [("album", 10), ("lp", 10), ("ep", 5), ("single", 2), ("compilation", -5)]
MEDIA = [("cd", 2), ("vinyl", 1)]


def _percent(share: Column) -> Column:
    """A share as whole percent, half to even, within 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(share * 100).cast("int")))


def _capped(c: Column) -> Column:
    return F.least(F.lit(1.0), c)


def energy(rms: Column, centroid: Column, onset: Column, flux: Column) -> Column:
    """Energy 0..100: loudness, brightness, onsets and spectral flux, each scaled into its range."""
    parts = []
    for c, (low, high, weight) in zip((rms, centroid, onset, flux), ENERGY.values(), strict=True):
        parts.append(weight * F.greatest(F.lit(0.0), _capped((c - low) / (high - low))))
    return _percent(sum(parts[1:], parts[0]))


def danceability(beat: Column, stability: Column, regularity: Column, groove: Column, tempo: Column) -> Column:
    """Danceability 0..100 of four shares, lowered by the tempo's distance from the best."""
    low, high = DANCE_TEMPO
    slow = F.greatest(F.lit(DANCE_LEAST[0]), 1 - (low - tempo) / DANCE_FALL[0])
    fast = F.greatest(F.lit(DANCE_LEAST[1]), 1 - (tempo - high) / DANCE_FALL[1])
    factor = F.when(tempo.between(low, high), 1.0).when(tempo < low, slow).otherwise(fast)
    return _percent((0.4 * beat + 0.3 * stability + 0.2 * regularity + 0.1 * groove) * factor)


def groove(off_beat: Column, on_beat: Column) -> Column:
    """Groove of the ratio of onset strength between beats to that on them: best at a half, 0.3 at the extremes, 0.5 unknown."""
    ratio = off_beat / F.nullif(on_beat, F.lit(0.0))
    return F.coalesce(F.when((ratio < 0.1) | (ratio > 0.9), 0.3).when(ratio.isNotNull(), 1 - F.abs(ratio - 0.5) * 2), F.lit(0.5))


def acousticness(flatness: Column, harmonic: Column, bandwidth_var: Column, crossings: Column) -> Column:
    """Acousticness 0..100 of spectral flatness, the harmonic share, bandwidth variance and zero crossings."""
    band = F.when(bandwidth_var < 500_000, _capped(bandwidth_var / 100_000)).otherwise(0.5)
    zero = F.when((crossings > 0.02) & (crossings < 0.15), 1 - F.abs(crossings - 0.08) * 10).otherwise(0.3)
    return _percent(0.35 * (1 - _capped(flatness * 10)) + 0.30 * harmonic + 0.20 * band + 0.15 * zero)


def instrumentalness(vocal: Column, other: Column, mfcc_var: Column, low_contrast: Column, vocal_pitch: Column) -> Column:
    """Instrumentalness 0..100: what is left of the voice's presence in energy, cepstral variance, contrast and pitch."""
    share = F.when(other != 0, _capped(vocal / F.nullif(other, F.lit(0.0)) / 1.5)).otherwise(0.5)
    contrast = F.when(low_contrast > 0, _capped(low_contrast / 25)).otherwise(0.5)
    presence = 0.35 * share + 0.30 * _capped(mfcc_var / 50) + 0.20 * contrast + 0.15 * vocal_pitch.cast("int")
    return _percent(1 - presence)


def moods(df: DataFrame) -> DataFrame:
    """``df`` (tempo, energy, major, brightness, percussiveness, contrast) with mood_scores as shares of the highest, mood_primary and mood_secondary.

    The secondary mood needs more than 0.3 of the primary's score. Without a mood that holds all are null or 0.
    """
    raw = [F.when(F.expr(when), F.expr(score).cast("double")).otherwise(0.0) for when, score in MOODS.values()]
    out = df.withColumn("__raw", F.array(*raw)).withColumn("__top", F.array_max("__raw"))
    share = lambda x: F.when(F.col("__top") > 0, F.floor(x / F.col("__top") * 100 + 0.5) / 100).otherwise(0.0)
    out = out.withColumn("__share", F.transform("__raw", share))
    ranked = F.array(*[F.struct((-F.col("__share")[i]).alias("least"), F.lit(i).alias("at"), F.lit(name).alias("mood")) for i, name in enumerate(MOODS)])
    ranked = F.array_sort(ranked)
    named = {
        "mood_scores": F.map_from_arrays(F.array(*[F.lit(m) for m in MOODS]), F.col("__share")),
        "mood_primary": F.when(ranked[0]["least"] < 0, ranked[0]["mood"]),
        "mood_secondary": F.when(ranked[1]["least"] < -0.3, ranked[1]["mood"]),
    }
    return out.withColumns(named).drop("__raw", "__top", "__share")


def duration_fits(expected: Column, found: Column) -> Column:
    """Whether durations differ by no more than 5 seconds or 5 percent of the expected one; true if either is unknown."""
    near = F.abs(expected - found) <= F.greatest(F.lit(5), F.floor(expected * 0.05).cast("int"))
    return F.coalesce(near, F.lit(True))


def recording_score(score: Column, title: Column, artist: Column, has_artist: Column, expected: Column, found: Column) -> Column:
    """Total of a candidate recording from likenesses of title and artist; null under a gate, or if the durations differ."""
    artist = F.coalesce(artist, F.lit(0.0))
    total = {k: s * score + t * title + a * artist for k, (t, a, s) in RECORDING.items()}
    total = F.when(has_artist, total[True]).otherwise(total[False]) + F.when(expected.isNotNull() & found.isNotNull(), 5.0).otherwise(0.0)
    g = RECORDING_GATES
    enough = F.when(has_artist, (title >= g["title"]) & (artist >= g["artist"])).otherwise(title >= g["title_alone"])
    return F.when((score >= g["score"]) & enough & duration_fits(expected, found), total)


def format_points(formats: Column) -> Column:
    """Points of a release's formats: its kind, and its medium."""

    def first(table: list[tuple[str, int]]) -> Column:
        names = lambda word: F.exists(formats, lambda f: F.lower(f).contains(word))
        cases = [(names(word), points) for word, points in table]
        return reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), reversed(cases), F.lit(0))

    return F.coalesce(first(KINDS) + first(MEDIA), F.lit(0))


def track_score(title: Column, expected: Column, found: Column) -> Column:
    """Likeness of a track's title, 0.1 more if its duration fits and 0.2 less if it doesn't."""
    return title + F.when((expected > 0) & (found > 0), F.when(duration_fits(expected, found), 0.1).otherwise(-0.2)).otherwise(0.0)


def best_release(candidates: DataFrame) -> DataFrame:
    """Per key the release of the greatest total (key, release_id, total), under which RELEASE_GATES hold; ties take the least release_id.

    Rows are tracks: key, release_id, formats, track_title (likeness), artist (likeness, null if unknown), has_artist, album
    (likeness, null if unknown), expected and found durations, kind (null or 'track' are tracks). A release is judged by the track
    of its greatest track score, the first place on a tie.
    """
    rows = candidates.where(F.coalesce(F.lower("kind") == "track", F.lit(True)) | (F.col("kind") == ""))
    rows = rows.withColumn("track", track_score(F.col("track_title"), F.col("expected"), F.col("found"))).where("track > 0")
    fields = F.struct("track", "track_title", "artist", "has_artist", "album", "formats")
    one = rows.groupBy("key", "release_id").agg(F.min_by(fields, F.struct(-F.col("track"), "place")).alias("r")).select("key", "release_id", "r.*")
    known = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("artist", "album")}

    def total(has: bool) -> Column:
        t, a, b, k = RELEASE[has]
        return t * F.col("track_title") + a * known["artist"] + b * known["album"] + format_points(F.col("formats")) + k * F.col("track")

    one = one.withColumn("total", F.when(F.col("has_artist"), total(True)).otherwise(total(False)))
    g = RELEASE_GATES
    close = ~F.col("has_artist") | F.col("artist").isNull() | (F.col("artist") >= g["artist"])
    ok = one.where((F.col("track_title") >= g["title"]) & close & (F.col("total") >= g["total"]))
    return ok.groupBy("key").agg(F.min_by(F.struct("release_id", "total"), F.struct(-F.col("total"), "release_id")).alias("b")).select("key", "b.*")

"""A join of texts by the ratio of matching blocks, and the artists and albums that edits mean by it.

The ratio of two texts is 2 M / T: M characters in K matching blocks, T characters in all. Between two blocks one text at least
has a character of its own, so K - 1 <= T - 2 M, and the blocks alone hold M - K >= T (1.5 r - 1) - 1 common pairs of neighbours
where the ratio is r or more. Texts are therefore joined on their rarest pairs only: so many that two texts with that many common pairs share
one. Before the ratio itself is computed, the texts' lengths and the characters they have in common must allow it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from listenlake.functions.text import fuzzy_ratio
from listenlake.runtime import materialize

#: Least ratio of an artist; least weighted ratio of an album, and the weights of title and artist.
ARTIST, ALBUM, TITLE_WEIGHT, ARTIST_WEIGHT = 0.82, 0.8, 0.7, 0.3
#: Fixed value: least ratio of a recording's release to the album that was asked for.
RELEASE = 0.6
#: Ratios that a search for the artist of the highest one tries before ARTIST.
TRIED = (0.95, 0.88)
START = "\u0002"


def normal(c: Column) -> Column:
    """Lower case without bracketed parts, featured artists and punctuation; spaces collapsed; empty for null."""
    x = F.lower(F.coalesce(c, F.lit("")))
    for pattern in (r"\([^)]*\)", r"\[[^\]]*\]", r"\{[^}]*\}", r"(?U)\b(feat|featuring|ft)\.?\b.*", r"(?U)[^\w\s]", r"(?U)\s+"):
        x = F.regexp_replace(x, pattern, " ")
    return F.trim(x)


def pairs_of(c: Column) -> Column:
    """The pairs of neighbouring characters of a text, its start included; the same pair is numbered each time it comes."""
    s = F.concat(F.lit(START), c)
    each = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))
    numbered = lambda all_: F.transform(all_, lambda p, i: F.concat(p, F.size(F.filter(F.slice(all_, F.lit(1), i), lambda q: q == p)).cast("string")))
    one = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(one(one(s, each), numbered))


def in_common(a: Column, b: Column) -> Column:
    """How many characters two texts have in common, in any order: at least as many as their blocks match."""
    n = lambda x, c: F.length(x) - F.length(F.replace(x, c, F.lit("")))
    return F.aggregate(F.array_distinct(F.filter(F.split(a, ""), lambda c: c != "")), F.lit(0), lambda acc, c: acc + F.least(n(a, c), n(b, c)))


def _least_common(length: Column, least: float) -> Column:
    """Common pairs that a text of this length has at least with any text of the ratio; the start counts as one pair more of a text."""
    return F.greatest(F.ceil(length * (2 / (2 - least)) * (1.5 * least - 1) - 1 - 1e-9), F.lit(1)).cast("int")


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of distinct texts of ``left`` (a) and ``right`` (b) whose rarest pairs, lengths and characters allow the ratio.

    ``least`` must be 0.8 or more: there texts too short for the bound are equal. Empty texts have no partners.
    """
    if least < 0.8:
        raise ValueError("texts of a ratio below 0.8 may share no pair of characters")
    a, b = left.where("a <> ''").distinct(), right.where("b <> ''").distinct()
    often = b.select(F.explode(pairs_of(F.col("b"))).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("often"))

    def rarest(df: DataFrame, c: str) -> DataFrame:
        each = df.select(c, F.explode(pairs_of(F.col(c))).alias("pair")).join(often, "pair", "left")
        ranked = each.groupBy(c).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "pair"))).alias("x"))
        most = F.size("x") - _least_common(F.length(c), least) + 1
        return ranked.select(c, F.explode(F.slice("x", F.lit(1), F.greatest(most, F.lit(1)))).alias("x")).select(c, F.col("x.pair").alias("pair"))

    return _possible(rarest(a, "a").join(rarest(b, "b"), "pair").select("a", "b").distinct(), least)


def _possible(both: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose lengths, and then their characters, allow the ratio."""
    all_ = F.length("a") + F.length("b")
    near = both.where(2 * F.least(F.length("a"), F.length("b")) >= least * all_ - 1e-9)
    return near.where(2 * in_common(F.col("a"), F.col("b")) >= least * all_ - 1e-9)


def holding(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` (exact) with those of ``right`` (whole) that hold their text, joined on its rarest pair of characters; texts of one character on equality."""
    two = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))
    texts = right.select("whole").distinct().where("length(whole) > 1").select("whole", F.explode(two(F.col("whole"))).alias("pair"))
    often = texts.groupBy("pair").agg(F.count(F.lit(1)).alias("often"))
    asked = left.select("exact").distinct().where("length(exact) > 1").select("exact", F.explode(two(F.col("exact"))).alias("pair")).join(often, "pair", "left")
    key = asked.groupBy("exact").agg(F.min_by("pair", F.struct(F.coalesce("often", F.lit(0)), "pair")).alias("pair"))
    found = key.join(texts, "pair").where(F.col("whole").contains(F.col("exact"))).select("exact", "whole")
    single = left.where("length(exact) = 1").select("exact", F.col("exact").alias("whole")).distinct()
    return left.join(found.union(single), "exact").join(right, "whole")


def fuzzy_pairs(left: DataFrame, right: DataFrame, least: float = ARTIST) -> DataFrame:
    """(a, b, ratio) of the texts of ``left`` (a) and ``right`` (b) whose ratio of matching blocks is ``least`` or more."""
    return candidates(left, right, least).withColumn("ratio", fuzzy_ratio("a", "b")).where(F.col("ratio") >= least)


def resolve_artists(names: DataFrame, artists: DataFrame) -> DataFrame:
    """(name, artist_id, artist, score) of the distinct names that mean a known artist.

    A name but for case is meant first (score 1). Else it is the artist of the highest ratio of normalised names, ARTIST or more, whose name
    holds the first word; ties take the least artist_id. Null and blank names mean none. High ratios, which few pairs are compared
    for, are tried first: only names without an artist there go on to lower ones.
    """
    asked = names.select("name").where("trim(name) <> ''").distinct().withColumns({"exact": F.lower(F.trim("name")), "a": normal(F.trim("name"))})
    known = artists.select("artist_id", F.col("name").alias("artist"), F.lower("name").alias("exact"), normal(F.col("name")).alias("b"))
    same = asked.join(known.groupBy("exact").agg(F.min(F.struct("artist_id", "artist")).alias("k")), "exact").select("name", "k.artist_id", "k.artist", F.lit(1.0).alias("score"))
    rest = materialize(asked.join(same.select("name"), "name", "left_anti").where("a <> ''"), "names")
    found = [same]

    def best(near: DataFrame) -> DataFrame:
        """Of (name, a, ratio, b) each name's artist, settled for good: nothing below the ratios that were looked at beats it."""
        met = near.join(known.drop("exact"), "b").where(F.lower("artist").contains(F.substring_index("a", " ", 1)))
        least = met.groupBy("name").agg(F.min(F.struct((-F.col("ratio")).alias("less"), "artist_id", "artist")).alias("k"))
        return materialize(least.select("name", "k.artist_id", "k.artist", (-F.col("k.less")).alias("score")), "resolved")

    # Equal normalised names have ratio 1, the highest: they are joined by equality, and only what is left is compared.
    for bound in (1.0, *TRIED, ARTIST):
        if rest.isEmpty():
            break
        near = rest.select("name", "a", F.lit(1.0).alias("ratio"), F.col("a").alias("b")) if bound == 1 else rest.join(fuzzy_pairs(rest.select("a"), known.select("b"), bound), "a")
        found.append(best(near))
        rest = materialize(rest.join(found[-1].select("name"), "name", "left_anti"), "names")
    return reduce(lambda x, y: x.union(y), found)


def resolve_albums(asked: DataFrame, albums: DataFrame) -> DataFrame:
    """(title, artist, album_id, score) of the distinct (title, artist) that mean a stored album (album_id, title, artist_name).

    The title but for case, and the artist where one is given, is meant first (score 1). Else it is the album whose title holds the asked one
    and whose ratios, TITLE_WEIGHT for the title and ARTIST_WEIGHT for the artist (1 where none is given), make the most, ALBUM or more;
    ties take the least album_id. Null and blank titles mean none.
    """
    want = asked.select(F.trim("title").alias("title"), F.nullif(F.trim("artist"), F.lit("")).alias("artist")).where("title <> ''").distinct()
    want = want.withColumns({"exact": F.lower("title"), "a": normal(F.col("title"))})
    known = albums.where("title IS NOT NULL").select("album_id", "artist_name", F.lower("title").alias("whole"), normal(F.col("title")).alias("b"))
    artist = F.col("artist").isNull() | (F.lower("artist") == F.lower("artist_name"))
    same = want.join(known.withColumnRenamed("whole", "exact"), "exact").where(artist).groupBy("title", "artist").agg(F.min("album_id").alias("album_id")).withColumn("score", F.lit(1.0))
    met = same.select(F.col("title").alias("__title"), F.col("artist").alias("__artist"))
    left = want.join(met, (F.col("title") == F.col("__title")) & F.col("artist").eqNullSafe(F.col("__artist")), "left_anti")
    least = (ALBUM - ARTIST_WEIGHT) / TITLE_WEIGHT
    near = _possible(holding(left, known), least).withColumn("ratio", fuzzy_ratio("a", "b"))
    own = F.when(F.col("artist").isNull(), 1.0).otherwise(fuzzy_ratio(normal(F.col("artist")), normal(F.col("artist_name"))))
    scored = near.withColumn("score", TITLE_WEIGHT * F.col("ratio") + ARTIST_WEIGHT * own).where(F.col("score") >= ALBUM)
    best = scored.groupBy("title", "artist").agg(F.min(F.struct((-F.col("score")).alias("less"), "album_id")).alias("k"))
    return same.select("title", "artist", "album_id", "score").union(best.select("title", "artist", "k.album_id", -F.col("k.less")))


def album_fits(asked: Column, release: Column) -> Column:
    """The album gate of a recording match: its release's title must be like the album that was asked for; without one, any is fine."""
    given = F.trim(F.coalesce(asked, F.lit(""))) != ""
    return ~given | F.coalesce(fuzzy_ratio(normal(asked), normal(release)) >= RELEASE, F.lit(False))

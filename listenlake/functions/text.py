"""Text matching for titles and artists: trigrams, normalisers, fuzzy ratios and file names."""

from __future__ import annotations

import difflib
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType

from listenlake.functions import filenames
from listenlake.functions.filenames import parse_filename, parsed_filenames  # noqa: F401
from listenlake.runtime import materialize


def trigrams(c: str | Column) -> Column:
    """Distinct trigrams of the words of a text: lower case, each word with two spaces before and one after."""
    c = F.col(c) if isinstance(c, str) else c
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w]+|_"), lambda w: w != "")
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, grams)))


def similarity(a: str | Column, b: str | Column) -> Column:
    """Shared share of two texts' trigrams; 0 if neither has any."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def _gram_sets(df: DataFrame, key: str, text: str, side: str) -> DataFrame:
    return df.select(F.col(key).alias(f"{side}_key"), trigrams(text).alias(f"{side}_g")).where(F.size(f"{side}_g") > 0)


#: By how much sizes of sets differ at most that share a class, as a factor.
SIZES = 1.1


def _class(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(SIZES))).cast("int")


def candidate_pairs(l: DataFrame, r: DataFrame, least: float) -> DataFrame:
    """Rows (l_key, l_g, r_key, r_g) of two frames of trigram sets that share one of their rarest trigrams, some more than once.

    Sets of n and m trigrams that share ``least`` of their union have t = least / (1 + least) * (n + m) in common, and so share one of the n - t + 1
    and m - t + 1 rarest of either. The left set's are taken for each class of sizes that the right one may have, so that
    trigrams that many names hold, which come last, make candidates only where sets have little else.
    """
    often = r.select(F.explode("r_g").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    shared = lambda n, m: F.ceil((n + m) * (least / (1 + least)) - 1e-9)

    def ranked(df: DataFrame, side: str) -> DataFrame:
        each = df.select("*", F.explode(f"{side}_g").alias("gram")).join(often, "gram", "left")
        sorted_ = each.groupBy(f"{side}_key", f"{side}_g").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram"))).alias("x"))
        return sorted_.withColumn(f"{side}_n", F.size(f"{side}_g"))

    def rarest(df: DataFrame, side: str, most: Column) -> DataFrame:
        names = [f"{side}_key", f"{side}_g", f"{side}_n", "sizes"]
        return df.where(most > 0).select(*names, F.posexplode(F.slice("x", F.lit(1), most.cast("int"))).alias(f"{side}_at", "x")).select(*names, f"{side}_at", F.col("x.gram").alias("gram"))

    n, m = F.col("l_n"), F.col("r_n")
    right = ranked(r, "r").withColumn("sizes", _class(m))
    there = r.select(_class(F.size("r_g")).alias("sizes")).distinct()
    left = ranked(l, "l").withColumn("sizes", F.explode(F.sequence(_class(F.greatest(F.ceil(n * least - 1e-9), F.lit(1))), _class(F.floor(n / least + 1e-9))))).join(F.broadcast(there), "sizes", "left_semi")
    lower = F.floor(F.pow(F.lit(SIZES), F.col("sizes")))  # no set of the class is smaller
    both = rarest(left, "l", n - shared(n, lower) + 1).join(rarest(right, "r", m - F.ceil(m * least - 1e-9) + 1), ["gram", "sizes"])
    t = shared(n, m)
    return both.where((F.col("l_at") <= n - t) & (F.col("r_at") <= m - t)).select("l_key", "l_g", "r_key", "r_g")


def _similar(l: DataFrame, r: DataFrame, least: float) -> DataFrame:
    """(l_key, r_key, similarity) of the candidates that are as similar as ``least``, rounded to six places."""
    s = F.size(F.array_intersect("l_g", "r_g")) / F.size(F.array_union("l_g", "r_g"))
    pairs = candidate_pairs(l, r, least - 5e-7).select("l_key", "r_key", F.round(s, 6).alias("similarity"))
    return pairs.where(F.col("similarity") >= least).distinct()


def similar_pairs(left: DataFrame, right: DataFrame, l_key: str, r_key: str, l_text: str, r_text: str, least: float = 0.3) -> DataFrame:
    """Pairs of rows whose texts' similarity is ``least`` or more, joined on their rarest trigrams; null or wordless texts have none."""
    return _similar(_gram_sets(left, l_key, l_text, "l"), _gram_sets(right, r_key, r_text, "r"), least)


#: Thresholds that a search for the most similar rows tries before its own.
TRIED = (0.8, 0.55)


def most_similar(left: DataFrame, right: DataFrame, l_key: str, r_key: str, l_text: str, r_text: str, n: int = 10, least: float = 0.3) -> DataFrame:
    """The ``n`` most similar rows of ``right`` for each row of ``left``, of similarity ``least`` or more; ties keep the least keys.

    High thresholds, which few trigrams are joined for, are tried first: a row that finds n answers there is done, and
    only the others go on to lower ones.
    """
    rows, r = materialize(_gram_sets(left, l_key, l_text, "l"), "asked"), materialize(_gram_sets(right, r_key, r_text, "r"), "grams")
    top = Window.partitionBy("l_key").orderBy(F.desc("similarity"), "r_key")
    done = []
    for bound in [b for b in TRIED if b > least] + [least]:
        found = _similar(rows, r, bound).withColumn("__no", F.row_number().over(top)).where(F.col("__no") <= n)
        found = materialize(found, "similar")
        if bound == least:
            done.append(found)
            break
        full = found.groupBy("l_key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= n).select("l_key")
        done.append(found.join(full, "l_key", "left_semi"))
        rows = materialize(rows.join(full, "l_key", "left_anti"), "asked")
        if rows.isEmpty():
            break
    return reduce(lambda x, y: x.union(y), done).drop("__no")


def normalize_title(c: str | Column) -> Column:
    """Without bracketed parts, featured artists and punctuation; lower case, spaces collapsed."""
    c = F.col(c) if isinstance(c, str) else c
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\(\[\{][^\)\]\}]*[\)\]\}]", " ")
    x = F.regexp_replace(x, r"(?i)\s+(feat|ft|featuring)\b.*$", " ")
    x = F.regexp_replace(x, r"(?U)[^\w\s]", " ")
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts, lower-cased; 0 if either is null or empty."""
    return pd.Series([difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


@F.pandas_udf(StringType())
def fold_accents(a: pd.Series) -> pd.Series:
    """Compatibility-decomposed text without combining marks."""
    return a.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


#: How many rare trigrams make a key together, and up to how many of which keys are made so.
TOGETHER = ((3, 6), (2, 12))


def _together(held: Column, n: int) -> Column:
    """All sets of ``n`` of an array's structs (at, often, gram) in their order, as structs (key, at): their trigrams and the last one's place."""
    rest = lambda i: F.slice(held, i + 1, F.size(held))  # noqa: E731  what follows the first i
    key = lambda *grams: F.struct(F.concat(*[g["gram"] for g in grams]).alias("key"), grams[-1]["at"].alias("at"))
    if n == 1:
        return F.transform(held, lambda a: key(a))
    if n == 2:
        return F.flatten(F.transform(held, lambda a, i: F.transform(rest(i + 1), lambda b: key(a, b))))
    return F.flatten(F.transform(held, lambda a, i: F.flatten(F.transform(rest(i + 1), lambda b, j: F.transform(rest(i + j + 2), lambda c: key(a, b, c))))))


def close_candidates(l: DataFrame, r: DataFrame, least: float) -> DataFrame:
    """Rows (l_key, l_g, r_key, r_g) of two frames of trigram sets that share some of their rarest trigrams together, some more than once.

    Sets of n and m trigrams with t in common share the k rarest of those, and these are among the n - t + k and m - t + k rarest of either. As many
    as three together make a key, as far as that keeps a set's keys few, so that names that share a few trigrams with many others make few candidates.
    """
    often = r.select(F.explode("r_g").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    n, m, no = F.col("l_n"), F.col("r_n"), F.col("sizes")
    alone = lambda size: F.ceil(size * least - 1e-9)  # noqa: E731  what a set of a size has in common with any
    shared = lambda x, y: F.ceil((x + y) * (least / (1 + least)) - 1e-9)
    lower, upper = F.floor(F.pow(F.lit(SIZES), no)), F.ceil(F.pow(F.lit(SIZES), no + 1))  # sizes of a class
    together = F.lit(1)
    for k, most in reversed(TOGETHER):
        together = F.when((alone(lower) >= k) & (upper - alone(upper) + 1 <= most), k).otherwise(together)

    def ranked(df: DataFrame, side: str) -> DataFrame:
        each = df.select(f"{side}_key", F.explode(f"{side}_g").alias("gram")).join(often, "gram", "left")
        x = F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram"))).alias("x")
        return each.groupBy(f"{side}_key").agg(x).withColumn(f"{side}_n", F.size("x"))

    def keyed(df: DataFrame, side: str, rarest: Column) -> DataFrame:
        """A row for each key of a set among its ``rarest`` trigrams and one less than make a key; trigrams that no name has make none."""
        placed = F.transform(F.slice("x", F.lit(1), (rarest + F.col("k") - 1).cast("int")), lambda v, i: F.struct(i.alias("at"), v["often"].alias("often"), v["gram"].alias("gram")))
        some = df.withColumn("k", together).where(rarest > 0).withColumn("held", F.filter(placed, lambda v: v["often"] > 0)).where("size(held) >= k")
        keys = F.when(F.col("k") == 3, _together(F.col("held"), 3)).when(F.col("k") == 2, _together(F.col("held"), 2)).otherwise(_together(F.col("held"), 1))
        each = some.select(f"{side}_key", f"{side}_n", F.col("x.gram").alias(f"{side}_g"), "sizes", "k", F.explode(keys).alias("key"))
        return each.select(f"{side}_key", f"{side}_n", f"{side}_g", "sizes", "k", "key.key", F.col("key.at").alias(f"{side}_at"))

    there = r.select(_class(F.size("r_g")).alias("sizes")).distinct()  # a row a class
    near = F.explode(F.sequence(_class(F.greatest(alone(n), F.lit(1))), _class(F.floor(n / least + 1e-9))))
    asked = keyed(ranked(l, "l").withColumn("sizes", near).join(F.broadcast(there), "sizes", "left_semi"), "l", n - shared(n, lower) + 1)
    both = asked.join(keyed(ranked(r, "r").withColumn("sizes", _class(m)), "r", m - alone(m) + 1).drop("k"), ["key", "sizes"])
    last = shared(n, m) - F.col("k") + 1
    return both.where((F.col("l_at") <= n - last) & (F.col("r_at") <= m - last)).select("l_key", "l_g", "r_key", "r_g")


def close_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(text, name, similarity) of texts of ``left`` and names of ``right`` that are ``least`` or more similar, joined by :func:`close_candidates`."""
    pairs = close_candidates(_gram_sets(left.distinct(), "text", "text", "l"), _gram_sets(right.distinct(), "name", "name", "r"), least)
    met = pairs.withColumn("same", F.size(F.array_intersect("l_g", "r_g")))
    s = F.col("same") / (F.size("l_g") + F.size("r_g") - F.col("same"))
    return met.select(F.col("l_key").alias("text"), F.col("r_key").alias("name"), s.alias("similarity")).where(F.col("similarity") >= least).distinct()


def known_filenames(names: DataFrame, artists: DataFrame, key: str = "sha_id", name: str = "name") -> DataFrame:
    """(key, artist, title, confidence): guesses at file names, with artists looked up by :func:`close_pairs`."""
    return filenames.known_filenames(names, artists, close_pairs, key, name)

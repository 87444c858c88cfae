"""Column expressions shared by the queries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNKNOWN_ARTIST = "Unknown Artist"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def format_duration(ms: str | Column) -> Column:
    """Milliseconds as 0m, 42s, 7m, 3h 5m or 2d 4h."""
    s = F.floor(_c(ms) / 1000).cast("long")
    m, h = F.floor(s / 60).cast("long"), F.floor(s / 3600).cast("long")
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return (
        F.when(_c(ms).isNull() | (_c(ms) == 0), "0m")
        .when(s < 60, text(s, "s"))
        .when(m < 60, text(m, "m"))
        .when(h < 24, F.concat(text(h, "h "), text(m % 60, "m")))
        .otherwise(F.concat(text(F.floor(h / 24).cast("long"), "d "), text(h % 24, "h")))
    )


def format_storage(size: str | Column) -> Column:
    """Bytes as B, KB, MB (one decimal) or GB (two), to the base 1024."""
    b = _c(size).cast("double")
    return (
        F.when(b < 1024, F.concat(_c(size).cast("long").cast("string"), F.lit(" B")))
        .when(b < 1024**2, F.format_string("%.1f KB", b / 1024))
        .when(b < 1024**3, F.format_string("%.1f MB", b / 1024**2))
        .otherwise(F.format_string("%.2f GB", b / 1024**3))
    )


def percent(part: str | Column, total: str | Column, digits: int = 1) -> Column:
    """Share in percent; a total of 0 counts as 1."""
    return F.round(_c(part) * F.lit(100.0) / F.greatest(_c(total), F.lit(1)), digits)


def percent_change(now: str | Column, before: str | Column) -> Column:
    """Change in percent; from 0 it is 100 if there is anything now, else 0."""
    n, b = _c(now).cast("double"), _c(before).cast("double")
    return F.when(b == 0, F.when(n > 0, 100.0).otherwise(0.0)).otherwise(F.round((n - b) / F.nullif(b, F.lit(0.0)) * 100, 1))


def album_id(title: str | Column, artist: str | Column) -> Column:
    """Album id of a title and its primary artist; null for an empty title or no artist."""
    t, a = _c(title), _c(artist)
    return F.when(t.isNotNull() & (t != "") & a.isNotNull(), F.md5(F.concat(F.lower(t), F.lit("::"), F.lower(a))))


def album_key(title: str | Column, artist: str | Column) -> Column:
    """Lower-cased title::artist with white space collapsed; '' for an empty title."""
    flat = lambda x: F.lower(F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"\s+", " ")))
    return F.when(flat(title) == "", F.lit("")).otherwise(F.concat(flat(title), F.lit("::"), flat(artist)))


def bins(value: str | Column, edges: list[tuple[float, str]], rest: str) -> Column:
    """Label of the first edge that the value is below; null stays null."""
    v = _c(value)
    out = F.when(v.isNull(), None)
    for edge, label in edges:
        out = out.when(v < edge, label)
    return out.otherwise(rest)


def day_of_week(ts: str | Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return (F.dayofweek(_c(ts)) - 1).cast("int")


def mean(c: str | Column, digits: int) -> Column:
    """The mean of a non-negative column, rounded half up, from exact sums of millionths: the same however the rows are partitioned."""
    c = F.col(c) if isinstance(c, str) else c
    total, n, unit = F.sum(F.round(c * 1_000_000).cast("long")), F.count(c), 10 ** (6 - digits)
    return F.when(n > 0, F.call_function("div", 2 * total + n * unit, 2 * n * unit) / float(10**digits))


def exact_mean(c: str | Column) -> Column:
    """The mean of a column as written in decimals, to twelve places a value: equal means are equal, whatever order their values come in.

    Groups with values of a million or more, infinite or not a number, take the mean of doubles.
    """
    c = F.col(c) if isinstance(c, str) else c
    written = c.try_cast("decimal(18,12)")
    return F.when(F.count(written) == F.count(c), F.sum(written).cast("double") / F.count(c)).otherwise(F.avg(c))

"""Sessions, streaks and running totals by window functions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from listenlake.catalog import Catalog
from listenlake.runtime import materialize

GAP = timedelta(minutes=30)


def positions(df: DataFrame, keys: list, name: str, kind: str = "int") -> DataFrame:
    """``df`` with 0-based places in the order of ``keys``, numbered in parallel.

    Rows are written in sorted ranges of the keys, with their places in their own range; the ranges before it add theirs.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    stored = materialize(ranged, "positions")
    part, own = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))  # as monotonically_increasing_id is documented
    sizes = stored.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # a row a range
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    # As many rows as the shuffle has partitions: small enough to broadcast at any size of df.
    numbered = stored.withColumn("__part", part).join(F.broadcast(before), "__part")
    return numbered.withColumn(name, (F.col("__before") + own).cast(kind)).drop("__part", "__at", "__before")


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _session_keys_by_user(rows: DataFrame, gap: Column) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("started_at", "session_id")
    new = F.coalesce((_micros(F.col("started_at")) - _micros(F.lag("until").over(order)) > gap).cast("int"), F.lit(1))
    peers = Window.partitionBy("user_id").orderBy("started_at").rangeBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("new", new).withColumn("no", F.sum("new").over(peers))


def _session_keys_in_ranges(rows: DataFrame, gap: Column) -> DataFrame:
    """All plays as one sequence: ``no`` is the time of the last break at or before a play.

    Plays are ordered in ranges of their start. A range's first play takes the end of the play before it from the range before, and
    its plays before the range's own first break take the last break of the ranges before. Both come from a table of a row a range. Plays of
    one start share a session, also where a border parts them: a break at that very time in a later range counts for them too.
    """
    ranged = materialize(rows.repartitionByRange("started_at", "session_id").withColumn("part", F.spark_partition_id()), "ranges")
    ranges = Window.orderBy("part")  # over a row a range
    ends = ranged.groupBy("part").agg(F.max_by("until", F.struct("started_at", "session_id")).alias("until"))
    ends = ends.select("part", F.lag("until").over(ranges).alias("earlier_until"))
    order = Window.partitionBy("part").orderBy("started_at", "session_id")
    previous = F.when(F.row_number().over(order) == 1, F.col("earlier_until")).otherwise(F.lag("until").over(order))
    pause = _micros(F.col("started_at")) - _micros(previous)
    marked = ranged.join(F.broadcast(ends), "part").withColumn("break", F.when(F.coalesce(pause > gap, F.lit(True)), F.col("started_at")))
    marked = materialize(marked.drop("earlier_until"), "breaks")
    summary = marked.groupBy("part").agg(F.min("started_at").alias("first"), F.max("started_at").alias("last"), F.min("break").alias("first_break"), F.max("break").alias("last_break"))
    late = summary.where("first_break = first").groupBy(F.col("first").alias("last")).agg(F.max("part").alias("late_part"))
    carried = F.max("last_break").over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("carried")
    carry = summary.select("part", "last", carried).join(late, "last", "left").select("part", "carried", F.when(F.col("late_part") > F.col("part"), F.col("last")).alias("late"))
    own = F.max("break").over(Window.partitionBy("part").orderBy("started_at").rangeBetween(Window.unboundedPreceding, 0))
    keyed = marked.withColumn("own", own).join(F.broadcast(carry), "part")
    return keyed.withColumn("no", F.greatest("own", "carried", F.when(F.col("late") == F.col("started_at"), F.col("late"))))


def listening_sessions(plays: DataFrame, by_user: bool = True, gap: timedelta = GAP) -> DataFrame:
    """Runs of plays whose pauses are no longer than ``gap``, measured from the previous play's end (start, if it has none).

    ``by_user`` keeps users apart, and so the sorts in parallel. Without it all plays form one sequence, as for the
    library of a single listener; it is ordered in ranges of time, each in its own task. Plays with equal starts share a session.
    """
    rows = plays.select(F.col("user_id") if by_user else F.lit(None).cast("long").alias("user_id"), "session_id", "started_at", F.coalesce("ended_at", "started_at").alias("until"), "duration_played_ms", "completed")
    pause = F.lit(int(gap.total_seconds() * 1_000_000))
    numbered = _session_keys_by_user(rows, pause) if by_user else _session_keys_in_ranges(rows, pause)
    out = numbered.groupBy("user_id", "no").agg(
        F.min("started_at").alias("started_at"), F.max("until").alias("ended_at"), F.count(F.lit(1)).cast("long").alias("songs"), F.sum("duration_played_ms").cast("long").alias("duration_ms"), F.count_if("completed").cast("long").alias("completed")
    )
    return out.withColumn("length_ms", F.floor((_micros(F.col("ended_at")) - _micros(F.col("started_at"))) / 1000).cast("long")).drop("no")


def streaks(cat: Catalog) -> DataFrame:
    """Maximal runs of consecutive UTC days with a play that was completed or reached 10 percent."""
    days = cat.play_sessions.where("completed OR completion_percent >= 10").select(F.to_date("started_at").alias("d")).distinct()
    # Days are few however many plays there are: one task orders at most a row a day.
    island = days.withColumn("k", F.date_sub("d", F.row_number().over(Window.orderBy("d"))))
    return island.groupBy("k").agg(F.min("d").alias("start_date"), F.max("d").alias("end_date"), F.count(F.lit(1)).cast("long").alias("length_days")).drop("k")


def current_and_longest_streak(cat: Catalog, as_of: datetime) -> DataFrame:
    """One row: the longest streak, and the one that still runs (its last day is as_of's or the day before)."""
    yesterday = F.lit(as_of.date() - timedelta(days=1))
    s = streaks(cat)
    return s.agg(
        F.coalesce(F.max(F.when((F.col("end_date") >= yesterday) & (F.col("start_date") <= F.lit(as_of.date())), F.col("length_days"))), F.lit(0)).cast("long").alias("current_streak"),
        F.coalesce(F.max("length_days"), F.lit(0)).cast("long").alias("longest_streak"),
    )


def running_total(counts: DataFrame, key: str, value: str, name: str = "running_total") -> DataFrame:
    """``counts`` with the running total of ``value`` in the order of ``key``; for pre-aggregated tables of few rows."""
    return counts.withColumn(name, F.sum(value).over(Window.orderBy(key).rangeBetween(Window.unboundedPreceding, 0)).cast("long"))

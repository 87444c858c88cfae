"""Many playlists at once: all rules over one frame of songs, their members in order, and the tables that hold them."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from listenlake.operators import rules as R
from listenlake.operators.windows import positions
from listenlake.runtime import discard, materialize

MEMBERS = "sha_id string, position int, playlist_id string"
STATS = "song_count long, total_duration_sec long, playlist_id string"


def _key(c: R.Condition) -> str:
    return json.dumps([c.field, c.op, c.value], default=str, sort_keys=True)


def _with_conditions(k: R.Compiler, conditions: Iterable[R.Condition]) -> tuple[DataFrame, dict[str, Column]]:
    """The songs with whatever the conditions need, and each condition as a column.

    All conditions on one bridge table are flags of one aggregation, and each other frame of songs is joined once,
    however many rules use it: plays, features and bridges are each read once.
    """
    df, columns, bridges, frames = k.subjects(), {}, {}, {}
    for c in {_key(c): c for c in conditions}.values():
        _, source, name = R.FIELDS[c.field]
        if source == "bridge" and c.op != "same_as":
            bridges.setdefault(name, []).append(c)
            continue
        column, ids, negated = k._holds(c)
        if ids is None:
            columns[_key(c)] = column
            continue
        place = f"{source} {name}" if source in ("exists", "set") and c.op != "top_n" else _key(c)
        if place not in frames:
            frames[place] = f"__in{len(frames)}"
            df = df.join(ids.select("sha_id").distinct().withColumn(frames[place], F.lit(True)), "sha_id", "left")
        has = F.coalesce(F.col(frames[place]), F.lit(False))
        columns[_key(c)] = ~has if negated else has
    for name, own in bridges.items():
        flags = [F.max(F.coalesce(R.OPS[c.op].column(F.col(name), c.value, k.as_of), F.lit(False))).alias(f"__{name}{i}") for i, c in enumerate(own)]
        df = df.join(k._bridge(name).groupBy("sha_id").agg(*flags), "sha_id", "left")
        columns |= {_key(c): F.coalesce(F.col(f"__{name}{i}"), F.lit(False)) for i, c in enumerate(own)}
    return df, columns


def _column(g: R.Group, columns: dict[str, Column]) -> Column | None:
    """A rule as one column; None if it says nothing, and so matches every song."""
    parts = [_column(p, columns) if isinstance(p, R.Group) else columns[_key(p)] for p in g.parts]
    parts = [p for p in parts if p is not None]
    return reduce((lambda a, b: a & b) if g.match == "all" else (lambda a, b: a | b), parts) if parts else None


def matched(k: R.Compiler, rules: dict[str, R.Group]) -> DataFrame:
    """The songs that match any of the rules, a row each, with ``__lists``: the places of the matching rules in ``rules``."""
    df, columns = _with_conditions(k, [c for g in rules.values() for c in R.leaves(g)])
    tests = []
    for i, g in enumerate(rules.values()):
        column = _column(g, columns)
        tests.append(F.when(F.lit(True) if column is None else column, F.lit(i)))
    return df.withColumn("__lists", F.array_compact(F.array(*tests))).where(F.size("__lists") > 0)


def counts(k: R.Compiler, rules: dict[str, R.Group]) -> DataFrame:
    """(rule, songs): how many songs each rule matches, none included."""
    names = k.cat.spark.createDataFrame(list(enumerate(rules)), "list int, rule string")
    by = matched(k, rules).select("sha_id", F.explode("__lists").alias("list")).groupBy("list").agg(F.count_distinct("sha_id").alias("songs"))
    return names.join(by, "list", "left").select("rule", F.coalesce("songs", F.lit(0)).cast("long").alias("songs"))


def _sort_keys(playlists: list[dict], seed: int) -> list[tuple[str, Column]]:
    """Named keys that put each playlist's songs in its own order: missing last, numbers negated where they fall, texts by direction."""
    numbers, texts, falling = {}, {}, [i for i, p in enumerate(playlists) if str(p.get("sort_order") or "desc").lower() != "asc"]
    for i, p in enumerate(playlists):
        name = {"added_at": "created_at", "completion_rate": "avg_completion"}.get(p.get("sort_by"), p.get("sort_by")) if p.get("sort_by") in R.SORTS else "created_at"
        (texts if name in ("title", "artist", "album") else numbers).setdefault(name, []).append(i)
    time = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    value = lambda c: F.rand(seed) if c == "random" else time(c) if c in ("created_at", "last_played") else F.coalesce(F.col(c), F.lit(0)) if c in ("release_year", "duration_sec") else F.col(c)
    of = lambda by, get, kind: F.coalesce(*[F.when(F.col("list").isin(own), get(c).cast(kind)) for c, own in by.items()], F.lit(None).cast(kind))
    number, text, down = of(numbers, value, "double"), of(texts, F.col, "string"), F.col("list").isin(falling)
    return [
        ("__missing", (number.isNull() & text.isNull()).cast("int")), ("__number", F.when(down, -number).otherwise(number)),
        ("__rising", F.when(~down, text)), ("__falling", F.when(down, text)),
    ]


def members_of(k: R.Compiler, playlists: list[dict], seed: int = 7) -> DataFrame:
    """(playlist_id, sha_id, position, duration_sec) of all playlists in one pass over the tables.

    A playlist has playlist_id, rules, and perhaps sort_by, sort_order and limit_count. Songs are ordered by playlist and its own
    keys in ranges, so neither many playlists nor one of all songs meets in one task; nulls come last, ties by id.
    """
    rules = {p["playlist_id"]: R.parse(p["rules"]) for p in playlists}
    rows = matched(k, rules)
    if any(p.get("sort_by") == "artist" for p in playlists):
        rows = rows.join(k._bridge("artist").groupBy("sha_id").agg(F.array_join(F.array_sort(F.collect_set("artist")), ", ").alias("artist")), "sha_id", "left")
    keys = _sort_keys(playlists, seed)
    each = rows.withColumn("list", F.explode("__lists")).withColumns(dict(keys)).select("list", "sha_id", "duration_sec", *[n for n, _ in keys])
    order = [F.col("list"), F.col("__missing"), F.col("__number"), F.col("__rising").asc_nulls_last(), F.col("__falling").desc_nulls_last(), F.col("sha_id")]
    placed = positions(each, order, "place", "long")
    first = placed.groupBy("list").agg(F.min("place").alias("first"))
    named = k.cat.spark.createDataFrame([(i, p["playlist_id"], p.get("limit_count")) for i, p in enumerate(playlists)], "list int, playlist_id string, most long")
    own = placed.join(F.broadcast(first), "list").join(F.broadcast(named), "list")  # a row a playlist
    return own.withColumn("position", (F.col("place") - F.col("first")).cast("int")).where("most IS NULL OR most = 0 OR position < most").select("playlist_id", "sha_id", "position", "duration_sec")


def stats_of(spark: SparkSession, members: DataFrame, ids: list[str]) -> DataFrame:
    """(playlist_id, song_count, total_duration_sec) of each of ``ids``, those without songs included."""
    by = members.groupBy("playlist_id").agg(F.count(F.lit(1)).alias("song_count"), F.sum("duration_sec").cast("long").alias("total_duration_sec"))
    asked = spark.createDataFrame([(i,) for i in ids], "playlist_id string")
    return asked.join(by, "playlist_id", "left").na.fill({"song_count": 0, "total_duration_sec": 0})


def _write(k: R.Compiler, playlists: list[dict], path: str) -> None:
    """Replace the playlists' members at ``path`` and their stats at ``path``_stats; a playlist that lost all songs loses its partition."""
    spark, ids = k.cat.spark, [p["playlist_id"] for p in playlists]
    members = materialize(members_of(k, playlists), "members")
    stats = materialize(stats_of(spark, members, ids), "stats")
    put = lambda df, at: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("playlist_id").parquet(at)
    put(members.select("playlist_id", "sha_id", "position").repartition("playlist_id"), path)
    put(stats, f"{path}_stats")
    for r in stats.where("song_count = 0").select("playlist_id").collect():  # a row a playlist
        folder = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("playlist_id", r.playlist_id)
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    discard(members, stats)


def refresh(k: R.Compiler, playlist: dict, path: str) -> DataFrame:
    """Materialise one playlist and its stats; its members. A template can't be refreshed."""
    if playlist.get("is_template"):
        raise R.RuleError(f"{playlist['playlist_id']} is a template")
    _write(k, [playlist], path)
    return k.cat.spark.read.schema(MEMBERS).parquet(path).where(F.col("playlist_id") == playlist["playlist_id"])


def _refused(k: R.Compiler, rules: dict[str, R.Group]) -> dict[str, str]:
    """Rules that the tables' columns refuse, with the reason; nothing is run."""
    df, columns = _with_conditions(k, [c for g in rules.values() for c in R.leaves(g)])
    out = {}
    for name, g in rules.items():
        column = _column(g, columns)
        try:
            if column is not None:
                df.where(column)
        except Exception as e:  # noqa: BLE001  whatever fails in one playlist is its own
            out[name] = str(e) or type(e).__name__
    return out


def refresh_all(k: R.Compiler, playlists: list[dict], path: str) -> dict[str, str]:
    """Refresh all playlists that aren't templates in one pass; by id, "ok" or what failed.

    A rule that isn't well-formed, or that the tables' columns refuse, is left out and the others go on. If the pass itself fails,
    each playlist is refreshed alone, so that only those at fault are noted.
    """
    out, good = {}, {}
    for p in playlists:
        if not p.get("is_template"):
            try:
                good[p["playlist_id"]] = p, R.parse(p["rules"])
            except Exception as e:  # noqa: BLE001
                out[p["playlist_id"]] = str(e) or type(e).__name__
    try:
        out |= _refused(k, {i: g for i, (_, g) in good.items()})
        fine = [p for i, (p, _) in good.items() if i not in out]
        if fine:
            _write(k, fine, path)
        out |= {p["playlist_id"]: "ok" for p in fine}
    except Exception:  # noqa: BLE001
        for i, (p, _) in good.items():
            try:
                _write(k, [p], path)
                out[i] = "ok"
            except Exception as e:  # noqa: BLE001
                out[i] = str(e) or type(e).__name__
    return out

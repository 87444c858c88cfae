"""Materialised views in parts by month, renewed only where plays changed, and swapped as a whole.

A refresh writes the parts that it touches into new folders and then puts one new manifest beside them, which names the folder of every
part of every view. Readers take the latest manifest, so they see all of a refresh or nothing of it; a writer that fails, or that another one
overtakes, leaves no manifest. Folders that old manifests name stay until :func:`vacuum`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from listenlake.catalog import Catalog
from listenlake.operators import tables as M


@dataclass(frozen=True)
class View:
    """A view's rows from a catalog; ``unit`` and ``bucket`` where it is grouped by spans of the plays' time."""

    rows: Callable[[Catalog], DataFrame]
    unit: str | None = None
    bucket: str | None = None


VIEWS = {
    "daily": View(lambda c: M.listening_stats(c, "day"), "day", "bucket"),
    "weekly": View(lambda c: M.listening_stats(c, "week"), "week", "bucket"),
    "monthly": View(lambda c: M.listening_stats(c, "month"), "month", "bucket"),
    "top_songs_monthly": View(M.top_songs_monthly, "month", "month"),
    "songs_with_features": View(M.songs_with_features),
}
ALL = "all"  # the only part of a view without time
NONE = "0000-00"  # the part of plays without a start


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _manifests(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _fs(spark, f"{root}/manifests")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, root: str, number: int | None = None) -> dict:
    """The latest manifest below ``root``, or one by number: its number, and each view's schema and folders by part."""
    numbers = _manifests(spark, root)
    if not numbers:
        return {"number": 0, "views": {}}
    text = spark.read.text(f"{root}/manifests/{numbers[-1] if number is None else number:08d}.json", wholetext=True).first()[0]
    return json.loads(text)


def _put(spark: SparkSession, root: str, found: dict) -> None:
    """Publish a manifest: written aside, then renamed to its number, which fails where another writer was first."""
    fs, aside = _fs(spark, f"{root}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(json.dumps(found).encode()))
    out.close()
    _, target = _fs(spark, f"{root}/manifests/{found['number']:08d}.json")
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise RuntimeError(f"another refresh published {found['number']} first: refresh again")


def _over(cat: Catalog, plays: DataFrame) -> Catalog:
    """The catalog with other plays."""
    return Catalog(cat.spark, tables=cat._tables | {"play_sessions": plays}, stored=cat._stored, binding=cat._binding, root=cat._root)


def _part(unit: str, at: str = "started_at"):
    return F.coalesce(F.date_format(F.date_trunc(unit, F.col(at)), "yyyy-MM"), F.lit(NONE))


def _plays_of(plays: DataFrame, unit: str, parts: list[str]) -> DataFrame:
    """The plays whose span begins in one of the months; the months' bounds reach the scan."""
    months = [date.fromisoformat(f"{p}-01") for p in parts if p != NONE]
    inside = F.col("started_at").isNull() if NONE in parts else F.lit(False)
    if months:
        first, end = min(months), max(months) + timedelta(days=31 + 7)
        at = lambda d: F.lit(datetime(d.year, d.month, d.day)).cast("timestamp_ntz")
        inside = inside | ((F.col("started_at") >= at(first)) & (F.col("started_at") < at(end)))
    return plays.where(inside & _part(unit).isin(parts))


def refresh_views(cat: Catalog, root: str, changed: DataFrame | None = None, views: dict[str, View] | None = None) -> dict:
    """Renew the views below ``root`` and publish them together; the new manifest.

    ``changed`` has the ``started_at`` of plays that came, went or were moved since the last refresh: only months in which a
    span of theirs begins are computed and written. Without it, or for a view that is new, all parts are. Views that aren't grouped by time are always renewed.
    """
    spark, views = cat.spark, VIEWS if views is None else views
    old, version = manifest(spark, root), uuid.uuid4().hex
    new = {"number": old["number"] + 1, "views": dict(old["views"])}
    for name, view in views.items():
        known, parts = old["views"].get(name), None
        if view.unit and known and changed is not None:
            parts = sorted(r[0] for r in changed.select(_part(view.unit)).distinct().collect())  # months
            if not parts:
                continue
        rows = view.rows(cat if parts is None else _over(cat, _plays_of(cat.play_sessions, view.unit, parts)))
        part = F.coalesce(F.date_format(F.col(view.bucket), "yyyy-MM"), F.lit(NONE)) if view.bucket else F.lit(ALL)
        folder = f"{root}/{name}/{version}"
        rows.withColumn("__part", part).write.partitionBy("__part").parquet(folder)
        fs, path = _fs(spark, folder)
        written = {s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(path) if s.isDirectory()}
        kept = {p: f for p, f in known["parts"].items() if p not in parts} if parts is not None else {}
        new["views"][name] = {"schema": rows.schema.jsonValue(), "parts": kept | {p: f"{name}/{version}/__part={p}" for p in sorted(written)}}
    _put(spark, root, new)
    return new


def read_view(spark: SparkSession, root: str, name: str, found: dict | None = None) -> DataFrame:
    """A view as the latest manifest has it, or as one read before."""
    view = (found or manifest(spark, root))["views"][name]
    schema = StructType.fromJson(view["schema"])
    paths = [f"{root}/{p}" for p in view["parts"].values()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete folders that none of the last ``keep`` manifests names, and older manifests; what was deleted.

    Not to be run beside a refresh: it would take the folders of one that hasn't published yet for leftovers.
    """
    numbers = _manifests(spark, root)
    live = [manifest(spark, root, n)["views"] for n in numbers[-keep:]]
    used = {f.rsplit("/", 1)[0] for views in live for v in views.values() for f in v["parts"].values()}
    gone = [f"manifests/{n:08d}.json" for n in numbers[:-keep]]
    fs, top = _fs(spark, root)
    for view in fs.listStatus(top):
        if view.isDirectory() and view.getPath().getName() != "manifests":
            name = view.getPath().getName()
            gone += [f"{name}/{s.getPath().getName()}" for s in fs.listStatus(view.getPath()) if f"{name}/{s.getPath().getName()}" not in used]
    for g in gone:
        fs.delete(_fs(spark, f"{root}/{g}")[1], True)
    return sorted(gone)

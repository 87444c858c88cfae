"""Session helpers: shared scratch space, lineage cuts and shipping this package to executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = Path(__file__).resolve().parent


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is named, one is made on this machine if driver and executors are the same process (local tests); a cluster
    must name one.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = getattr(sc, "_listenlake_scratch", None)
        if named is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = "file://" + tempfile.mkdtemp(prefix="listenlake-")
            sc._listenlake_scratch = named
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/listenlake/{label}-{uuid.uuid4().hex}"
    _written(spark).append(path)
    return path


def _written(spark: SparkSession) -> list[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "_listenlake_written"):
        sc._listenlake_written = []
    return sc._listenlake_written


def mark(spark: SparkSession) -> int:
    """A point in the session's scratch tables, for :func:`release`."""
    return len(_written(spark))


def _delete(spark: SparkSession, paths) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the scratch tables made after a mark, but for those that the frames to keep read."""
    used = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for df in keep for f in df.inputFiles()}
    own = _written(spark)[since:]
    _delete(spark, [p for p in own if p.rsplit("/", 1)[-1] not in used])
    _written(spark)[since:] = [p for p in own if p.rsplit("/", 1)[-1] in used]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads it back.

    A written table cuts the lineage and outlives lost executors.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables written by :func:`materialize` once nothing reads them any more."""
    for df in frames:
        _delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a cluster."""
    sc = spark.sparkContext
    if getattr(sc, "_listenlake_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="listenlake-pkg-")) / "listenlake_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(PACKAGE_ROOT.rglob("*.py")):
            z.write(f, f"{PACKAGE_ROOT.name}/{f.relative_to(PACKAGE_ROOT)}")
    sc.addPyFile(str(target))
    sc._listenlake_shipped = True

"""What registered queries share: the time they look back from, and how they are bound to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from listenlake.catalog import Catalog
from listenlake.runtime import ship_package

AS_OF = datetime(2024, 1, 31)
MONTH = "started_at >= TIMESTAMP '2024-01-01' AND started_at < TIMESTAMP '2024-01-31'"
WEEK = "started_at >= TIMESTAMP '2024-01-24' AND started_at < TIMESTAMP '2024-01-31'"
WEEK2 = "started_at >= TIMESTAMP '2024-01-17' AND started_at < TIMESTAMP '2024-01-24'"


def bind(f: Callable[[Catalog], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query over a catalog as one over (spark, sf_dir)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)
        return f(Catalog.testdata(spark, sf_dir))

    return run

"""Periods as half-open time ranges, resolved on the driver from an explicit ``as_of``."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, functions as F

_DAYS = {"week": 7, "month": 30, "year": 365}
BEGINNING = datetime(1, 1, 1)


def parse_period(period: str, as_of: datetime) -> tuple[datetime, datetime]:
    """(start, end) of ``week``, ``month``, ``year`` (back from as_of), ``all``, ``YYYY`` or ``YYYY-MM``; anything else is ``month``.

    A month out of range, such as 2024-13, raises ValueError.
    """
    if period == "all":
        return BEGINNING, as_of
    if re.fullmatch(r"\d{4}", period):
        return datetime(int(period), 1, 1), datetime(int(period) + 1, 1, 1)
    if re.fullmatch(r"\d{4}-\d{2}", period):
        start = datetime(int(period[:4]), int(period[5:]), 1)
        return start, datetime(start.year + start.month // 12, start.month % 12 + 1, 1)
    return as_of - timedelta(days=_DAYS.get(period, 30)), as_of


def days_of(period: str, as_of: datetime) -> int:
    """Whole days of a period, 1 at least."""
    start, end = parse_period(period, as_of)
    return (end - start).days or 1


def within(column: str | Column, start: datetime, end: datetime) -> Column:
    """start <= column < end; literal bounds, so that scans can skip by it."""
    c = F.col(column) if isinstance(column, str) else column
    return (c >= F.lit(start)) & (c < F.lit(end))

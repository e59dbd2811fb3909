"""Driver-side checks of operator arguments.

Formulas are fixed in code and callers only choose conditions, so every
condition is checked here before a job is planned.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Period:
    """Inclusive date range."""

    start: dt.date
    end: dt.date

    def covers(self, track_out: Column) -> Column:
        """Half-open range test on the raw time column, so that it reaches the Parquet scan."""
        return (track_out >= F.lit(self.start)) & (
            track_out < F.lit(self.end + dt.timedelta(days=1))
        )


def parse_day(value: str, field: str) -> dt.date:
    """Accept YYYYMMDD with optional '-' or '/' separators; anything else is an error."""
    if not value:
        raise ValueError(f"{field} is empty")
    digits = str(value).strip().replace("-", "").replace("/", "")
    if not re.fullmatch(r"[0-9]{8}", digits):
        raise ValueError(f"{field} {value!r} is not a date, expected YYYY-MM-DD")
    try:
        return dt.datetime.strptime(digits, "%Y%m%d").date()
    except ValueError as exc:
        raise ValueError(f"{field} {value!r} is not a date, expected YYYY-MM-DD") from exc


def parse_period(start: str, end: str) -> Period:
    period = Period(parse_day(start, "start"), parse_day(end, "end"))
    if period.start > period.end:
        raise ValueError(f"start {period.start} is after end {period.end}")
    return period


def check_overlap(
    steps: DataFrame | None,
    *periods: Period,
    bounds: tuple[dt.date | None, dt.date | None] | None = None,
) -> tuple[Period, ...]:
    """Refuse periods that miss the data; one min/max row comes back to the driver.

    ``bounds`` gives first and last day where they are known, so that no step is read.
    """
    low, high = bounds or steps.agg(
        F.min("track_out_time").cast("date"), F.max("track_out_time").cast("date")
    ).first()
    for period in periods:
        if low is None or period.end < low or period.start > high:
            raise ValueError(
                f"no data in {period.start}..{period.end}; data covers {low}..{high}"
            )
    return periods


def check_limit(limit: int | None) -> int | None:
    """A row limit is kept as given; None means all rows; anything else is an error."""
    if limit is None:
        return None
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise ValueError(f"limit {limit!r} is not a positive number")
    return limit


def choose(value: str, allowed: dict[str, str] | list[str], field: str) -> str:
    """Whitelist check for names that end up in a plan."""
    if value not in allowed:
        raise ValueError(f"{field} {value!r} is not supported; choose from {sorted(allowed)}")
    return value

"""Dates: reference moments on the driver, spans and ages as columns.

Reference moments (``as_of`` and the bounds made from it) are plain
``datetime`` values.  They enter a plan as literals, so every date filter is a
comparison of a bare column with a constant and reaches the parquet scan.
"""

from __future__ import annotations

import calendar
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
MICROS_PER_MINUTE = 60 * MICROS_PER_SECOND
MICROS_PER_HOUR = 60 * MICROS_PER_MINUTE
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def moment(value: datetime | str) -> datetime:
    """``value`` as a naive datetime; text must be ISO formatted."""
    return value if isinstance(value, datetime) else datetime.fromisoformat(value)


def day_start(value: datetime | str) -> datetime:
    return moment(value).replace(hour=0, minute=0, second=0, microsecond=0)


def month_start(value: datetime | str) -> datetime:
    return day_start(value).replace(day=1)


def days_before(value: datetime | str, days: float) -> datetime:
    return moment(value) - timedelta(days=days)


def shift_months(value: datetime | str, months: int) -> datetime:
    """Add months; the last day of a month stays the last day, time is kept."""
    at = moment(value)
    index = at.year * 12 + at.month - 1 + months
    year, month = divmod(index, 12)
    last_there = calendar.monthrange(year, month + 1)[1]
    last_here = calendar.monthrange(at.year, at.month)[1]
    day = last_there if at.day == last_here else min(at.day, last_there)
    return at.replace(year=year, month=month + 1, day=day)


def ntz(value: datetime | str) -> Column:
    """A moment as a zone-free timestamp literal."""
    return F.expr(f"timestamp_ntz'{moment(value).isoformat(sep=' ')}'")


def add_months_eom(day: Column, months: int) -> Column:
    """``shift_months`` for a date column: month ends stay month ends."""
    moved = F.add_months(day, months)
    return F.when(F.to_date(day) == F.last_day(day), F.last_day(moved)).otherwise(moved)


def month_column(ts: str) -> str:
    """Name of the column by whose months a table is partitioned (see ``sinks.write_facts``)."""
    return f"{ts}_month"


def day_so_far(ts: Column, as_of: datetime | str) -> Column:
    """From midnight up to and including ``as_of``."""
    return ts.between(ntz(day_start(as_of)), ntz(as_of))


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def month_of(ts: Column) -> Column:
    """First instant of the month, zone-free."""
    return F.date_trunc("MONTH", ts).cast("timestamp_ntz")


def age_years(birth: Column, at: Column) -> Column:
    """Whole years between two dates, cut toward zero."""
    return (F.months_between(at, birth, False) / F.lit(12)).cast("int")

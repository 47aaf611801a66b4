"""Live figures at many moments at once: queues, census and indicators of every hour and unit in one scan.

A figure that a snapshot shows at a moment T is a number of things that hold at T:
a visit waits from one instant to another, a patient has a bed from admission to
discharge, an admission counts "today" from its instant to midnight.  So every row
of a fact becomes one interval, and the figures at all moments of a grid are the
running sums of what begins less what ends between two moments.  Intervals are
never joined to moments: each adds at most one row per end, and these are added up
on the map side, so a scan serves any number of moments and units.

All figures are those that a query at T saw, when rows later than T were not there
yet (``as_known`` cuts tables in that way for one moment).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions.dates import MICROS_PER_SECOND, micros_between, moment, ntz
from wardlight.operators.counting import in_span, kept, months_in_span


@dataclass(frozen=True)
class Grid:
    """Moments from ``first`` to ``last``, ``every`` seconds apart; at most ``MOST`` of them."""

    first: datetime
    last: datetime
    every: int = 3600

    MOST = 100_000

    def __post_init__(self) -> None:
        if self.every < 1 or self.last < self.first or self.size > self.MOST or self.size * self.every > 1 << 32:
            raise ValueError(f"a grid has 1 to {self.MOST} moments in order, over 136 years at most")

    @property
    def size(self) -> int:
        return int((self.last - self.first).total_seconds()) // self.every + 1

    def moments(self) -> list[datetime]:
        return [self.first + timedelta(seconds=self.every * k) for k in range(self.size)]

    def index(self, ts: Column) -> Column:
        """Number of the first moment that is not before ``ts``, ``size`` if there is none; null for a null."""
        width = self.every * MICROS_PER_SECOND
        passed = F.least(F.greatest(micros_between(ntz(self.first), ts), F.lit(0)), F.lit(self.size * width)) + F.lit(width - 1)
        whole = ((passed - passed % F.lit(width)) / F.lit(width)).cast("int")  # a multiple below 2^53, so exact
        return F.when(ts.isNotNull(), whole)

    def moment_of(self, index: Column) -> Column:
        return F.timestamp_add("SECOND", index.cast("bigint") * F.lit(self.every), ntz(self.first))


def open_at(intervals: DataFrame, keys: Sequence[str], begin: str, end: str, grid: Grid, count: str = "n") -> DataFrame:
    """Per key and moment T of the grid the number of intervals with ``begin`` <= T < ``end`` (null: no end).

    Every key that occurs has a row for every moment.  The window sees at most one
    row per moment of a key.
    """
    until = F.coalesce(grid.index(F.col(end)), F.lit(grid.size))
    ends = intervals.where(F.col(begin).isNotNull()).select(
        *keys, grid.index(F.col(begin)).alias("from"), until.alias("until")
    )
    some = F.least(F.col("until") - F.col("from"), F.lit(1))  # 0 or less where no moment lies inside
    changes = ends.withColumn("held", F.greatest(some, F.lit(0))).select(*keys, F.inline(F.array(
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("change")),
        F.struct(F.col("from").alias("at"), F.col("held").alias("change")),
        F.struct(F.col("until").alias("at"), (F.lit(0) - F.col("held")).alias("change")),
    ))).where(F.col("at") < grid.size)
    summed = changes.groupBy(*keys, "at").agg(F.sum("change").alias("change"))
    in_order = Window.partitionBy(*keys).orderBy("at")
    level = summed.select(
        *keys, "at", F.sum("change").over(in_order).alias(count),
        F.coalesce(F.lead("at").over(in_order), F.lit(grid.size)).alias("next"),
    )
    filled = level.select(*keys, F.explode(F.sequence("at", F.col("next") - 1)).alias("at"), count)
    return filled.select(*keys, grid.moment_of(F.col("at")).alias("as_of"), count)


def _midnight_after(ts: Column) -> Column:
    return F.timestamp_add("DAY", F.lit(1), F.date_trunc("DAY", ts).cast("timestamp_ntz"))


def _window(df: DataFrame, ts: str, grid: Grid, days: float) -> DataFrame:
    """Rows whose ``ts`` is from ``days`` before the grid to its end."""
    return in_span(df, ts, grid.first - timedelta(days=days), up_to=grid.last)


def stalled_over_time(
    visits: DataFrame, events: DataFrame, visit_id: str, step: str, ts: str, at: int, later: Column, arrival: str, grid: Grid,
    keys: Sequence[str] = (), days: float = 1, require: DataFrame | None = None, count: str = "n",
) -> DataFrame:
    """``queues.stalled_at_step`` of the last ``days`` days, at every moment and per ``keys`` (columns of the visits).

    A visit waits from its arrival or, if that is later, from the step, until a later step or until it is ``days`` old.
    """
    recent = _window(visits, arrival, grid, days).select(visit_id, arrival, *keys)
    events = months_in_span(events, arrival, grid.first - timedelta(days=days), grid.last)
    reached = F.col(step) == at
    marks = events.filter(reached | later).groupBy(visit_id).agg(
        F.min(F.when(reached, F.col(ts))).alias("reached"), F.min(F.when(later, F.col(ts))).alias("passed"),
    )
    if require is not None:
        recent = recent.join(require.select(visit_id), visit_id, "left_semi")
    waiting = recent.join(marks, visit_id).where(F.col("reached").isNotNull()).select(
        *keys, F.greatest(arrival, "reached").alias("begin"),
        F.least("passed", F.col(arrival) + F.expr(f"interval {int(days * 86_400_000_000) + 1} microseconds")).alias("end"),
    )
    return open_at(waiting, keys, "begin", "end", grid, count)


def single_event_over_time(
    visits: DataFrame, events: DataFrame, visit_id: str, ts: str, arrival: str, grid: Grid, where: Column | None = None,
    keys: Sequence[str] = (), count: str = "quantidade",
) -> DataFrame:
    """``queues.single_event_queue`` at every moment: visits of the moment's day from their first event until their second."""
    today = kept(_window(visits, arrival, grid, 1), where).select(visit_id, arrival, *keys)
    events = months_in_span(events, arrival, grid.first - timedelta(days=1), grid.last)
    # of each visit the two earliest instants, with the number of events of each
    instants = events.where(F.col(ts).isNotNull()).groupBy(visit_id, F.col(ts).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy(visit_id).orderBy("at"))
    early = instants.withColumn("nth", nth).where(F.col("nth") <= 2)
    pair = early.groupBy(visit_id).agg(
        F.min("at").alias("first"), F.min(F.when((F.col("n") > 1) | (F.col("nth") == 2), F.col("at"))).alias("second"))
    waiting = today.join(pair, visit_id).select(
        *keys, F.greatest(arrival, "first").alias("begin"), F.least("second", _midnight_after(F.col(arrival))).alias("end"),
    )
    return open_at(waiting, keys, "begin", "end", grid, count)


def so_far_today(
    df: DataFrame, indicators: Sequence[tuple[str, str, str | None]], grid: Grid, where: Column | None = None,
    keys: Sequence[str] = (), born: str | None = None,
) -> DataFrame:
    """``counting.period_indicators`` of the day so far, at every moment: (keys, as_of, ord, indic, quant), in one scan.

    An indicator is (name, time, other time): rows whose time is of the moment's day
    and not later than the moment; with another time only while that has not come.
    ``born`` is the time from which on a row is known at all.
    """
    days = ntz(grid.first.replace(hour=0, minute=0, second=0, microsecond=0)), ntz(grid.last)
    times = sorted({t for _, ts, other in indicators for t in (ts, other, born) if t is not None})
    near = reduce(or_, [F.col(ts).between(*days) for _, ts, _ in indicators])
    rows = kept(df, where, near).select(*keys, *times)
    parts = [
        F.struct(
            F.lit(k).alias("ord"), F.col(ts).alias("ts"), F.greatest(ts, born or ts).alias("begin"),
            F.least(_midnight_after(F.col(ts)), *([F.col(other)] if other else []), F.lit(None).cast("timestamp_ntz")).alias("end"),
        ) for k, (_, ts, other) in enumerate(indicators, 1)
    ]
    each = rows.select(*keys, F.inline(F.array(*parts))).where(F.col("ts").between(*days))
    counted = open_at(each, [*keys, "ord"], "begin", "end", grid, "quant")
    names = F.element_at(F.array(*[F.lit(name) for name, _, _ in indicators]), F.col("ord"))
    return counted.select(*keys, "as_of", "ord", names.alias("indic"), "quant")


def census(df: DataFrame, begin: str, end: str, grid: Grid, where: Column | None = None, keys: Sequence[str] = (), count: str = "n") -> DataFrame:
    """Rows that are open at every moment, such as patients in their beds from admission to discharge."""
    rows = kept(df, where).where((F.col(begin) <= ntz(grid.last)) & (F.col(end).isNull() | (F.col(end) > ntz(grid.first))))
    return open_at(rows.select(*keys, begin, end), keys, begin, end, grid, count)


def as_known(tables: Mapping[str, DataFrame], at: datetime | str, rows: Mapping[str, str], hidden: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """The tables as they were at one moment: rows dated later left out (``rows``), later times unknown yet (``hidden``)."""
    at = moment(at)
    out = dict(tables)
    for name, ts in rows.items():
        out[name] = out[name].where(F.col(ts) <= ntz(at))
    for name, columns in hidden.items():
        out[name] = out[name].withColumns({c: F.when(F.col(c) <= ntz(at), F.col(c)) for c in columns})
    return out

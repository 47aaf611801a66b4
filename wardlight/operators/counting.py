"""Counts per month, per label and per entity, period indicators, arrivals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.dates import day_start, moment, month_column, ntz
from wardlight.functions.text import label_of


def kept(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Rows that meet every given condition."""
    for condition in conditions:
        if condition is not None:
            df = df.filter(condition)
    return df


def rows_in(weight: str | None = None) -> Column:
    """Number of rows, or the sum of ``weight`` where rows were already counted together."""
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def in_span(
    df: DataFrame, ts: str, start: datetime | str | None = None, before: datetime | str | None = None,
    up_to: datetime | str | None = None,
) -> DataFrame:
    """Rows from ``start`` on, earlier than ``before`` and not later than ``up_to``.

    On a table that is partitioned by the months of ``ts`` the same bounds are
    put on the partition column, so that other months are not read.
    """
    at = F.col(ts)
    df = months_in_span(df, ts, start, before if up_to is None else up_to)
    return kept(
        df, None if start is None else at >= ntz(start), None if before is None else at < ntz(before),
        None if up_to is None else at <= ntz(up_to),
    )


def months_in_span(
    df: DataFrame, ts: str, start: datetime | str | None = None, end: datetime | str | None = None,
) -> DataFrame:
    """Only the month partitions of ``ts`` from that of ``start`` to that of ``end``; all rows without such partitions.

    A child table that was stored by the months of its parent's date has the
    partition column but not the date; its rows belong to parents of those months.
    """
    if month_column(ts) not in df.columns:
        return df
    month = F.col(month_column(ts))
    return kept(
        df, None if start is None else month >= f"{moment(start):%Y-%m}",
        None if end is None else month <= f"{moment(end):%Y-%m}",
    )


def children_in_span(
    df: DataFrame, ts: str, start: datetime | str | None = None, end: datetime | str | None = None,
) -> DataFrame:
    """``months_in_span`` of a child table, without the partition column, which its parent has too."""
    return months_in_span(df, ts, start, end).drop(month_column(ts))


def on_day(df: DataFrame, ts: str, day: datetime | str) -> DataFrame:
    """Rows of the calendar day of ``day``."""
    return in_span(df, ts, day_start(day), day_start(day) + timedelta(days=1))


def counts_by_name(
    counts: DataFrame, lookup: DataFrame, key: str, names: str | Sequence[str],
    keep: Sequence[str] = (), count: str = "qtde",
) -> DataFrame:
    """Replace the key of already counted rows by names from a lookup table.

    Counting by key first leaves one row per key, so a key that holds a large
    share of the facts costs the lookup join no more than any other.
    """
    names = [names] if isinstance(names, str) else list(names)
    named = counts.join(lookup.select(key, *[n for n in names if n != key]), key)
    return named.groupBy(*keep, *names).agg(F.sum(count).alias(count))


def monthly_evolution(
    df: DataFrame, ts: str, category: str, labels: Mapping, where: Column | None = None,
    year_from: int | None = None, year_to: int | None = None, as_of: datetime | str | None = None,
    with_month: bool = False, weight: str | None = None,
) -> DataFrame:
    """Rows per ``MM/yyyy`` and category label, over whole calendar years.

    The years default to the year of ``as_of``.  Rows come back in text order of
    the month label; ``with_month`` adds the month as a date, for a true
    chronological order.
    """
    if year_from is None or year_to is None:
        year = moment(as_of).year
        year_from, year_to = year_from or year, year_to or year
    at = F.col(ts)
    rows = kept(in_span(df, ts, datetime(year_from, 1, 1), datetime(year_to + 1, 1, 1)), where)
    keys = [
        F.date_format(at, "MM/yyyy").alias("competencia"),
        label_of(F.col(category), labels).alias("tp_atendimento"),
    ]
    if with_month:
        keys.append(F.trunc(at, "MM").alias("mes"))
    return rows.groupBy(*keys).agg(rows_in(weight).alias("qtd")).orderBy("competencia", "tp_atendimento")


def period_indicators(
    df: DataFrame, indicators: Sequence[tuple[str, Column]], where: Column | None = None,
    keys: Sequence[str] = (), weight: str | None = None,
) -> DataFrame:
    """One row per named condition with the number of rows that meet it, in one scan.

    Only rows that meet some condition are read; with ``keys`` the counts are
    taken per key.  ``weight`` names a row count of rows that were already
    counted together.
    """
    rows = kept(df, where, None if keys else reduce(or_, [condition for _, condition in indicators]))

    def count(condition: Column) -> Column:
        return F.count_if(condition) if weight is None else F.sum(F.when(condition, F.col(weight)).otherwise(0))

    counted = rows.groupBy(*keys).agg(
        *[count(condition).alias(f"n{i}") for i, (_, condition) in enumerate(indicators)]
    )
    stacked = F.array(*[
        F.struct(F.lit(i + 1).alias("ord"), F.lit(name).alias("indic"), F.col(f"n{i}").alias("quant"))
        for i, (name, _) in enumerate(indicators)
    ])
    return counted.select(*keys, F.inline(stacked))


def count_in_period(
    df: DataFrame, ts: str, start: datetime | str, as_of: datetime | str, where: Column | None = None
) -> DataFrame:
    """Number of rows from ``start`` up to and including ``as_of``."""
    rows = kept(in_span(df, ts, start, up_to=as_of), where)
    return rows.agg(F.count(F.lit(1)).alias("quant"))


def monthly_count(
    df: DataFrame, ts: str, dims: Sequence[str] = (), labels: Mapping[str, Mapping] | None = None,
    where: Column | None = None, since: datetime | str | None = None, fmt: str = "yyyy-MM",
    month: str = "mes", count: str = "qtde", weight: str | None = None,
) -> DataFrame:
    """Rows per month text and dimensions.

    Grouping is by dimension code; ``labels`` are applied to the groups, so two
    codes without a label stay two rows.  Rows without a date count under a
    NULL month unless ``since`` or ``where`` excludes them.
    """
    rows = kept(in_span(df, ts, since), where)
    counted = rows.groupBy(F.date_format(ts, fmt).alias(month), *dims).agg(rows_in(weight).alias(count))
    for dim, mapping in (labels or {}).items():
        counted = counted.withColumn(dim, label_of(F.col(dim), mapping))
    return counted


def count_by_entity(
    df: DataFrame, key: str, ts: str | None = None, since: datetime | str | None = None,
    where: Column | None = None, count: str = "qtde", weight: str | None = None,
) -> DataFrame:
    """Rows per entity, optionally from ``since`` on."""
    rows = kept(df if since is None else in_span(df, ts, since), where)
    return rows.groupBy(key).agg(rows_in(weight).alias(count))


def hourly_arrivals(
    visits: DataFrame, events: DataFrame, visit_id: str, ts: str, day: datetime | str,
    step: str | None = None, at: int | None = None, where: Column | None = None,
) -> DataFrame:
    """Step events of the visits that arrived on ``day``, per hour of arrival.

    Events are counted per visit before the join; the semi join lets Catalyst
    drop other days' events ahead of that count when the day's visits are small
    enough to broadcast.
    """
    arrived = kept(on_day(visits, ts, day), where).select(visit_id, ts)
    events = months_in_span(events, ts, day, day)
    steps = kept(events, None if step is None else F.col(step) == at)
    per_visit = (
        steps.groupBy(visit_id).agg(F.count(F.lit(1)).alias("n"))
        .join(arrived.select(visit_id), visit_id, "left_semi")
    )
    return (
        arrived.join(per_visit, visit_id)
        .groupBy(F.date_format(ts, "dd/MM/yyyy").alias("data"), F.date_format(ts, "HH").alias("horario"))
        .agg(F.sum("n").alias("quantidade"))
        .orderBy(F.desc("data"), F.desc("horario"))
    )

"""Waiting times between two steps, and mean durations.

The mean wait is taken over every (from, to) pair of events of a visit, each
pair rounded to whole minutes first.  Pairs are never formed.  With ``a`` a
"to" instant moved half a minute later and ``b`` a "from" instant, both split
into whole minutes and a remainder, a pair rounds to

    minutes(a) - minutes(b) - (1 if remainder(a) < remainder(b) else 0)

(halves upward).  Halves must go away from zero, which takes one more off when
the remainders are equal and the "to" instant is the earlier one.  Both cases
say that (remainder, instant) of the "to" event sorts before that of the "from"
event, so the sum over all pairs is two products of sums less the number of
such inversions, which a running count finds in one sorted pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions.dates import (
    MICROS_PER_DAY,
    MICROS_PER_HOUR,
    MICROS_PER_MINUTE,
    MICROS_PER_SECOND,
    micros_between,
    ntz,
)
from wardlight.functions.numbers import floor_ratio, round_ratio, trunc_ratio, whole
from wardlight.operators.counting import in_span, kept, months_in_span

# Remainders of a minute are cut into slots of 1/64 second.  A running count
# works inside one slot of one visit, so a visit with very many events is
# spread over up to 3840 groups.
_SLOT = MICROS_PER_SECOND // 64
_EPOCH = "1970-01-01 00:00:00"


def step_instants(
    events: DataFrame, visit_id: str, step: str, ts: str, from_step: int, to_step: int,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Events of the two steps as (visit, instant, number of from, number of to)."""
    at = F.col(ts)
    return (
        events.filter(F.col(step).isin(from_step, to_step))
        .groupBy(visit_id, *keys, at.alias("instant"))
        .agg(
            F.count_if(F.col(step) == from_step).alias("n_from"),
            F.count_if(F.col(step) == to_step).alias("n_to"),
        )
    )


def _split(instants: DataFrame, visit_id: str) -> DataFrame:
    """One row per side and instant: whole minutes, remainder, slot and the real instant."""
    half, minute = MICROS_PER_MINUTE // 2, MICROS_PER_MINUTE
    sides = instants.withColumn("real", micros_between(ntz(_EPOCH), F.col("instant"))).selectExpr(
        visit_id,
        "real",
        f"inline(array(struct(real as at, n_from, 0L as n_to), struct(real + {half} as at, 0L as n_from, n_to)))",
    )
    return sides.where("n_from > 0 or n_to > 0").selectExpr(
        visit_id,
        "real",
        "n_from",
        "n_to",
        f"pmod(at, {minute}) as rest",
        f"cast((at - pmod(at, {minute})) div {minute} as decimal(38,0)) as minutes",
        f"pmod(at, {minute}) div {_SLOT} as slot",
    )


def pair_minutes(instants: DataFrame, visit_id: str) -> DataFrame:
    """Number of pairs and the sum of their rounded minutes, over all visits.

    ``instants`` comes from ``step_instants``: one row per visit and instant.
    The sums are decimals because products of counts can pass 64 bits.
    """
    inside = Window.partitionBy(visit_id, "slot").orderBy("rest", "real").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    by_slot = (
        _split(instants, visit_id)
        .withColumn("earlier", F.sum("n_to").over(inside))
        .groupBy(visit_id, "slot")
        .agg(
            F.expr("sum(n_from) as n_from"),
            F.expr("sum(n_to) as n_to"),
            F.expr("sum(cast(n_from * minutes as decimal(38,0))) as from_minutes"),
            F.expr("sum(cast(n_to * minutes as decimal(38,0))) as to_minutes"),
            F.expr("sum(cast(n_from as decimal(38,0)) * earlier) as inversions"),
        )
    )
    # Slots of one visit: at most 3840 rows.
    before = Window.partitionBy(visit_id).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    per_visit = (
        by_slot.withColumn("before", F.coalesce(F.sum("n_to").over(before), F.lit(0)))
        .groupBy(visit_id)
        .agg(
            F.expr("cast(sum(n_from) as decimal(38,0)) as n_from"),
            F.expr("cast(sum(n_to) as decimal(38,0)) as n_to"),
            F.expr("sum(from_minutes) as from_minutes"),
            F.expr("sum(to_minutes) as to_minutes"),
            F.expr("sum(inversions + cast(n_from as decimal(38,0)) * before) as inversions"),
        )
    )
    return per_visit.selectExpr(
        "cast(coalesce(sum(n_from * n_to), 0) as decimal(38,0)) as pairs",
        "cast(coalesce(sum(n_from * to_minutes - n_to * from_minutes - inversions), 0) as decimal(38,0)) as total",
    )


def mean_wait(totals: DataFrame, fold_hours: bool) -> DataFrame:
    """Rounded mean of ``pair_minutes``.

    With ``fold_hours`` a mean above 60 is given in hours and one of exactly 60
    as 0; ``minutes`` always holds the unfolded mean (NULL without pairs).
    """
    minutes = round_ratio(F.col("total"), F.col("pairs"))
    shown: Column = F.col("minutes")
    if fold_hours:
        shown = F.when(shown < 60, shown).when(shown > 60, shown / 60)
    return totals.select(minutes.alias("minutes")).select(
        F.coalesce(shown, F.lit(0.0)).alias("dif_em_hrs"), "minutes"
    )


def step_wait(
    visits: DataFrame, events: DataFrame, visit_id: str, step: str, ts: str, from_step: int, to_step: int,
    arrival: str, since: datetime | str, until: datetime | str | None = None,
    dim: DataFrame | None = None, fold_hours: bool = True,
) -> DataFrame:
    """Mean minutes from one step to another over visits that arrived since ``since``.

    ``dim`` restricts the events to steps listed in a step table.
    """
    recent = in_span(visits, arrival, since, up_to=until).select(visit_id)
    events = months_in_span(events, arrival, since, until)
    if dim is not None:
        events = events.join(dim.select(step), step, "left_semi")
    instants = step_instants(events, visit_id, step, ts, from_step, to_step)
    instants = instants.join(recent, visit_id, "left_semi").filter("instant is not null")
    return mean_wait(pair_minutes(instants, visit_id), fold_hours)


def duration_totals(df: DataFrame, keys: Sequence[str], start: str, end: str, where: Column | None = None) -> DataFrame:
    """Per key the exact total span from ``start`` to ``end`` and the number of spans.

    Whole seconds and the microseconds beyond them are added apart, as plain
    integers.
    """
    span = micros_between(F.col(start), F.col(end))
    return (
        kept(df, where).withColumn("span", span).groupBy(*keys)
        .agg(
            F.sum(F.expr(f"span div {MICROS_PER_SECOND}")).alias("seconds"),
            F.sum(F.col("span") % MICROS_PER_SECOND).alias("micros"),
            F.count("span").alias("spans"),
        )
    )


def duration_totals_by(totals: DataFrame, lookup: DataFrame, key: str, names: Sequence[str] | str) -> DataFrame:
    """Totals of a key added up per name of a lookup table."""
    names = [names] if isinstance(names, str) else list(names)
    named = totals.join(lookup.select(key, *[n for n in names if n != key]), key)
    return named.groupBy(*names).agg(*[F.sum(c).alias(c) for c in ("seconds", "micros", "spans")])


def _total_micros() -> Column:
    return whole(F.col("seconds")) * whole(MICROS_PER_SECOND) + whole(F.col("micros"))


def mean_days(totals: DataFrame, group: str, name: str = "tmp_dias") -> DataFrame:
    """Mean span in days, cut to 2 decimals, longest first; no span at all sorts first."""
    days = trunc_ratio(_total_micros(), whole(F.col("spans")) * whole(MICROS_PER_DAY), 2)
    return totals.select(group, days.alias(name)).orderBy(F.desc_nulls_first(name), F.asc_nulls_last(group))


def mean_duration_hm(totals: DataFrame, group: str) -> DataFrame:
    """Mean span as whole hours and rounded rest minutes (which can be 60)."""
    total, hours = _total_micros(), whole(F.col("spans")) * whole(MICROS_PER_HOUR)
    rest = whole(total % F.nullif(hours, whole(0)))
    return totals.select(
        group,
        floor_ratio(total, hours).alias("horas"),
        round_ratio(rest, whole(F.col("spans")) * whole(MICROS_PER_MINUTE)).alias("minutos"),
    ).orderBy(F.desc_nulls_first("horas"), F.desc_nulls_first("minutos"), F.asc_nulls_last(group))

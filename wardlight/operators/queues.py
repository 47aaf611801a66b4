"""Queue depths from visit step events, and patients who keep coming back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.dates import days_before
from wardlight.operators.counting import in_span, kept, months_in_span, on_day


def visit_progress(events: DataFrame, visit_id: str, step: str, at: int, later: Column) -> DataFrame:
    """Per visit: did it reach step ``at``, and did it go on to a later step."""
    reached = F.col(step) == at
    return (
        events.filter(reached | later)
        .groupBy(visit_id)
        .agg(
            F.coalesce(F.bool_or(reached), F.lit(False)).alias("reached"),
            F.coalesce(F.bool_or(later), F.lit(False)).alias("passed"),
        )
    )


def stalled_at_step(
    visits: DataFrame, events: DataFrame, visit_id: str, step: str, at: int, later: Column,
    since: datetime | str, arrival: str, require: DataFrame | None = None, count: str = "n",
) -> DataFrame:
    """Number of visits since ``since`` that reached a step and no later one.

    ``require`` lists the only visits to look at, if given.  One aggregate per
    visit answers both "has the step" and "has no later step", so events are
    read once, and a visit with very many events is one row before any join.
    Catalyst moves a semi join with a small side below that aggregate, as long
    as no filter lies between them; hence the conditional count at the end.
    """
    events = months_in_span(events, arrival, since)
    require = require if require is None else months_in_span(require, arrival, since)
    progress = visit_progress(events, visit_id, step, at, later)
    for wanted in (in_span(visits, arrival, since), require):
        if wanted is not None:
            progress = progress.join(wanted.select(visit_id), visit_id, "left_semi")
    return progress.agg(F.count_if(F.col("reached") & ~F.col("passed")).alias(count))


def single_event_queue(
    visits: DataFrame, events: DataFrame, visit_id: str, day: datetime | str, arrival: str,
    where: Column | None = None,
) -> DataFrame:
    """Number of visits of ``day`` that have exactly one event; 0 if there are none."""
    today = kept(on_day(visits, arrival, day), where).select(visit_id)
    counted = (
        months_in_span(events, arrival, day, day).groupBy(visit_id).agg(F.count(F.lit(1)).alias("n"))
        .join(today, visit_id, "left_semi")
    )
    return counted.agg(F.count_if(F.col("n") == 1).alias("quantidade"))


def frequent_returners(
    df: DataFrame, key: str, id: str, ts: str, as_of: datetime | str, days: float, more_than: int,
    where: Column | None = None, count: str = "n",
) -> DataFrame:
    """Number of keys with more than ``more_than`` distinct ids in the last ``days`` days."""
    rows = kept(in_span(df, ts, days_before(as_of, days)), where)
    return (
        rows.groupBy(key).agg(F.count_distinct(id).alias("ids"))
        .filter(F.col("ids") > more_than)
        .agg(F.count(F.lit(1)).alias(count))
    )

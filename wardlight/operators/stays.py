"""Bed occupation, mean stay per group, deaths by age band."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.dates import age_years
from wardlight.operators.counting import in_span, kept
from wardlight.operators.waits import duration_totals, mean_days


def occupied_beds(
    beds: DataFrame, units: DataFrame, name_contains: str, unit_id: str = "cd_unid_int", bed_id: str = "cd_leito",
    unit_name: str = "ds_unid_int", where: Column | None = None, units_where: Column | None = None, count: str = "n",
) -> DataFrame:
    """Number of beds that meet ``where`` in units whose name contains a text, any case."""
    wanted = kept(units, units_where, F.upper(F.col(unit_name)).contains(name_contains.upper())).select(unit_id)
    per_unit = kept(beds, where).groupBy(unit_id).agg(F.count(bed_id).alias("beds"))
    return per_unit.join(wanted, unit_id).agg(F.coalesce(F.sum("beds"), F.lit(0)).alias(count))


def mean_stay_by_group(
    df: DataFrame, group: str, start: str, end: str, since: datetime | str | None = None,
    where: Column | None = None, name: str = "tmp_dias",
) -> DataFrame:
    """Mean days from ``start`` to ``end`` per group, cut to 2 decimals, longest first."""
    rows = kept(in_span(df, end, since), where, F.col(end).isNotNull())
    return mean_days(duration_totals(rows, [group], start, end), group, name)


def age_band(birth: Column, at: Column, bands: Sequence[tuple[str, int]], last: str) -> Column:
    """Label of the first band whose upper age is above the age; a missing date falls in ``last``."""
    age = age_years(birth, at)
    chain = F
    for label, below in bands:
        chain = chain.when(age < below, F.lit(label))
    return chain.otherwise(F.lit(last))


def count_by_age_band(
    df: DataFrame, birth: str, event_ts: str, bands: Sequence[tuple[str, int]], last: str,
    dims: Sequence[str] = (), where: Column | None = None, band: str = "faixa", count: str = "qtd",
) -> DataFrame:
    """Rows per age band at the event and further dimensions."""
    rows = kept(df, where, F.col(event_ts).isNotNull())
    label = age_band(F.col(birth), F.col(event_ts), bands, last)
    return rows.groupBy(label.alias(band), *dims).agg(F.count(F.lit(1)).alias(count))

"""Open orders by age."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.dates import MICROS_PER_HOUR, micros_between, ntz
from wardlight.operators.counting import kept

# Age buckets in hours: name, above, up to and including (None: open).
AGE_BUCKETS = [("ate_12h", None, 12), ("12_24h", 12, 24), ("mais_24h", 24, None)]


def aging(
    df: DataFrame, ts: str, as_of: datetime | str, where: Column | None = None,
    columns: Sequence[str] | Mapping[str, Column] = (),
    buckets: Sequence[tuple[str, float | None, float | None]] = tuple(AGE_BUCKETS),
    only: str | None = None,
) -> DataFrame:
    """Rows with their age in hours, cut to 2 decimals, and age bucket, oldest first.

    All buckets come from one pass; ``only`` keeps one of them, with its age
    limits as plain bounds on the timestamp so that they reach the scan.
    """
    at, now = F.col(ts), ntz(as_of)
    rows = kept(df, where, at.isNotNull())
    chain = F
    for name, above, up_to in buckets:
        inside = [at.isNotNull()]
        if above is not None:
            inside.append(at < now - F.expr(f"interval {above} hours"))
        if up_to is not None:
            inside.append(at >= now - F.expr(f"interval {up_to} hours"))
        if only == name:
            rows = kept(rows, *inside)
        chain = chain.when(inside[0] if len(inside) == 1 else _all(inside), F.lit(name))
    age = micros_between(at, now)
    kept_columns = [c.alias(n) for n, c in columns.items()] if isinstance(columns, Mapping) else list(columns)
    hours = (F.call_function("div", age * F.lit(100), F.lit(MICROS_PER_HOUR)) / F.lit(100.0)).alias("horas_em_aberto")
    aged = rows.select(*kept_columns, hours, chain.alias("bucket")).filter("bucket is not null")
    # equal ages go by the other columns, so that one instant's rows need not lie in one range
    return aged.orderBy(F.desc_nulls_first("horas_em_aberto"), *[c for c in aged.columns if c != "horas_em_aberto"])


def _all(conditions: Sequence[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result & condition
    return result

"""Prescribed items: top lists, drug classes, detail rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from wardlight.functions.dates import month_column, month_of, month_start, ntz, shift_months
from wardlight.functions.text import keyword_class, not_starting_with
from wardlight.operators.counting import children_in_span, counts_by_name, in_span, kept, rows_in

_UNDATED = "none"


def top_k_by_count(
    df: DataFrame, key: str, k: int, where: Column | None = None, text: str | None = None,
    exclude_prefixes: Sequence[str] = (), lookup: DataFrame | None = None, name: str | None = None,
    count: str = "qtde",
) -> DataFrame:
    """The ``k`` most frequent keys with their rank, equal counts in name order.

    With ``lookup`` the rows are counted per key first and the few resulting
    counts are added up per ``name``.  Ranks are given after the cut, to k rows.
    """
    unconditional = None if text is None else not_starting_with(F.col(text), exclude_prefixes)
    rows = kept(df, where, F.col(key).isNotNull(), unconditional)
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias(count))
    shown = key
    if lookup is not None:
        counted, shown = counts_by_name(counted, lookup, key, name, count=count), name
    order = [F.desc(count), F.asc_nulls_last(shown)]
    top = counted.orderBy(*order).limit(k)
    return top.withColumn("rn", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def keyword_class_monthly(
    df: DataFrame, ts: str, key: str, lookup: DataFrame, text: str,
    rules: Sequence[tuple[str, Sequence[str]]], default: str, since: datetime | str | None = None,
    where: Column | None = None, weight: str | None = None,
) -> DataFrame:
    """Rows per month and keyword class of a looked-up name.

    The keywords are tried once per lookup row, on already counted keys.
    """
    rows = kept(in_span(df, ts, since), where, F.col(key).isNotNull())
    counted = rows.groupBy(month_of(F.col(ts)).alias("mes"), key).agg(rows_in(weight).alias("qtde"))
    classes = lookup.select(key, keyword_class(F.col(text), rules, default).alias("classe"))
    return counts_by_name(counted, classes, key, "classe", keep=["mes"])


def prescription_detail(
    items: DataFrame, orders: DataFrame, products: DataFrame, prescribers: DataFrame,
    order_id: str, product_id: str, prescriber_id: str, item_id: str, ts: str, product: str, prescriber: str,
    text: str | None = None, exclude_prefixes: Sequence[str] = (), where: Column | None = None,
) -> DataFrame:
    """Prescribed items with product and prescriber names, newest first."""
    joined = _prescribed(items, orders, products, prescribers, order_id, product_id, prescriber_id, product, prescriber, text, exclude_prefixes, where)
    return joined.orderBy(*_newest_first(ts, order_id, item_id)).select(*_shown(ts, order_id, item_id))


def _prescribed(items, orders, products, prescribers, order_id, product_id, prescriber_id, product, prescriber, text, exclude_prefixes, where):
    unconditional = None if text is None else not_starting_with(F.col(text), exclude_prefixes)
    rows = kept(items, where, F.col(product_id).isNotNull(), unconditional)
    return (
        rows.join(orders, order_id)
        .join(products.select(product_id, F.col(product).alias("medicamento")), product_id)
        .join(prescribers.select(prescriber_id, F.col(prescriber).alias("medico")), prescriber_id)
    )


def _newest_first(ts: str, order_id: str, item_id: str) -> list[Column]:
    return [F.desc_nulls_first(ts), F.asc(order_id), F.asc(item_id)]


def _shown(ts: str, order_id: str, item_id: str) -> list[Column]:
    return [F.date_format(ts, "dd/MM/yyyy").alias("data_prescricao"), F.col(order_id), F.col(item_id), F.col("medicamento"), F.col("medico")]


@dataclass(frozen=True)
class PageKey:
    """Place of a row in the order of ``prescription_detail``: its date (None comes first), order and item.

    Items that repeat all three are told apart by ``skip``, the number of them that were given.
    """

    at: datetime | None
    order: int
    item: int
    skip: int = 1


def prescription_page(
    items: DataFrame, orders: DataFrame, products: DataFrame, prescribers: DataFrame,
    order_id: str, product_id: str, prescriber_id: str, item_id: str, ts: str, product: str, prescriber: str,
    text: str | None = None, exclude_prefixes: Sequence[str] = (), where: Column | None = None,
    size: int = 1000, after: PageKey | None = None,
) -> tuple[list[Row], PageKey | None]:
    """The next ``size`` rows of ``prescription_detail`` after a key, and the key to go on from (None at the end).

    The detail is delivered month by month, newest first: a page looks at the month
    of its key and, only if that has too few rows, at older ones.  Of tables stored
    by months no other month is read, and a month gives a top list, so nothing is
    sorted as a whole.  A page costs the same wherever it lies in the history.
    """
    if size < 1:
        raise ValueError("a page has rows")
    by_month = F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit(_UNDATED)) if month_column(ts) not in orders.columns else F.coalesce(
        F.col(month_column(ts)).cast("string"), F.lit(_UNDATED))
    months = sorted((r[0] for r in orders.select(by_month).distinct().collect()), key=lambda m: (m == _UNDATED, m), reverse=True)  # one each
    out: list[Row] = []
    if after is not None:
        own = _UNDATED if after.at is None else f"{after.at:%Y-%m}"
        months = [m for m in months if m == own or (own == _UNDATED and m != _UNDATED) or (own != _UNDATED != m and m < own)]
    for month in months:
        if month == _UNDATED:
            some, their = orders.where(F.col(ts).isNull()), items
        else:
            begin, end = month_start(f"{month}-01"), shift_months(month_start(f"{month}-01"), 1)
            some, their = in_span(orders, ts, begin, before=end), children_in_span(items, ts, begin, begin)
        rows = _prescribed(their, some, products, prescribers, order_id, product_id, prescriber_id, product, prescriber, text, exclude_prefixes, where)
        skip = 0
        if after is not None and month == months[0] and own == month:
            same = F.col(ts).eqNullSafe(F.lit(None) if after.at is None else ntz(after.at))
            later = same & ((F.col(order_id) > after.order) | ((F.col(order_id) == after.order) & (F.col(item_id) >= after.item)))
            rows, skip = rows.where(later if after.at is None else later | (F.col(ts) < ntz(after.at))), after.skip
        page = rows.orderBy(*_newest_first(ts, order_id, item_id), "medicamento", "medico").limit(size - len(out) + skip)
        found = page.select(*_shown(ts, order_id, item_id), F.col(ts).alias("at")).collect()  # of a page at most
        out += found[skip:]
        if len(out) >= size:
            break
    if len(out) < size:
        return [_without_key(r) for r in out], None
    last = out[-1]
    repeats = sum(1 for r in out if (r["at"], r[order_id], r[item_id]) == (last["at"], last[order_id], last[item_id]))
    if after is not None and (after.at, after.order, after.item) == (last["at"], last[order_id], last[item_id]):
        repeats += after.skip
    return [_without_key(r) for r in out], PageKey(last["at"], last[order_id], last[item_id], repeats)


def _without_key(row: Row) -> Row:
    return Row(**{k: v for k, v in row.asDict().items() if k != "at"})

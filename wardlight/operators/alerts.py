"""Alerts from metric limits and from failed collections, their checks and order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlight import fixed
from wardlight.functions.numbers import fixed_text
from wardlight.operators.metrics import SNAPSHOT, area_order, limits_text, metrics_wide, value_text


def threshold_rules(spark: SparkSession) -> DataFrame:
    """The threshold rules as a table of ten rows, marked for broadcast."""
    names = ["area", "metric", "above", "prioridade", "titulo", "before", "after", "decimals"]
    rows = [F.struct(*[F.lit(v).alias(n) for v, n in zip(rule, names)]) for rule in fixed.THRESHOLD_RULES]
    return F.broadcast(spark.range(1).select(F.inline(F.array(*rows))))


def _stamped(keys: Sequence[str]) -> Column:
    return (F.col("as_of") if "as_of" in keys else F.lit(None).cast("timestamp_ntz")).alias("timestamp")


def threshold_alerts(metrics: DataFrame, rules: DataFrame, keys: Sequence[str] = SNAPSHOT) -> DataFrame:
    """An alert for every metric above the limit of its rule; works on streams too."""
    shown = F.when(F.col("decimals") == 0, fixed_text(F.col("value"), 0)).otherwise(fixed_text(F.col("value"), 1))
    return metrics.join(rules, ["area", "metric"]).filter(F.col("value") > F.col("above")).select(
        *keys, "area", "prioridade", "titulo",
        F.concat("before", shown, "after").alias("descricao"),
        _stamped(keys),
    )


def cross_alerts(metrics: DataFrame, keys: Sequence[str] = SNAPSHOT, rules: Sequence = tuple(fixed.CROSS_RULES)) -> DataFrame:
    """Alerts for metrics of several areas that pass their limits together, once per snapshot."""
    names = sorted({metric for rule in rules for metric, _ in rule[4]})
    wide = metrics_wide(metrics, names, keys)
    found = []
    for area, priority, title, text, limits in rules:
        passed = F.lit(True)
        for metric, limit in limits:
            passed = passed & (F.col(metric) > limit)
        alert = F.struct(
            F.lit(area).alias("area"), F.lit(priority).alias("prioridade"),
            F.lit(title).alias("titulo"), F.lit(text).alias("descricao"),
        )
        found.append(F.when(passed, alert))
    return wide.select(*keys, F.inline(F.array_compact(F.array(*found)))).select("*", _stamped(keys))


def has_error(error: Column) -> Column:
    return F.coalesce(error != "", F.lit(False))


def collection_failure_alerts(run_log: DataFrame, keys: Sequence[str] = SNAPSHOT) -> DataFrame:
    """An alert per area in which some query failed."""
    priority, title, text = fixed.COLLECTION_FAILURE
    failed = run_log.filter(has_error(F.col("error"))).groupBy(*keys, "area").agg(F.count(F.lit(1)).alias("failures"))
    return failed.select(
        *keys, "area", F.lit(priority).alias("prioridade"), F.lit(title).alias("titulo"),
        F.concat(F.col("failures").cast("string"), F.lit(text)).alias("descricao"), _stamped(keys),
    )


def contract_problem() -> Column:
    """Name of the first alert field that breaks the alert contract, else NULL."""

    def outside(column: str, limits: tuple[int, int]) -> Column:
        return F.coalesce(~F.length(column).between(*limits), F.lit(True))

    area_bad = ~F.coalesce(F.col("area").isin(fixed.AREAS), F.lit(False))
    return (
        F.when(area_bad, "area")
        .when(~F.coalesce(F.col("prioridade").isin(*fixed.PRIORITY_LABELS), F.lit(False)), "prioridade")
        .when(outside("titulo", fixed.TITLE_LENGTH), "titulo")
        .when(outside("descricao", fixed.DESCRIPTION_LENGTH), "descricao")
    )


def check_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts with the column ``problem``: NULL for a valid alert, else what to quarantine it for."""
    return alerts.withColumn("problem", contract_problem())


def linked_metric(area: Column, title: Column, text: Column) -> Column:
    """Metric an alert is about, by the keyword rules; NULL if none matches."""
    fields = {"titulo": F.lower(title), "descricao": F.lower(text)}
    chain = F
    for metric, words, only_area in fixed.ALERT_METRIC_RULES:
        hit = F.lit(False)
        for field, word in words.items():
            hit = hit | fields[field].contains(word)
        chain = chain.when(hit if only_area is None else hit & (area == only_area), F.lit(metric))
    return chain.otherwise(F.lit(None))


def link_alert_metric(
    alerts: DataFrame, metrics: DataFrame, catalog: DataFrame, keys: Sequence[str] = SNAPSHOT
) -> DataFrame:
    """Alerts with label, value and limits of the metric they are about and a priority label."""
    linked = alerts.withColumn("metric", linked_metric(F.col("area"), F.col("titulo"), F.col("descricao")))
    values = metrics.select(*keys, "area", "metric", "value").filter("value is not null")
    joined = linked.join(values, [*keys, "area", "metric"], "left").join(catalog, "metric", "left")
    known = F.col("value").isNotNull()
    priority = F.lit(None)
    for code, label in fixed.PRIORITY_LABELS.items():
        priority = F.when(F.col("prioridade") == code, label).otherwise(priority)
    return joined.select(
        *alerts.columns,
        F.when(known, F.col("metric")).alias("metric"),
        F.when(known, F.coalesce("label", "metric")).otherwise(fixed.NO_METRIC_LABEL).alias("metric_label"),
        F.when(known, value_text(F.col("value"), F.col("unit"))).otherwise(fixed.NO_METRIC_VALUE).alias("metric_value"),
        F.when(known, limits_text(F.col("warn"), F.col("critical"))).otherwise(fixed.NO_LIMITS).alias("metric_limits"),
        F.coalesce(priority, F.lit(fixed.NO_PRIORITY_LABEL)).alias("priority_label"),
    )


def alert_order(alerts: DataFrame, keys: Sequence[str] = SNAPSHOT, compat: bool = False) -> DataFrame:
    """Alerts with their rank inside the snapshot, most urgent and newest first.

    Ties go to the area's display order, then to the title.  ``compat`` ranks
    the priorities by their text instead (media, baixa, alta).  Ranks are given
    per snapshot, which holds a few alerts per area.
    """
    priority = F.col("prioridade") if compat else F.array_position(
        F.array(*[F.lit(p) for p in fixed.PRIORITY_LABELS]), F.col("prioridade")
    )
    order = [F.desc(priority), F.desc("timestamp"), area_order(F.col("area")), F.asc("titulo")]
    ranked = alerts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    return ranked.orderBy(*keys, "rank")

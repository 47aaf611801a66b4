"""Key figures per snapshot, their status, and area pressure.

A snapshot is one (``as_of``, ``unit_id``).  Figures are kept as a long table
with one row per snapshot and metric, so any number of units and moments is
computed in the same job.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from wardlight import fixed
from wardlight.functions.numbers import fixed_text, python_round

SNAPSHOT = ("as_of", "unit_id")


def metric_catalog(spark: SparkSession) -> DataFrame:
    """The metric catalog as a table of ten rows, marked for broadcast."""
    rows = [
        F.struct(
            F.lit(metric).alias("metric"), F.lit(label).alias("label"), F.lit(unit).alias("unit"),
            F.lit(warn).alias("warn"), F.lit(critical).alias("critical"),
        )
        for metric, label, unit, warn, critical in fixed.METRIC_CATALOG
    ]
    return F.broadcast(spark.range(1).select(F.inline(F.array(*rows))))


def first_number(df: DataFrame, columns: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first number in ``columns``, row by row in ``order``; 0 if there is none.

    Columns that hold no numbers are passed over, as are missing values.
    """
    numeric = [f.name for f in df.schema if f.name in columns and isinstance(f.dataType, NumericType)]
    found = F.coalesce(*[F.col(c).cast("double") for c in columns if c in numeric], F.lit(None).cast("double"))
    place = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    first = F.min_by(found, F.when(found.isNotNull(), place))
    return df.agg(F.coalesce(first, F.lit(0.0)).alias("number"))


# What each row of an operator result contributes to its snapshot.  A value that
# depends on an order travels with its place in that order.
def _placed(place: Column, value: Column) -> Column:
    return F.struct(place.alias("place"), value.cast("double").alias("value"))


def _admissions(row: Mapping[str, Column]) -> dict[str, Column]:
    name = F.lower(row["indic"])
    admitted = name.contains("internados")
    place = _placed(row["ord"], row["quant"])
    return {
        "admitted": F.when(admitted, place),
        "discharged": F.when(~admitted & name.contains("altas"), place),
    }


_CONTRIBUTIONS = {
    "snapshot": lambda row: {},
    "period_indicators": _admissions,
    "deaths": lambda row: {"deaths": _placed(row["mes_ano"], row["qtd_obitos"])},
    "reception_queue": lambda row: {"reception": row["n"].cast("double")},
    "triage_queue": lambda row: {"triage": row["quantidade"].cast("double")},
    "admitted_now": lambda row: {"admitted_now": row["quant"].cast("double")},
    "surgery_status": lambda row: {
        "surgeries": row["qtde"].cast("double"),
        "late": F.when(F.upper(row["tp_situacao"]).isin(fixed.LATE_STATES), row["qtde"]).cast("double"),
    },
    "product_months": lambda row: {"low_items": F.when(row["qtde"] < fixed.LOW_STOCK, 1.0)},
}


# The parts that each result contributes.
_PARTS = {
    "period_indicators": ("admitted", "discharged"), "deaths": ("deaths",), "reception_queue": ("reception",),
    "triage_queue": ("triage",), "admitted_now": ("admitted_now",), "surgery_status": ("surgeries", "late"),
    "product_months": ("low_items",),
}


# How the contributions of a snapshot are put together.
def _merged(newest_deaths: bool) -> dict[str, Column]:
    deaths = F.max("deaths") if newest_deaths else F.min("deaths")
    return {
        "admitted": F.max("admitted").getField("value"),
        "discharged": F.max("discharged").getField("value"),
        "deaths": deaths.getField("value"),
        **{name: F.max(name) for name in ("reception", "triage", "admitted_now")},
        **{name: F.sum(name) for name in ("surgeries", "late", "low_items")},
    }


def metric_table(
    results: Mapping[str, DataFrame], keys: Sequence[str] = SNAPSHOT, beds: int = fixed.ICU_BEDS,
    critical_share: float = fixed.CRITICAL_SHARE, newest_deaths: bool = False,
    failed: Collection[str] = (),
) -> DataFrame:
    """The ten metrics of every snapshot that occurs in some operator result.

    ``results`` maps the names in ``_CONTRIBUTIONS`` to operator results that
    carry the snapshot keys.  All their rows meet in one union and one aggregate
    (one shuffle, combined on the map side), without joins.  A snapshot without
    rows of some result gets 0 for it.  The death count is that of the oldest
    month listed, or of the newest with ``newest_deaths``.  The metrics of a result
    named in ``failed`` are NULL, not 0; a result ``snapshot`` of the keys alone
    makes sure that the snapshot is there.
    """
    union: DataFrame | None = None
    for name, result in results.items():
        row = {c: F.col(c) for c in result.columns}
        parts = [column.alias(part) for part, column in _CONTRIBUTIONS[name](row).items()]
        rows = result.select(*keys, *parts)
        union = rows if union is None else union.unionByName(rows, allowMissingColumns=True)
    unknown = {part for name in failed for part in _PARTS[name]}
    filled = union.groupBy(*keys).agg(*[
        (F.lit(None).cast("double") if part in unknown
         else F.coalesce(column, F.lit(0.0)) if part in union.columns else F.lit(0.0)).alias(part)
        for part, column in _merged(newest_deaths).items()
    ])
    col = F.col
    share = col("admitted") / F.greatest(col("admitted") + col("discharged"), F.lit(1.0)) * 100
    occupancy = F.when(col("admitted") == 0, 0.0).otherwise(F.least(F.lit(100.0), share))
    queue = col("reception") + col("triage")
    wait = F.when(queue > fixed.LONG_QUEUE, float(fixed.LONG_QUEUE_WAIT)).otherwise(float(fixed.SHORT_QUEUE_WAIT))
    icu = F.least(F.lit(100.0), col("admitted_now") / F.lit(float(beds)) * 100)
    late_share = F.when(col("surgeries") == 0, 0.0).otherwise(
        python_round(F.try_divide("late", "surgeries") * 100, 2)
    )
    known = F.when(col("admitted").isNotNull() & col("discharged").isNotNull(), occupancy)
    values = [
        ("Diretoria", "ocupacao_percent", known),
        ("Diretoria", "obitos_mes_atual", col("deaths")),
        ("Enfermagem", "fila_total", queue),
        ("Enfermagem", "tempo_medio_espera_min", F.when(queue.isNotNull(), wait)),
        ("UTI", "ocupacao_uti_percent", F.when(col("admitted_now").isNotNull(), icu)),
        ("UTI", "pacientes_criticos", python_round(col("admitted_now") * critical_share, 0)),
        ("Centro Cirúrgico", "cirurgias_atrasadas", col("late")),
        ("Centro Cirúrgico", "taxa_cancelamento_percent", late_share),
        ("Farmácia", "itens_ruptura", F.lit(0.0)),
        ("Farmácia", "itens_alto_risco_baixo", col("low_items")),
    ]
    rows = [
        F.struct(F.lit(area).alias("area"), F.lit(metric).alias("metric"), value.alias("value"))
        for area, metric, value in values
    ]
    return filled.select(*keys, F.inline(F.array(*rows)))


def metrics_wide(metrics: DataFrame, names: Sequence[str], keys: Sequence[str] = SNAPSHOT) -> DataFrame:
    """One row per snapshot with the named metrics as columns; missing ones are 0."""
    return metrics.filter(F.col("metric").isin(*names)).groupBy(*keys).agg(
        *[F.coalesce(F.max(F.when(F.col("metric") == n, F.col("value"))), F.lit(0.0)).alias(n) for n in names]
    )


def value_text(value: Column, unit: Column) -> Column:
    """Metric value for display: percentages with a decimal, whole numbers without."""
    number = F.when(value == F.floor(value), fixed_text(value, 0)).otherwise(fixed_text(value, 1))
    return (
        F.when(unit == "%", F.concat(fixed_text(value, 1), F.lit("%")))
        .when(F.coalesce(unit, F.lit("")) == "", number)
        .otherwise(F.concat_ws(" ", number, unit))
    )


def limits_text(warn: Column, critical: Column) -> Column:
    def number(limit: Column) -> Column:
        return F.when(limit == F.floor(limit), limit.cast("bigint").cast("string")).otherwise(limit.cast("string"))

    before, between = fixed.LIMITS_TEXT
    text = F.concat(F.lit(before), number(warn), F.lit(between), number(critical))
    return F.coalesce(text, F.lit(fixed.NO_LIMITS))


def status_of(value: Column, warn: Column, critical: Column) -> Column:
    return (
        F.when(value.isNull() | warn.isNull() | critical.isNull(), fixed.STATUS_UNKNOWN)
        .when(value > critical, fixed.STATUS_CRITICAL)
        .when(value > warn, fixed.STATUS_WARNING)
        .otherwise(fixed.STATUS_NORMAL)
    )


def metric_status(metrics: DataFrame, catalog: DataFrame) -> DataFrame:
    """Metrics with label, display value, status and limits from the catalog."""
    words = F.regexp_replace("metric", "_", " ")
    plain_label = F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substring(words, 2, 1 << 20)))
    return metrics.join(catalog, "metric", "left").select(
        *metrics.columns,
        F.coalesce("label", plain_label).alias("label"),
        value_text(F.col("value"), F.col("unit")).alias("value_text"),
        status_of(F.col("value"), F.col("warn"), F.col("critical")).alias("status"),
        limits_text(F.col("warn"), F.col("critical")).alias("thresholds"),
    )


def area_order(area: Column) -> Column:
    """Display position of an area; unknown areas come last."""
    return F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(a) for a in fixed.AREAS]), area), F.lit(0)),
        F.lit(len(fixed.AREAS) + 1),
    )


def area_pressure(metrics: DataFrame, catalog: DataFrame, keys: Sequence[str] = SNAPSHOT) -> DataFrame:
    """Points per area (2 past the critical limit, 1 past the warning limit) and the top area.

    The window sees one row per area of a snapshot.
    """
    points = F.when(F.col("value") > F.col("critical"), 2.0).when(F.col("value") > F.col("warn"), 1.0).otherwise(0.0)
    scored = metrics.join(catalog, "metric", "left").groupBy(*keys, "area").agg(F.sum(points).alias("score"))
    within = Window.partitionBy(*keys).orderBy(F.desc("score"), area_order(F.col("area")))
    return scored.withColumn("is_top", F.row_number().over(within) == 1)

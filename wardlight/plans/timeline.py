"""The live figures of the catalog at many moments and units, from one scan of each fact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import fixed
from wardlight.operators import metrics, timeline
from wardlight.operators.timeline import Grid

UNIT = "cd_multi_empresa"

# What a moment does not know yet: rows dated later, and later times of known rows (see ``timeline.as_known``).
LATER_ROWS = {"atendime": "dt_atendimento", "triagem_atendimento": "dh_pre_atendimento", "sacr_tempo_processo": "dh_processo"}
LATER_TIMES = {"atendime": ("dt_alta", "dt_alta_medica")}

# The metrics that only the history of months tells; a timeline leaves them unknown.
MONTHLY = ("deaths", "surgery_status", "product_months")


def reception_queue(tables: Mapping[str, DataFrame], grid: Grid) -> DataFrame:
    """``fila_recepcao`` per company and moment."""
    return timeline.stalled_over_time(
        tables["triagem_atendimento"], tables["sacr_tempo_processo"], "cd_triagem_atendimento", "cd_tipo_tempo_processo", "dh_processo",
        fixed.STEP_CLASSIFICATION_OUT, F.col("cd_tipo_tempo_processo") > fixed.STEP_CLASSIFICATION_OUT, "dh_pre_atendimento", grid, [UNIT],
    )


def triage_queue(tables: Mapping[str, DataFrame], grid: Grid) -> DataFrame:
    """``fila_triagem`` per company and moment."""
    return timeline.single_event_over_time(
        tables["triagem_atendimento"], tables["sacr_tempo_processo"], "cd_triagem_atendimento", "dh_processo", "dh_pre_atendimento", grid,
        F.col("cd_fila_senha").isin(fixed.TRIAGE_QUEUES), [UNIT],
    )


def _inpatients():
    return F.col("cd_atendimento_pai").isNull() & (F.col("tp_atendimento") == "I")


def day_indicators(tables: Mapping[str, DataFrame], grid: Grid) -> DataFrame:
    """``internacao_e_altas`` per company and moment."""
    times = ["dt_atendimento", "dt_alta", "dt_alta_medica", "dt_prevista_alta", "dt_prevista_alta"]
    named = list(zip(fixed.INDICATORS, times, [None, None, None, None, "dt_alta"], strict=True))
    return timeline.so_far_today(tables["atendime"], named, grid, _inpatients(), [UNIT], born="dt_atendimento")


def inpatient_census(tables: Mapping[str, DataFrame], grid: Grid) -> DataFrame:
    """Inpatients from admission to discharge, per company and moment."""
    return timeline.census(tables["atendime"], "dt_atendimento", "dt_alta", grid, _inpatients(), [UNIT])


def live_metrics(spark: SparkSession, tables: Mapping[str, DataFrame], grid: Grid, units: Sequence[int]) -> DataFrame:
    """The metric table (as_of, unit_id, area, metric, value) of every moment and unit; ``MONTHLY`` ones are NULL.

    Alerts, status, pressure and findings are keyed alike and follow from it.
    """
    indicators = day_indicators(tables, grid)
    admitted = indicators.where("ord = 1").select(UNIT, "as_of", "quant")
    results = {
        "period_indicators": indicators, "admitted_now": admitted, "reception_queue": reception_queue(tables, grid),
        "triage_queue": triage_queue(tables, grid),
    }
    keyed = {
        name: df.where(F.col(UNIT).isin(list(units))).withColumnRenamed(UNIT, "unit_id").withColumn("unit_id", F.col("unit_id").cast("bigint"))
        for name, df in results.items()
    }
    every = spark.range(grid.size).select(
        grid.moment_of(F.col("id")).alias("as_of"), F.explode(F.array(*[F.lit(int(u)).cast("bigint") for u in units])).alias("unit_id"))
    # every indicator has a row at every moment, as a single run gives them
    zeros = [
        F.struct(F.lit(k).alias("ord"), F.lit(name).alias("indic"), F.lit(0).cast("bigint").alias("quant"))
        for k, name in enumerate(fixed.INDICATORS, 1)
    ]
    keyed["period_indicators"] = keyed["period_indicators"].unionByName(every.select("unit_id", "as_of", F.inline(F.array(*zeros))))
    return metrics.metric_table({"snapshot": every, **keyed}, failed=MONTHLY)

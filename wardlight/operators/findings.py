"""Health of query runs, run counters and findings across areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight import fixed
from wardlight.functions.numbers import python_round
from wardlight.operators.alerts import has_error
from wardlight.operators.metrics import SNAPSHOT


def classify_runs(run_log: DataFrame) -> DataFrame:
    """Run log with the class and summary of the first rule that fits each run."""
    rows, key = F.coalesce("row_count", F.lit(0)), F.lower("query_key")
    kinds = {
        "error": lambda word, above: has_error(F.col("error")),
        "empty": lambda word, above: rows == 0,
        "rows": lambda word, above: (rows > above) & key.contains(word),
    }
    classes, texts = F, F
    for name, text, kind, word, above in fixed.RUN_RULES:
        fits = kinds[kind](word, above)
        classes, texts = classes.when(fits, F.lit(name)), texts.when(fits, F.lit(text))
    name, text = fixed.RUN_DEFAULT
    return run_log.withColumns({
        "classification": classes.otherwise(F.lit(name)), "summary": texts.otherwise(F.lit(text))
    })


def run_summary(run_log: DataFrame, alerts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counters per snapshot: queries, rows, rows per query, failures, high and medium alerts."""
    none = F.lit(0).cast("bigint")
    runs = run_log.select(
        *keys,
        F.lit(1).cast("bigint").alias("queries"),
        F.coalesce(F.col("row_count"), none).alias("rows"),
        F.when(has_error(F.col("error")), 1).otherwise(0).cast("bigint").alias("errors"),
        none.alias("high_alerts"), none.alias("medium_alerts"),
    )
    raised = alerts.select(
        *keys, none.alias("queries"), none.alias("rows"), none.alias("errors"),
        F.when(F.col("prioridade") == "alta", 1).otherwise(0).cast("bigint").alias("high_alerts"),
        F.when(F.col("prioridade") == "media", 1).otherwise(0).cast("bigint").alias("medium_alerts"),
    )
    counters = ["queries", "rows", "errors", "high_alerts", "medium_alerts"]
    total = runs.unionByName(raised).groupBy(*keys).agg(*[F.coalesce(F.sum(c), none).alias(c) for c in counters])
    return total.withColumn("rows_per_query", python_round(F.try_divide("rows", "queries"), 1))


def cross_findings(run_log: DataFrame, metrics: DataFrame, keys: Sequence[str] = SNAPSHOT) -> DataFrame:
    """Findings per snapshot from the row counts of the shared-operations queries and two metrics.

    Counts and metrics meet in one union and one aggregate; a missing query or
    metric counts as 0.
    """
    runs = {
        "administered": "medicacao_administrada",
        "prescribers": "medicamentos_prescritos_por_medico",
        "young": "os_manutencao_aberta_ate_12h",
        "middle": "os_manutencao_aberta_12_24h",
        "old": "os_manutencao_aberta_mais_24h",
    }
    shared = F.col("area") == fixed.AREAS[-1]
    figures = {"queue": "fila_total", "low": "itens_alto_risco_baixo"}
    counts = run_log.select(*keys, *[
        F.when(shared & (F.col("query_key") == key), F.col("row_count")).alias(name) for name, key in runs.items()
    ])
    values = metrics.select(*keys, *[
        F.when(F.col("metric") == metric, F.col("value")).alias(name) for name, metric in figures.items()
    ])
    merged = counts.unionByName(values, allowMissingColumns=True).groupBy(*keys).agg(
        *[F.coalesce(F.max(name), F.lit(0)).alias(name) for name in (*runs, *figures)]
    )
    col = F.col
    quiet = (col("queue") < fixed.QUIET_QUEUE) & (col("low") <= fixed.QUIET_STOCK)
    busy = (col("queue") > fixed.BUSY_QUEUE) & (col("low") >= fixed.BUSY_STOCK)

    def finding(name: str, level: Column | str, before: Column | None = None) -> Column:
        title, text = fixed.FINDINGS[name]
        summary = F.lit(text) if before is None else F.concat(before.cast("string"), F.lit(text))
        level = level if isinstance(level, Column) else F.lit(level)
        return F.struct(F.lit(title).alias("title"), level.alias("classification"), summary.alias("summary"))

    volume = F.when(col("administered") < fixed.MANY_MEDICATION_ROWS, fixed.WATCH).otherwise(fixed.CRITICAL)
    found = [
        F.when((col("administered") > 0) & (col("prescribers") > 0), finding("recurrence", volume)),
        F.when(col("prescribers") > 0, finding("audit", fixed.WATCH)),
        F.when(col("old") > 0, finding("aged_orders", fixed.CRITICAL, col("old")))
        .when((col("young") == 0) & (col("middle") == 0), finding("idle_shop", fixed.HEALTHY)),
        F.when(quiet, finding("idle_wards", fixed.WATCH)).when(busy, finding("pressed_wards", fixed.CRITICAL)),
    ]
    return merged.select(*keys, F.inline(F.array_compact(F.array(*found))))

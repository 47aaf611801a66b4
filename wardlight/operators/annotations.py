"""Merging of reviewers' annotations, given as tables, into alerts and run classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight import fixed
from wardlight.operators.metrics import SNAPSHOT


def annotate_alerts(alerts: DataFrame, notes: DataFrame, keys: Sequence[str] = SNAPSHOT) -> DataFrame:
    """Apply a priority and a context note to the alerts they name; no alert is removed.

    ``notes`` has (keys that it shares with the alerts, area, titulo,
    prioridade, descricao_contextual, and ``seq`` if there is an order).  Of
    several notes for one alert the last counts, or else the greatest in text
    order.  Unknown priorities and blank notes are ignored.  All kinds of alerts
    can be annotated.
    """
    on = [k for k in keys if k in notes.columns] + ["area", "titulo"]
    given = notes.select(
        *on, (F.col("seq") if "seq" in notes.columns else F.lit(0)).alias("seq"),
        F.when(F.col("prioridade").isin(*fixed.PRIORITY_LABELS), F.col("prioridade")).alias("new_priority"),
        F.nullif(F.trim("descricao_contextual"), F.lit("")).alias("note"),
    )
    last = given.groupBy(*on).agg(F.max(F.struct("seq", "new_priority", "note")).alias("last"))
    joined = alerts.join(last.select(*on, "last.new_priority", "last.note"), on, "left")
    changed = {
        "prioridade": F.coalesce("new_priority", "prioridade"),
        "descricao": F.when(F.col("note").isNull(), F.col("descricao")).otherwise(
            F.concat("descricao", F.lit(fixed.CONTEXT_MARK), "note")
        ),
    }
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in alerts.columns])


def add_alerts(alerts: DataFrame, additions: DataFrame, keys: Sequence[str] = SNAPSHOT) -> DataFrame:
    """Alerts plus the valid additions whose (area, title) is new; the first of equal ones wins.

    ``additions`` has (keys, seq, area, prioridade, titulo, descricao), ``seq``
    giving their order.
    """
    cleaned = additions.withColumns({
        "titulo": F.trim("titulo"), "descricao": F.trim("descricao"),
    }).filter(
        (F.col("area") != "")
        & F.col("prioridade").isin(*fixed.PRIORITY_LABELS)
        & (F.length("titulo") >= fixed.TITLE_LENGTH[0])
        & (F.length("descricao") >= fixed.DESCRIPTION_LENGTH[0])
    )
    name = [*keys, "area", "titulo"]
    first = cleaned.groupBy(*name).agg(
        F.min(F.struct("seq", "prioridade", "descricao")).alias("first")
    ).select(*name, "first.prioridade", "first.descricao")
    new = first.join(alerts.select(*name), name, "left_anti")
    stamp = F.col("as_of") if "as_of" in keys else F.lit(None).cast("timestamp_ntz")
    return alerts.unionByName(new.withColumn("timestamp", stamp).select(*alerts.columns))


def reclassify_runs(classified: DataFrame, notes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Override class and summary of the runs that valid notes name; the last note wins.

    ``notes`` has (keys, seq, query_key, classification, summary).
    """
    name = [*keys, "query_key"]
    valid = notes.withColumns({
        "query_key": F.trim("query_key"),
        "classification": F.lower(F.trim("classification")),
        "summary": F.trim("summary"),
    }).filter(
        F.col("classification").isin(fixed.HEALTHY, fixed.WATCH, fixed.CRITICAL)
        & (F.length("summary") >= fixed.DESCRIPTION_LENGTH[0])
    )
    last = valid.groupBy(*name).agg(
        F.max(F.struct("seq", "classification", "summary")).alias("last")
    ).select(*name, F.col("last.classification").alias("new_class"), F.col("last.summary").alias("new_summary"))
    joined = classified.join(last, name, "left")
    changed = {
        "classification": F.coalesce("new_class", "classification"),
        "summary": F.coalesce("new_summary", "summary"),
    }
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in classified.columns])


def merge_annotations(base: DataFrame, annotations: DataFrame, kind: str, keys: Sequence[str] = SNAPSHOT) -> DataFrame:
    """Merge by kind: ``alert`` notes, ``extra`` alerts or ``query`` classes."""
    merge = {"alert": annotate_alerts, "extra": add_alerts, "query": reclassify_runs}[kind]
    return merge(base, annotations, keys)

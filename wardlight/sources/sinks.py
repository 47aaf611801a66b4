"""Writing tables: facts laid out for the operators, alerts as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.functions.dates import month_column


def write_facts(df: DataFrame, path: str, ts: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by ``<ts>_month``; operators with bounds on ``ts`` read only the months they need.

    Rebalancing gathers the rows of a small month into one file and, under
    adaptive execution, splits a month that holds most of the rows.
    """
    write_months(df.withColumn(month_column(ts), F.date_format(ts, "yyyy-MM")), path, month_column(ts), mode)


def write_months(df: DataFrame, path: str, month: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by an existing month column."""
    df.hint("rebalance", month).write.mode(mode).partitionBy(month).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, mode: str = "overwrite") -> None:
    """A catalog table bucketed and sorted by ``key``; joins of two such tables need no shuffle."""
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def write_alerts_json(alerts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Alerts as JSON lines with ISO timestamps, with the snapshot that they belong to where it is known."""
    snapshot = {
        "as_of": F.date_format("as_of", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("as_of"), "unit_id": F.col("unit_id"),
    }
    alerts.select(
        *[column for name, column in snapshot.items() if name in alerts.columns],
        "area", "prioridade", "titulo", "descricao",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
    ).write.mode(mode).json(path)

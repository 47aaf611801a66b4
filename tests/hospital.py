"""Small hospital tables made in memory."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from wardlight.schemas import SOURCE_DDL, schema

AS_OF = datetime(2024, 5, 15, 12)


def at(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


def table(spark: SparkSession, name: str, rows: list[dict]) -> DataFrame:
    """Rows given as dicts of the columns that matter; the rest is NULL."""
    kind = schema(name)
    return spark.createDataFrame([tuple(row.get(f.name) for f in kind) for row in rows], kind)


def tables(spark: SparkSession, **given: list[dict]) -> dict[str, DataFrame]:
    return {name: table(spark, name, given.get(name, [])) for name in SOURCE_DDL}


def values(df: DataFrame) -> list[tuple]:
    return [tuple(row) for row in df.collect()]

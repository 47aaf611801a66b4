"""Source tables from parquet folders or a relational database."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wardlight.functions.dates import month_column
from wardlight.schemas import SOURCE_DDL, schema
from wardlight.sources.sinks import write_bucketed, write_facts, write_months


def normalised(df: DataFrame, table: str | None = None, blank_is_null: bool = True) -> DataFrame:
    """Lower-case column names, empty text as NULL and, for a known table, the declared types.

    Only declared columns are kept, so a wide source table is pruned at the scan;
    columns of month partitions stay.
    """
    df = df.toDF(*[c.lower() for c in df.columns])
    fields = schema(table) if table else df.schema
    columns = []
    for field in fields:
        column = F.col(field.name).cast(field.dataType)
        if blank_is_null and isinstance(field.dataType, StringType):
            column = F.nullif(column, F.lit(""))
        columns.append(column.alias(field.name))
    dates = {f.name for t in SOURCE_DDL for f in schema(t) if f.dataType.typeName().startswith("timestamp")}
    months = {month_column(d) for d in dates} - {f.name for f in fields}
    return df.select(*columns, *[c for c in df.columns if c in months])


def ingest_table(df: DataFrame, table: str, folder: str, ts: str | None = None, mode: str = "overwrite",
    parent: DataFrame | None = None, key: str | None = None,
) -> None:
    """Store a source table as ``folder/<table>``, normalised once, by month of ``ts`` if given.

    With ``parent``, ``ts`` is a date of that table, whose rows are unique by
    ``key``; the child is stored by the months of its parents' dates, so that a
    query bounded by the parent's date reads only those months of the child too.
    Rows without a parent go to a partition of their own.
    """
    path = f"{folder.rstrip('/')}/{table}"
    rows = normalised(df, table)
    if parent is not None:
        dates = normalised(parent).groupBy(key).agg(F.date_format(F.min(ts), "yyyy-MM").alias(month_column(ts)))
        write_months(rows.join(dates, key, "left"), path, month_column(ts), mode)
    elif ts is None:
        rows.write.mode(mode).parquet(path)
    else:
        write_facts(rows, path, ts, mode)


def ingest_bucketed(
    df: DataFrame, table: str, key: str, buckets: int, database: str = "default", mode: str = "overwrite",
) -> None:
    """Store a source table as catalog table ``database.table``, normalised, bucketed and sorted by ``key``.

    Facts that are joined on a key (items with prescriptions, notices with
    procedures) and stored with the same number of buckets are joined where they
    lie, without a shuffle.  A key that holds a great part of the rows makes one large
    bucket, which a join cannot split: bucket by keys of many values.
    """
    write_bucketed(normalised(df, table).repartition(buckets, key), f"{database}.{table}", key, buckets, mode)


def read_catalog_tables(spark: SparkSession, database: str = "default", names: Iterable[str] = tuple(SOURCE_DDL)) -> dict[str, DataFrame]:
    """Source tables stored by ``ingest_bucketed``; their buckets are kept."""
    return {name: normalised(spark.table(f"{database}.{name}"), name, blank_is_null=False) for name in names}


def read_parquet_tables(
    spark: SparkSession, folder: str, names: Iterable[str] = tuple(SOURCE_DDL), blank_is_null: bool = False
) -> dict[str, DataFrame]:
    """Source tables stored as ``folder/<table>``, with declared schemas.

    Ingested tables hold no empty text.  For others ask for ``blank_is_null``,
    at the price that filters on text no longer reach the scan.
    """
    return {
        name: normalised(spark.read.parquet(f"{folder.rstrip('/')}/{name}"), name, blank_is_null) for name in names
    }


def read_jdbc_table(
    spark: SparkSession, url: str, table: str, properties: Mapping[str, str], known_as: str | None = None,
    partition_column: str | None = None, bounds: tuple[object, object] | None = None, partitions: int = 1,
    fetch_size: int = 10_000, blank_is_null: bool = False,
) -> DataFrame:
    """A database table, read in ``partitions`` ranges of ``partition_column``.

    ``properties`` carries driver, user and password; the caller takes them from
    its own secret store or environment.  A known table is read in its declared
    types, so that filters and column choices go into the database query.
    """
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, fetchsize=fetch_size, preferTimestampNTZ=True, **properties
    )
    if known_as is not None:
        reader = reader.option("customSchema", SOURCE_DDL[known_as])
    if partition_column is not None:
        lower, upper = bounds
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper), numPartitions=partitions
        )
    return normalised(reader.load(), known_as, blank_is_null)

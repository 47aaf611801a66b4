"""Tables that change as a whole: numbered versions, and parts that are replaced all at once.

A folder counts once Spark has marked it as written.  Nothing that readers see is
changed in place: a writer adds new folders and then one small folder that says
what counts, so a job that fails, or is run again, leaves or makes the same tables.
One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "part"
_MANIFEST = f"{PART} string, run string"


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    folder, files = _folder(spark, path)
    return files.exists(folder)


def finished(spark: SparkSession, path: str, name: str = "version") -> list[int]:
    """Numbers of the whole folders ``<name>=<number>`` of ``path``, in order."""
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        return []
    found = [f.getPath() for f in files.listStatus(folder)]
    done = [p for p in found if p.getName().startswith(f"{name}=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def drop(spark: SparkSession, path: str) -> None:
    folder, files = _folder(spark, path)
    files.delete(folder, True)


def write_version(df: DataFrame, path: str, number: int) -> None:
    """Write ``path/version=<number>`` whole, and drop the versions older than the one before it."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/version={number}")
    for old in [b for b in finished(spark, path) if b < number][:-1]:
        drop(spark, f"{path}/version={old}")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """Which run holds each part."""
    known = finished(spark, f"{path}/manifest")
    if not known:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/version={known[-1]}")


def replace_parts(tables: Mapping[str, DataFrame], path: str, parts: Sequence[str] | None = None, run: str | None = None) -> None:
    """Put the given parts of all tables in the place of what was there, in one step.

    Every table has a text column ``part`` whose values are among ``parts`` (by
    default those that occur); a part without rows becomes empty.  Data go to folders of the run; the parts of all
    tables count from the moment the new manifest is whole.  Folders that neither
    this manifest nor the one before refers to, those of failed runs among them, are
    dropped then.
    """
    spark = next(iter(tables.values())).sparkSession
    run = run or uuid.uuid4().hex
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(PART).parquet(f"{path}/{name}/run={run}")
        df.limit(0).select(*[c for c in df.columns if c != PART]).coalesce(1).write.mode("overwrite").parquet(f"{path}/shape/{name}")
    if parts is None:
        found = [spark.read.schema(f"{PART} string").parquet(f"{path}/{name}/run={run}") for name in tables]
        parts = sorted({r[0] for df in found for r in df.distinct().collect()})  # a name per part
    known = finished(spark, f"{path}/manifest")
    old = _manifest(spark, path)
    new = spark.createDataFrame([(p, run) for p in parts], _MANIFEST)
    held = {r[0] for r in old.select("run").distinct().collect()}  # a name for each run that still holds a part
    write_version(old.join(new, PART, "left_anti").unionByName(new).coalesce(1), f"{path}/manifest", known[-1] + 1 if known else 0)
    for name in tables:
        folder, files = _folder(spark, f"{path}/{name}")
        for found in [f.getPath() for f in files.listStatus(folder)]:
            if found.getName().removeprefix("run=") not in {run, *held}:
                files.delete(found, True)


def parts_of(spark: SparkSession, path: str) -> DataFrame:
    """The parts that are there."""
    return _manifest(spark, path).select(PART)


def read_parts(spark: SparkSession, path: str, table: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """A table as it counts now, with ``part``; ``first`` and ``last`` bound the parts that are read.

    Raises ``FileNotFoundError`` where nothing has been written.
    """
    if not finished(spark, f"{path}/manifest") or not _exists(spark, f"{path}/shape/{table}"):
        raise FileNotFoundError(f"no {table} in {path}")
    shape = spark.read.parquet(f"{path}/shape/{table}").schema
    data = spark.read.schema(shape.add(PART, "string").add("run", "string")).parquet(f"{path}/{table}")
    wanted = _manifest(spark, path)
    if first is not None:
        data, wanted = data.where(F.col(PART) >= first), wanted.where(F.col(PART) >= first)
    if last is not None:
        data, wanted = data.where(F.col(PART) <= last), wanted.where(F.col(PART) <= last)
    return data.join(wanted, [PART, "run"], "left_semi").drop("run")

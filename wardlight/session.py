"""Spark session with the settings the operators are meant to run under."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Cluster settings.  Adaptive execution sizes the shuffles, splits skewed join
# partitions even where that costs a further exchange, and the runtime filters
# carry a date window on the small side of a join into the scan of the large one.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Further ones for a cluster: shuffles start fine-grained and are merged to the
# advised size, so one setting serves a day's window and a full history.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
}


def build_session(name: str = "wardlight", master: str | None = None, **settings: str) -> SparkSession:
    """A session with ``SETTINGS`` (and ``CLUSTER_SETTINGS`` unless local); further settings override them."""
    builder = SparkSession.builder.appName(name)
    if master is not None:
        builder = builder.master(master)
    local = master is not None and master.startswith("local")
    for key, value in {**SETTINGS, **({} if local else CLUSTER_SETTINGS), **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, as in local tests, a temporary folder is used;
    a session that is not local must have the setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="wardlight-")
    return f"{root.rstrip('/')}/wardlight/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` computed once into a table below the shared folder, and read back from there.

    Several later queries can start from it without repeating its work, and it
    outlives the executors that made it.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

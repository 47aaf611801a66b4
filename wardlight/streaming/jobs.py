"""Live jobs over event streams, and the tables that they write.

Event time columns are zone-free in the tables; watermarks need zoned
timestamps, so the jobs cast in the session zone, which is meant to be UTC.
The state of the jobs here is bounded by hour windows and the watermark; that of
visits, in ``streaming.visits``, by a timer per visit.  No visit is cut at midnight.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from wardlight.functions.dates import ntz
from wardlight.operators.alerts import threshold_alerts
from wardlight.operators.counting import kept
from wardlight.operators.waits import mean_wait, pair_minutes
from wardlight.sources.versions import finished

_TIME = "event_time"


def read_stream(
    spark: SparkSession, folder: str, schema: StructType, pattern: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream, as they arrive."""
    reader = spark.readStream.schema(schema)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _timed(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    return stream.withColumn(_TIME, F.col(ts).cast("timestamp")).withWatermark(_TIME, delay)


def stream_hourly_arrivals(
    tickets: DataFrame, ts: str, delay: str = "10 minutes", where: Column | None = None
) -> DataFrame:
    """Ticket events per date and hour, each hour given once, when it is complete (append)."""
    counted = (
        _timed(kept(tickets, where), ts, delay)
        .groupBy(F.window(_TIME, "1 hour").alias("hour"))
        .agg(F.count(F.lit(1)).alias("quantidade"))
    )
    start = F.col("hour.start")
    return counted.select(
        F.date_format(start, "dd/MM/yyyy").alias("data"), F.date_format(start, "HH").alias("horario"), "quantidade"
    )


def stream_step_instants(
    events: DataFrame, visit: Sequence[Column], step: str, ts: str, from_step: int, to_step: int,
    delay: str = "10 minutes", window: str = "1 hour",
) -> DataFrame:
    """Events of two steps per visit and instant, once their ``window`` is complete (append).

    The mean wait is computed from this table (``stream_step_wait``).  Pairs of
    events are not joined in the stream: the state holds an instant once, whatever
    the number of pairs it is part of, and only until its window ends.  The window
    says when an instant is final and no more: it is no part of a visit's key, so
    pairs may lie in different windows and on different days.
    """
    rows = events.filter(F.col(step).isin(from_step, to_step))
    counted = (
        _timed(rows, ts, delay)
        .groupBy(F.window(_TIME, window).alias("span"), *visit, F.col(ts).alias("instant"))
        .agg(
            F.count_if(F.col(step) == from_step).alias("n_from"),
            F.count_if(F.col(step) == to_step).alias("n_to"),
        )
    )
    return counted.select(F.to_date("instant").alias("day"), *[c for c in counted.columns if c != "span"])


def stream_step_wait(
    instants: DataFrame, visit: Sequence[str], fold_hours: bool = True, visits: DataFrame | None = None,
    since: datetime | str | None = None, up_to: datetime | str | None = None, arrival: str = "arrival",
) -> DataFrame:
    """Mean wait from the rows that ``stream_step_instants`` has written so far.

    With ``visits`` (visit columns and ``arrival``) only those that arrived from
    ``since`` to ``up_to`` count; days before ``since`` are then not read.
    """
    if visits is not None:
        arrived = visits.where(F.col(arrival).isNotNull())
        if since is not None:
            arrived = arrived.where(F.col(arrival) >= ntz(since))
            instants = instants.where(F.col("day") >= F.to_date(ntz(since)))
        if up_to is not None:
            arrived = arrived.where(F.col(arrival) <= ntz(up_to))
        instants = instants.join(arrived.select(*visit), list(visit), "left_semi")
    keyed = instants.select(F.struct(*visit).alias("visit"), "instant", "n_from", "n_to")
    return mean_wait(pair_minutes(keyed, "visit"), fold_hours)


def stream_threshold_alerts(
    metrics: DataFrame, rules: DataFrame, delay: str = "1 hour", keys: Sequence[str] = ("as_of", "unit_id")
) -> DataFrame:
    """Alerts from a metric stream, repeats of a (unit, area, title) dropped within the delay (append).

    ``metrics`` carries a watermark on its zoned ``event_time``, or gets one here
    from ``as_of``.
    """
    if _TIME not in metrics.columns:
        metrics = _timed(metrics, "as_of", delay)
    alerts = threshold_alerts(metrics, rules, [*keys, _TIME])
    return alerts.dropDuplicatesWithinWatermark(["unit_id", "area", "titulo"]).drop(_TIME)


def write_appends(
    stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, by: Sequence[str] = (),
) -> StreamingQuery:
    """Append finished rows to parquet, in folders of the columns ``by``; by default runs over what is available and stops."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return (writer.partitionBy(*by) if by else writer).trigger(**(trigger or {"availableNow": True})).start(path)


def write_split(
    stream: DataFrame, ts: str, path: str, checkpoint: str, delay_minutes: float = 10, trigger: dict | None = None,
) -> StreamingQuery:
    """Store every row of a stream, those behind the watermark apart, with a durable count per batch.

    The watermark of a batch is the newest ``ts`` of all batches before it less the
    delay; earlier rows are late.  A batch is written once, to
    ``rows/batch=<n>/late=<bool>``, and its counts with the newest time so far to
    ``counts/batch=<n>``, from which the next batch takes its watermark.  Both replace
    themselves when a batch is repeated, so nothing is lost or counted twice across
    restarts.  Rows without a time are not late.  Jobs read the rows that are not
    late (``on_time``); the others stay for a later correction.
    """

    def write_batch(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        done = [b for b in finished(spark, f"{path}/counts", "batch") if b < batch]
        newest = spark.read.parquet(f"{path}/counts/batch={done[-1]}").first()["newest"] if done else None
        late = F.lit(False)
        if newest is not None:
            mark = F.timestamp_add("MICROSECOND", F.lit(-int(delay_minutes * 60_000_000)), ntz(newest))
            late = F.coalesce(F.col(ts) < mark, F.lit(False))
        noted = Observation()
        marked = rows.withColumn("late", late).observe(
            noted, F.count(F.lit(1)).alias("n"), F.count_if("late").alias("n_late"), F.max(F.col(ts)).alias("top"))
        marked.write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/batch={batch}")
        seen = noted.get
        times = [t for t in (newest, seen["top"]) if t is not None]
        counts = [(seen["n"] - seen["n_late"], seen["n_late"], max(times) if times else None)]
        spark.createDataFrame(counts, "kept long, late long, newest timestamp_ntz").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/counts/batch={batch}")

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def on_time(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """The rows of ``write_split`` that are not late, as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path}/rows/batch=*/late=false")


def split_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of ``write_split`` with ``batch`` and ``late``."""
    return spark.read.parquet(f"{path}/rows").withColumn("late", F.col("late").cast("boolean"))


def split_counts(spark: SparkSession, path: str) -> DataFrame:
    """Per batch of ``write_split`` the rows ``kept`` and ``late``, and the ``newest`` time so far."""
    return spark.read.parquet(f"{path}/counts")


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped as later than the watermark, over the reported batches of one running query."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )

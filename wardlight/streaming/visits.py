"""Live queues over visits: one compacted row of state per visit, ended by a timer of its own.

The state of a visit is one short row: when it arrived, its first and last signal,
whether it reached a step, went on to a later one, and has a pending order.  It is
kept from the visit's first signal until the watermark is ``horizon`` past both its
arrival and its last signal, whatever days lie between, and then dropped.  So a
visit that crosses midnight is one visit, and the state holds the visits of one
horizon, not the history.

Arrivals, step events and orders may come from different streams.  Each is turned
into signals of one shape (``arrivals``, ``steps``, ``pending_orders``) and ``merged``
unites them.  The stream whose newest signal is oldest sets the watermark of all.
A signal may come in any order and late: an order after the step counts like one
before it, and a signal behind the watermark still counts for a visit that has not
ended (they are counted as late in ``visit_batches``).  A signal of a visit without
an arrival waits for it one horizon long and counts for nothing until then.

Every batch adds up its own signals per visit, on the map side first, so that a
visit with very many events is one row before any shuffle; unites them with the
version of the state before; drops the visits that had ended before it; and writes
a new version, then its marks.  All of it are built-in aggregates.  A batch that is
repeated after a failure starts from the same version before and makes the same
one again.  Readers see whole versions only, without the visits that have ended
since, and the folder holds two versions, however many batches ran.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardlight.functions.dates import MICROS_PER_HOUR, ntz
from wardlight.sources.versions import finished, write_version

SOURCES = ("arrivals", "steps", "orders")
MARKS = "signals long, late long, watermark timestamp_ntz, " + ", ".join(f"{s} timestamp_ntz" for s in SOURCES)


def _signals(
    stream: DataFrame, source: str, visit: Sequence[Column], ts: str, arrival: bool = False, reached: Column | None = None,
    passed: Column | None = None, pending: bool = False,
) -> DataFrame:
    def mark(condition: Column | None) -> Column:
        return F.lit(False) if condition is None else F.coalesce(condition, F.lit(False))

    at = F.col(ts).cast("timestamp_ntz")
    return stream.where(F.col(ts).isNotNull()).select(
        *visit, F.lit(source).alias("source"), at.alias("at"), F.when(F.lit(arrival), at).alias("arrival"),
        mark(reached).alias("reached"), mark(passed).alias("passed"), F.lit(pending).alias("pending"),
    )


def arrivals(visits: DataFrame, visit: Sequence[Column], ts: str) -> DataFrame:
    """Signals of visits that arrive."""
    return _signals(visits, "arrivals", visit, ts, arrival=True)


def steps(events: DataFrame, visit: Sequence[Column], step: str, ts: str, at: int, later: Column, arriving: bool = False) -> DataFrame:
    """Signals of step events: step ``at`` reached, a later one reached.

    With ``arriving`` every event is an arrival too: the first event of a visit is
    its arrival, where no table of visits is at hand.
    """
    return _signals(events, "steps", visit, ts, arriving, F.col(step) == at, later)


def pending_orders(orders: DataFrame, visit: Sequence[Column], ts: str) -> DataFrame:
    """Signals of pending orders; the stream holds those only."""
    return _signals(orders, "orders", visit, ts, pending=True)


def merged(*signals: DataFrame) -> DataFrame:
    """The signals of several streams as one."""
    union = signals[0]
    for more in signals[1:]:
        union = union.unionByName(more)
    return union


def _added_up(rows: DataFrame, visit: Sequence[str]) -> DataFrame:
    return rows.groupBy(*visit).agg(
        F.min("arrival").alias("arrival"), F.min("first").alias("first"), F.max("last").alias("last"),
        *[F.bool_or(c).alias(c) for c in ("reached", "passed", "pending")],
    )


def follow_visits(
    signals: DataFrame, visit: Sequence[str], path: str, checkpoint: str, horizon_hours: float = 24, delay_minutes: float = 10,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the state of the visits in ``path`` (``visit_states``, ``visit_batches``); by default over what is available.

    The watermark is the oldest of the streams' newest signals less the delay.
    """
    horizon = F.expr(f"interval {int(horizon_hours * MICROS_PER_HOUR)} microseconds")

    def write_batch(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        done = [b for b in finished(spark, f"{path}/marks", "batch") if b < batch]
        old = spark.read.schema(MARKS).parquet(f"{path}/marks/batch={done[-1]}").first().asDict() if done else {}
        watermark = old.get("watermark")
        late = F.lit(False) if watermark is None else F.col("at") < ntz(watermark)
        noted = Observation()
        seen = rows.observe(
            noted, F.count(F.lit(1)).alias("signals"), F.count_if(late).alias("late"),
            *[F.max(F.when(F.col("source") == s, F.col("at"))).alias(s) for s in SOURCES],
        )
        state = _added_up(seen.withColumns({"first": F.col("at"), "last": F.col("at")}), visit)
        if done:
            before = spark.read.parquet(f"{path}/state/version={done[-1]}").drop("ends")
            state = _added_up(before.unionByName(state), visit)
        state = state.withColumn("ends", F.greatest("arrival", "last") + horizon)
        if watermark is not None:
            state = state.where(F.col("ends") > ntz(watermark))
        write_version(state, f"{path}/state", batch)
        got = noted.get
        newest = {s: max([t for t in (got[s], old.get(s)) if t is not None], default=None) for s in SOURCES}
        known = [t for t in newest.values() if t is not None]
        watermark = max([t for t in (watermark, known and min(known) - timedelta(minutes=delay_minutes)) if t], default=None)
        mark = (got["signals"], got["late"], watermark, *newest.values())
        spark.createDataFrame([mark], MARKS).coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch={batch}")

    writer = signals.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def visit_states(spark: SparkSession, path: str) -> DataFrame:
    """The visits that have not ended as of the last finished batch: visit, arrival, first and last signal, reached, passed, pending."""
    batch = finished(spark, f"{path}/marks", "batch")[-1]
    watermark = spark.read.schema(MARKS).parquet(f"{path}/marks/batch={batch}").first()["watermark"]
    state = spark.read.parquet(f"{path}/state/version={batch}")
    return (state if watermark is None else state.where(F.col("ends") > ntz(watermark))).drop("ends")


def visit_batches(spark: SparkSession, path: str) -> DataFrame:
    """Per batch the number of signals, how many of them were late, the watermark after it, and each stream's newest signal.

    The two numbers are noted while the signals are added up; where an executor was lost on the way they can count
    some signals twice.  Times and states are not affected; ``jobs.write_split`` counts exactly.
    """
    return spark.read.schema(f"{MARKS}, batch int").parquet(f"{path}/marks")


def stalled_visits(states: DataFrame, since: datetime | str, pending: bool = False, up_to: datetime | str | None = None) -> DataFrame:
    """Number of visits that arrived since ``since`` and stalled at the step; with ``pending`` those with a pending order."""
    recent = states.where(F.col("arrival") >= ntz(since))
    if up_to is not None:
        recent = recent.where(F.col("arrival") <= ntz(up_to))
    waiting = F.col("reached") & ~F.col("passed")
    return recent.agg(F.count_if(waiting & F.col("pending") if pending else waiting).alias("n"))

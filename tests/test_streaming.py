"""Streams fed by one file per batch, compared with the batch operators."""

from datetime import datetime, timedelta
from functools import partial
from pathlib import Path

import pytest
from hospital import values
from pyspark.sql import functions as F

from wardlight.operators import alerts, counting, queues, waits
from wardlight.session import shared_folder
from wardlight.streaming import jobs, visits

START = datetime(2024, 1, 1)
KIND = "visit bigint, step int, ts timestamp_ntz"


def minutes(n):
    return START + timedelta(minutes=n)


@pytest.fixture()
def folder(spark):
    return shared_folder(spark, "test")


def feed(spark, folder, batches, kind=KIND):
    """One parquet file per batch, named in order."""
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return jobs.read_stream(spark, f"{folder}/in", spark.createDataFrame([], kind).schema, "*.parquet", 1)


def replay(folder, stream, write, spark):
    query = write(stream, f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out"), query


# In the fourth batch one row is two hours behind the watermark.  Rows are dropped by
# the watermark of the batch before, so the batch in between lets it take effect.
BATCHES = [
    [(1, 1, minutes(5)), (1, 11, minutes(20)), (2, 1, minutes(50))],
    [(2, 12, minutes(70)), (3, 1, minutes(200))],
    [(3, 12, minutes(201))],
    [(4, 1, minutes(30)), (3, 11, minutes(260)), (5, 1, minutes(262))],
    [(9, 1, START + timedelta(days=2))],
]


def test_hourly_arrivals_drop_late_rows(spark, folder):
    stream = feed(spark, folder, BATCHES)
    out, query = replay(folder, jobs.stream_hourly_arrivals(stream, "ts", where=F.col("step") == 1), jobs.write_appends, spark)
    assert sorted(values(out)) == [("01/01/2024", "00", 2), ("01/01/2024", "03", 1), ("01/01/2024", "04", 1)]
    assert jobs.late_rows(query) == 1


def test_step_wait_matches_batch_on_closed_days(spark, folder):
    rows = [r for batch in BATCHES for r in batch]
    stream = feed(spark, folder, BATCHES)
    instants = jobs.stream_step_instants(stream, [F.col("visit")], "step", "ts", 1, 11, window="1 day")
    out, _ = replay(folder, instants, jobs.write_appends, spark)
    events = spark.createDataFrame(rows, KIND).filter(F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz"))
    batch = waits.mean_wait(waits.pair_minutes(waits.step_instants(events, "visit", "step", "ts", 1, 11), "visit"), True)
    assert values(jobs.stream_step_wait(out, ["visit"])) == values(batch) == [(38.0, 38.0)]


NIGHT = datetime(2024, 1, 1, 23)


def after(n):
    return NIGHT + timedelta(minutes=n)


def open_visits(spark, folder, stream, at=12, hours=24, *more):
    signals = visits.steps(stream, [F.col("visit")], "step", "ts", at, F.col("step") > at, arriving=True)
    visits.follow_visits(visits.merged(signals, *more), ["visit"], f"{folder}/out", f"{folder}/checkpoint", hours).awaitTermination()
    return visits.visit_states(spark, f"{folder}/out")


def known(states):
    return sorted((r.visit, r.reached, r.passed) for r in states.collect())


def stalled_in_batch(spark, rows, since, at=12, pending=None):
    events = spark.createDataFrame(rows, KIND)
    arrived = events.groupBy("visit").agg(F.min("ts").alias("arrival"))
    require = pending and spark.createDataFrame([(v,) for v in pending], "visit bigint")
    return values(queues.stalled_at_step(arrived, events, "visit", "step", at, F.col("step") > at, since, "arrival", require))


def test_stalled_visits_follow_updates(spark, folder):
    stream = feed(spark, folder, [
        [(1, 12, minutes(1)), (2, 12, minutes(2)), (3, 1, minutes(3))], [(1, 20, minutes(4)), (3, 12, minutes(5))],
    ])
    states = open_visits(spark, folder, stream)
    assert values(visits.stalled_visits(states, START)) == [(2,)]
    assert values(visits.stalled_visits(states, minutes(3))) == [(1,)]


def test_a_visit_over_midnight_is_one_visit(spark, folder):
    batches = [[(1, 12, after(50)), (2, 12, after(55))], [(1, 20, after(70))]]  # 23:50, 23:55, then 00:10
    states = open_visits(spark, folder, feed(spark, folder, batches))
    rows = [r for b in batches for r in b]
    assert values(visits.stalled_visits(states, after(0))) == stalled_in_batch(spark, rows, after(0)) == [(1,)]


# A visit of another day, a row behind the watermark, and visits that come a day later.
LONG = [
    [(1, 12, after(50)), (2, 12, after(55)), (3, 1, after(56))], [(1, 20, after(70))], [(3, 12, after(600))],
    [(2, 13, after(57))], [(4, 1, after(2400))], [(5, 12, after(2401))],
]


def test_state_ends_a_day_after_the_visit(spark, folder):
    assert known(open_visits(spark, folder, feed(spark, folder, LONG))) == [(4, False, False), (5, True, False)]
    marks = visits.visit_batches(spark, f"{folder}/out").orderBy("batch").collect()
    assert [(r.signals, r.late) for r in marks] == [(3, 0), (1, 0), (1, 0), (1, 1), (1, 0), (1, 0)]
    assert marks[-1].watermark == after(2391) and marks[3].watermark == marks[2].watermark == after(590)
    stored = spark.read.parquet(f"{folder}/out/state/version=5")
    assert sorted(r.visit for r in stored.collect()) == [4, 5]


def test_a_late_signal_counts_for_a_visit_that_has_not_ended(spark, folder):
    assert known(open_visits(spark, folder, feed(spark, folder, LONG[:4]))) == [(1, True, True), (2, True, True), (3, True, False)]


def test_a_visit_lasts_while_signals_come(spark, folder):
    """Its arrival stays the first one, beyond a horizon; another visit moves the watermark."""
    rows = [[(1, 1, after(0))], [(1, 11, after(1000))], [(2, 1, after(1900))], [(1, 12, after(1950))], [(3, 1, after(2000))]]
    states = open_visits(spark, folder, feed(spark, folder, rows))
    assert [(r.visit, r.arrival, r.last) for r in states.where("visit = 1").collect()] == [(1, after(0), after(1950))]
    assert values(visits.stalled_visits(states, after(2000 - 1440))) == [(0,)]


def test_state_goes_on_after_a_restart(spark, folder):
    first = open_visits(spark, folder, feed(spark, folder, LONG[:2]))
    assert sorted(r.visit for r in first.collect()) == [1, 2, 3]
    states = open_visits(spark, folder, feed(spark, folder, LONG[2:3]))
    rows = [r for b in LONG[:3] for r in b]
    assert values(visits.stalled_visits(states, after(0))) == stalled_in_batch(spark, rows, after(0)) == [(2,)]
    assert values(visits.stalled_visits(states, after(0), up_to=after(55))) == [(1,)]


def test_arrivals_from_a_table_of_visits(spark, folder):
    """Only visits that arrive are counted, and an arrival may come after its events."""
    kind = "visit bigint, arrival timestamp_ntz"
    for rows in ([(1, after(0)), (9, after(5))], [(2, after(30))], [(7, after(1460))]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{folder}/visits")
    came = jobs.read_stream(spark, f"{folder}/visits", spark.createDataFrame([], kind).schema, "*.parquet", 1)
    stream = feed(spark, folder, [[(2, 12, after(31)), (1, 12, after(20)), (3, 12, after(20))], [(1, 11, after(60))], [(7, 13, after(1462))], [(1, 12, after(1463))]])
    signals = visits.merged(
        visits.arrivals(came, [F.col("visit")], "arrival"), visits.steps(stream, [F.col("visit")], "step", "ts", 12, F.col("step") > 12))
    visits.follow_visits(signals, ["visit"], f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    states = visits.visit_states(spark, f"{folder}/out")
    came = sorted((r.visit, r.arrival) for r in states.where("arrival is not null").collect())
    assert came == [(1, after(0)), (2, after(30)), (7, after(1460))]  # 9 has ended
    assert [r.visit for r in states.where("arrival is null").collect()] == [3]  # it never came
    assert values(visits.stalled_visits(states, after(30))) == [(1,)]
    assert values(visits.stalled_visits(states, after(0))) == [(2,)]


def test_a_pending_order_may_come_after_the_step(spark, folder):
    batches = [[(1, 12, after(50)), (2, 12, after(55)), (3, 12, after(56))], [(3, 20, after(70)), (4, 1, after(80))]]
    kind = "visit bigint, asked timestamp_ntz"
    for rows in ([(3, after(50))], [(2, after(75))], [(8, after(76))]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{folder}/orders")
    orders = jobs.read_stream(spark, f"{folder}/orders", spark.createDataFrame([], kind).schema, "*.parquet", 1)
    asked = visits.pending_orders(orders, [F.col("visit")], "asked")
    states = open_visits(spark, folder, feed(spark, folder, batches), 12, 24, asked)
    rows = [r for b in batches for r in b]
    assert values(visits.stalled_visits(states, after(0), pending=True)) == stalled_in_batch(spark, rows, after(0), pending=[2, 3, 8]) == [(1,)]
    assert values(visits.stalled_visits(states, after(0))) == [(2,)]


def test_waits_over_midnight(spark, folder):
    rows = [(7, 1, after(50)), (7, 11, after(70)), (8, 1, after(10)), (8, 11, after(110)), (9, 1, after(20)), (10, 1, after(5000))]
    stream = feed(spark, folder, [rows[:2], rows[2:5], rows[5:]])
    instants = jobs.stream_step_instants(stream, [F.col("visit")], "step", "ts", 1, 11)
    out, _ = replay(folder, instants, partial(jobs.write_appends, by=["day"]), spark)
    events = spark.createDataFrame(rows, KIND)
    arrived = events.groupBy("visit").agg(F.min("ts").alias("arrival"))
    for since in (after(0), after(30)):
        batch = waits.step_wait(arrived, events, "visit", "step", "ts", 1, 11, "arrival", since)
        assert values(jobs.stream_step_wait(out, ["visit"], visits=arrived, since=since)) == values(batch)
    assert values(jobs.stream_step_wait(out, ["visit"], visits=arrived, since=after(30), up_to=after(60))) == [(20.0, 20.0)]


def test_the_folder_holds_two_versions(spark, folder):
    for k in range(0, 6, 2):
        open_visits(spark, folder, feed(spark, folder, LONG[k : k + 2]))
    assert sorted(p.name for p in Path(f"{folder}/out/state").iterdir()) == ["version=4", "version=5"]
    assert visits.visit_batches(spark, f"{folder}/out").count() == 6


def test_a_repeated_batch_makes_the_same_version(spark, folder, monkeypatch):
    """The writer fails when a version is written and its marks are not; the batch runs again from the version before."""
    whole, failed = visits.write_version, []

    def failing(df, path, batch):
        whole(df, path, batch)
        if batch == 1 and not failed:
            failed.append(path)
            raise RuntimeError("lost")

    monkeypatch.setattr(visits, "write_version", failing)
    stream = feed(spark, folder, LONG[:3])
    with pytest.raises(Exception, match="lost"):
        open_visits(spark, folder, stream)
    assert known(visits.visit_states(spark, f"{folder}/out")) == [(1, True, False), (2, True, False), (3, False, False)]
    assert known(open_visits(spark, folder, stream)) == [(1, True, True), (2, True, False), (3, True, False)]
    marks = visits.visit_batches(spark, f"{folder}/out")
    assert failed and marks.agg(F.sum("signals")).first()[0] == 5


def test_a_hot_visit_is_one_row_before_the_shuffle(spark, folder):
    rows = [(1, 11 + k % 2, after(k % 300)) for k in range(20_000)] + [(2, 12, after(5))]
    feed(spark, folder, [rows])
    batch = spark.read.parquet(f"{folder}/in")
    signals = visits.steps(batch, [F.col("visit")], "step", "ts", 12, F.col("step") > 12, arriving=True)
    plan = visits._added_up(signals.withColumns({"first": F.col("at"), "last": F.col("at")}), ["visit"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_min") > plan.index("Exchange hashpartitioning(visit")  # printed from the top
    states = open_visits(spark, folder, feed(spark, folder, []))
    assert known(states) == [(1, True, False), (2, True, False)]


def test_late_rows_are_kept_apart_and_counted(spark, folder):
    def run():
        stream = feed(spark, folder, [])
        jobs.write_split(stream, "ts", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()

    feed(spark, folder, LONG[:3])
    run()
    feed(spark, folder, [*LONG[3:], [(6, 1, None), (6, 1, after(2391)), (6, 1, after(2390))]])
    run()  # a restart: the watermark goes on
    rows = [r for b in LONG for r in b] + [(6, 1, None), (6, 1, after(2391)), (6, 1, after(2390))]
    split = jobs.split_rows(spark, f"{folder}/out")
    assert sorted(values(split.select("visit", "step", "ts")), key=repr) == sorted(rows, key=repr)
    assert sorted(values(split.where("late").select("visit", "ts"))) == [(2, after(57)), (6, after(2390))]
    counts = jobs.split_counts(spark, f"{folder}/out").orderBy("batch").collect()
    assert [(r.kept, r.late) for r in counts] == [(3, 0), (1, 0), (1, 0), (0, 1), (1, 0), (1, 0), (2, 1)]
    assert sum(r.kept + r.late for r in counts) == len(rows)
    kept = jobs.on_time(spark, f"{folder}/out", spark.createDataFrame([], KIND).schema)
    signals = visits.steps(kept, [F.col("visit")], "step", "ts", 12, F.col("step") > 12, arriving=True)
    visits.follow_visits(signals, ["visit"], f"{folder}/state", f"{folder}/state-checkpoint").awaitTermination()
    assert visits.visit_batches(spark, f"{folder}/state").agg(F.sum("late")).first()[0] == 0
    assert [k[0] for k in known(visits.visit_states(spark, f"{folder}/state"))] == [4, 5, 6]


def test_threshold_alerts_are_not_repeated(spark, folder):
    kind = "as_of timestamp_ntz, unit_id bigint, area string, metric string, value double"
    stream = feed(spark, folder, [
        [(minutes(0), 1, "Enfermagem", "fila_total", 41.0), (minutes(0), 2, "Enfermagem", "fila_total", 40.0)],
        [(minutes(30), 1, "Enfermagem", "fila_total", 50.0), (minutes(30), 2, "Enfermagem", "fila_total", 44.0)],
    ], kind)
    raised = jobs.stream_threshold_alerts(stream, alerts.threshold_rules(spark))
    out, _ = replay(folder, raised, jobs.write_appends, spark)
    got = sorted((r.unit_id, r.descricao) for r in out.collect())
    assert got == [(1, "Fila atual com 41 pacientes"), (2, "Fila atual com 44 pacientes")]


def test_hourly_stream_agrees_with_batch(spark, folder):
    stream = feed(spark, folder, BATCHES)
    out, _ = replay(folder, jobs.stream_hourly_arrivals(stream, "ts"), jobs.write_appends, spark)
    events = spark.createDataFrame([r for b in BATCHES for r in b if r[0] != 4], KIND)
    visits = events.select(F.monotonically_increasing_id().alias("id"), "ts").persist()
    batch = counting.hourly_arrivals(visits, visits.select("id"), "id", "ts", START)
    assert sorted(values(out)) == sorted(values(batch))

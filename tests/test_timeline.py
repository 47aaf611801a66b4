"""Figures at many moments, against single runs over tables cut to one moment."""

import random
from datetime import datetime, timedelta

import pytest
from hospital import values
from pyspark.sql import functions as F

from wardlight.operators import queues, timeline
from wardlight.operators.timeline import Grid
from wardlight.plans import timeline as timelines
from wardlight.plans.catalog import find
from wardlight.sources.driver_tables import hospital_tables

SF = "/root/testdata/sf0.01"
START = datetime(2024, 1, 1)
GRID = Grid(datetime(2001, 7, 30), datetime(2001, 8, 1), 3600)
MOMENTS = [datetime(2001, 7, 30), datetime(2001, 7, 31, 2), datetime(2001, 7, 31, 18), datetime(2001, 7, 31, 23), datetime(2001, 8, 1)]


def minutes(n):
    return None if n is None else START + timedelta(minutes=n)


def by_hand(rows, grid):
    return sorted(
        (k, t, sum(1 for key, b, e in rows if key == k and b is not None and b <= t and (e is None or t < e)))
        for k in {key for key, b, _ in rows if b is not None} for t in grid.moments()
    )


@pytest.mark.parametrize("every", [60, 3600, 7 * 60 + 13])
def test_intervals_against_every_moment(spark, every):
    rng = random.Random(every)
    grid = Grid(minutes(100), minutes(1500), every)
    ends = [None, 0, 99, 100, 101, 160, 1500, 1501, 9000]
    rows = [(rng.choice("abc"), minutes(rng.choice(ends)), minutes(rng.choice(ends))) for _ in range(60)]
    rows += [("d", minutes(rng.uniform(0, 2000)), minutes(rng.uniform(0, 2000))) for _ in range(60)]
    rows += [("e", minutes(9000), None), ("f", None, None), ("g", minutes(100), minutes(100) + timedelta(microseconds=1))]
    df = spark.createDataFrame(rows, "unit string, begin timestamp_ntz, end timestamp_ntz")
    got = timeline.open_at(df, ["unit"], "begin", "end", grid)
    assert sorted((r.unit, r.as_of, r.n) for r in got.collect()) == by_hand(rows, grid)


def test_grids():
    assert Grid(minutes(0), minutes(59), 3600).moments() == [minutes(0)]
    assert Grid(minutes(0), minutes(60), 3600).size == 2
    for first, last, every in ((1, 0, 60), (0, 10**7, 1), (0, 1, 0)):
        with pytest.raises(ValueError):
            Grid(minutes(first), minutes(last), every)


def test_no_rows_no_moments(spark):
    df = spark.createDataFrame([], "unit string, begin timestamp_ntz, end timestamp_ntz")
    assert timeline.open_at(df, ["unit"], "begin", "end", Grid(minutes(0), minutes(60))).count() == 0


def test_stalled_visits_at_every_moment(spark):
    """Random visits, against the batch operator over the events known at each moment."""
    rng = random.Random(3)
    arrived = [(v, rng.choice([1, 2]), minutes(rng.randint(0, 3000))) for v in range(60)]
    steps = [(v, rng.choice([11, 12, 12, 20]), a + timedelta(minutes=rng.randint(-5, 900))) for v, _, a in arrived for _ in range(rng.randint(0, 3))]
    steps.append((999, 12, minutes(5)))  # of no visit
    visits = spark.createDataFrame(arrived, "visit int, unit int, arrival timestamp_ntz").persist()
    events = spark.createDataFrame(steps, "visit int, step int, ts timestamp_ntz").persist()
    grid = Grid(minutes(0), minutes(4000), 500 * 60)
    got = timeline.stalled_over_time(visits, events, "visit", "step", "ts", 12, F.col("step") > 12, "arrival", grid, ["unit"])
    found = {(r.unit, r.as_of): r.n for r in got.collect()}
    single = timeline.single_event_over_time(visits, events, "visit", "ts", "arrival", grid)
    one = {r.as_of: r.quantidade for r in single.collect()}
    for t in grid.moments():
        known = timeline.as_known({"v": visits, "e": events}, t, {"v": "arrival", "e": "ts"}, {})
        for unit in (1, 2):
            want = queues.stalled_at_step(
                known["v"].where(F.col("unit") == unit), known["e"], "visit", "step", 12, F.col("step") > 12, t - timedelta(days=1), "arrival")
            assert values(want) == [(found[unit, t],)]
        assert values(queues.single_event_queue(known["v"], known["e"], "visit", t, "arrival")) == [(one[t],)]
    assert sum(found.values()) > 10 and sum(one.values()) > 3


def test_moments_equal_single_runs_of_the_catalog(spark):
    tables = hospital_tables(spark, SF)
    waiting = {(r[0], r.as_of): r.n for r in timelines.reception_queue(tables, GRID).collect()}
    triage = {(r[0], r.as_of): r.quantidade for r in timelines.triage_queue(tables, GRID).collect()}
    day = {(r[0], r.as_of, r.ord): (r.indic, r.quant) for r in timelines.day_indicators(tables, GRID).collect()}
    seen = 0
    for t in MOMENTS:
        known = timeline.as_known(tables, t, timelines.LATER_ROWS, timelines.LATER_TIMES)
        for unit in (1, 2):
            own = {**known, "triagem_atendimento": known["triagem_atendimento"].where(F.col(timelines.UNIT) == unit)}
            assert values(find("fila_recepcao").build(own, t)) == [(waiting.get((unit, t), 0),)]
        assert values(find("fila_triagem").build(known, t)) == [(triage.get((2, t), 0),)]
        for r in find("internacao_e_altas").build(known, t).collect():
            assert day.get((1, t, r.ord), (r.indic, 0)) == (r.indic, r.quant)
            seen += r.quant
    assert seen and sum(waiting.values()) and sum(triage.values())


def test_metrics_of_every_moment_and_unit(spark):
    table = timelines.live_metrics(spark, hospital_tables(spark, SF), GRID, [1, 2, 7])
    rows = table.collect()
    assert len(rows) == GRID.size * 3 * 10
    assert {r.metric for r in rows if r.value is None} == {
        "obitos_mes_atual", "cirurgias_atrasadas", "taxa_cancelamento_percent", "itens_alto_risco_baixo"}
    assert {r.value for r in rows if r.unit_id == 7 and r.metric == "fila_total"} == {0.0}


def test_one_scan_serves_all_moments(spark):
    plan = timelines.day_indicators(hospital_tables(spark, SF), GRID)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan
    plan = timelines.reception_queue(hospital_tables(spark, SF), GRID)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2

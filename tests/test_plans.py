"""What the physical plans must and must not hold."""

import re

import pytest

from wardlight.plans.driver_queries import QUERIES

SF = "/root/testdata/sf0.001"
EAGER = {"catalog_run_log"} | {name for name in QUERIES if name.startswith("stream_")}


@pytest.fixture(autouse=True)
def full_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "ArrowEval" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["monthly_evolution"](spark, SF))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz>" in text


@pytest.mark.parametrize("name", ["stalled_at_step", "single_event_queue", "step_wait", "hourly_arrivals"])
def test_small_visit_side_is_applied_before_the_events_are_shuffled(spark, name):
    text = plan(QUERIES[name](spark, SF))
    semi = text.index("LeftSemi")
    assert text.rindex("Exchange hashpartitioning", 0, semi) < semi
    indent = {line: len(line) - len(line.lstrip(" :+-*")) for line in text.splitlines()}
    lines = list(indent)
    join = next(i for i, line in enumerate(lines) if "LeftSemi" in line)
    probe = [line for line in lines[join + 1:] if "FileScan" in line or "Exchange" in line][0]
    assert "FileScan" in probe


@pytest.mark.parametrize("name,table,scans", [
    ("period_indicators", "lineitem", 1), ("internacao_e_altas", "orders", 1), ("aging", "events", 1), ("latest_pivot", "events", 1),
])
def test_one_scan(spark, name, table, scans):
    assert len(re.findall(rf"{table}\.parquet", plan(QUERIES[name](spark, SF)))) == scans


def test_metric_parts_share_one_shuffle(spark):
    df = QUERIES["metric_table"](spark, SF)
    df.collect()
    final = plan(df)
    assert final.count("ReusedExchange") >= 6


def test_step_wait_stays_exact_when_the_visits_are_too_many_to_broadcast(spark):
    wanted = QUERIES["step_wait"](spark, SF).collect(), QUERIES["stalled_at_step"](spark, SF).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        stalled = QUERIES["stalled_at_step"](spark, SF)
        assert (QUERIES["step_wait"](spark, SF).collect(), stalled.collect()) == wanted
        assert "SortMergeJoin" in plan(stalled)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("key", ["fila_recepcao", "fila_triagem", "media_espera_classificacao", "atendimento_por_horario"])
def test_runtime_filter_cuts_the_event_scan_when_visits_cannot_be_broadcast(spark, key):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1b",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        optimized = QUERIES[key](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "might_contain" in optimized
    finally:
        for name in settings:
            spark.conf.unset(name)

"""Replaceable parts, rollups that refresh changed months only, the history of snapshots, and the run log in one pass."""

import uuid
from datetime import datetime
from pathlib import Path

import pytest
from hospital import AS_OF, tables, values
from pyspark.sql import functions as F

from wardlight.plans import rollups, runs
from wardlight.plans.catalog import Query, find
from wardlight.session import shared_folder
from wardlight.sources import versions
from wardlight.sources.driver_tables import HOSPITAL_AS_OF, hospital_tables
from wardlight.sources.tables import ingest_table, read_parquet_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def folder(spark):
    return shared_folder(spark, "test")


def part(spark, rows):
    return spark.createDataFrame(rows, "part string, n int")


def held(spark, folder, table="t", **bounds):
    return sorted((r.part, r.n) for r in versions.read_parts(spark, folder, table, **bounds).collect())


# Parts.

def test_parts_take_the_place_of_older_ones(spark, folder):
    versions.replace_parts({"t": part(spark, [("2024-01", 1), ("2024-02", 2), ("2024-02", 3)])}, folder)
    versions.replace_parts({"t": part(spark, [("2024-02", 4), ("2024-03", 5)])}, folder, ["2024-02", "2024-03"])
    assert held(spark, folder) == [("2024-01", 1), ("2024-02", 4), ("2024-03", 5)]
    assert held(spark, folder, first="2024-02") == [("2024-02", 4), ("2024-03", 5)]
    assert held(spark, folder, first="2024-02", last="2024-02") == [("2024-02", 4)]
    versions.replace_parts({"t": part(spark, [])}, folder, ["2024-02"])
    assert held(spark, folder) == [("2024-01", 1), ("2024-03", 5)]
    assert sorted(r.part for r in versions.parts_of(spark, folder).collect()) == ["2024-01", "2024-02", "2024-03"]


def test_tables_change_together_and_repeats_change_nothing(spark, folder):
    both = {"a": part(spark, [("x", 1)]), "b": part(spark, [("x", 2), ("y", 3)])}
    for _ in range(2):
        versions.replace_parts(both, folder, ["x", "y"])
    assert held(spark, folder, "a") == [("x", 1)] and held(spark, folder, "b") == [("x", 2), ("y", 3)]
    with pytest.raises(FileNotFoundError):
        held(spark, folder, "c")
    with pytest.raises(FileNotFoundError):
        held(spark, f"{folder}-other", "a")


def test_a_failing_writer_leaves_the_old_parts(spark, folder):
    versions.replace_parts({"a": part(spark, [("x", 1)]), "b": part(spark, [("x", 2)])}, folder)
    bad = part(spark, [("x", 9)]).withColumn("n", F.expr("if(n = 9, raise_error('gone'), n)").cast("int"))
    with pytest.raises(Exception, match="gone"):
        versions.replace_parts({"a": part(spark, [("x", 7)]), "b": bad}, folder, ["x"])
    assert held(spark, folder, "a") == [("x", 1)] and held(spark, folder, "b") == [("x", 2)]


def test_folders_of_replaced_and_failed_runs_go(spark, folder):
    for k in range(4):
        versions.replace_parts({"t": part(spark, [("x", k)])}, folder, ["x"])
    (Path(folder) / "t/run=failed").mkdir()
    versions.replace_parts({"t": part(spark, [("x", 9)])}, folder, ["x"])
    assert held(spark, folder) == [("x", 9)]
    assert len([p for p in Path(f"{folder}/t").iterdir() if p.name.startswith("run=")]) == 2
    assert len(versions.finished(spark, f"{folder}/manifest")) == 2


# Rollups.

STORED = {"atendime": "dt_atendimento", "aviso_cirurgia": "dt_realizacao", "pre_med": "dt_pre_med"}
CHILDREN = {"itpre_med": ("pre_med", "cd_pre_med"), "cirurgia_aviso": ("aviso_cirurgia", "cd_aviso_cirurgia"), "prestador_aviso": ("aviso_cirurgia", "cd_aviso_cirurgia")}
KEPT = ("encounters", "procedures", "leads", "products", "prescribers")


def ingest(tables_, folder, names=(*STORED, *CHILDREN)):
    for name in names:
        if name in STORED:
            ingest_table(tables_[name], name, folder, STORED[name])
        else:
            parent, key = CHILDREN[name]
            ingest_table(tables_[name], name, folder, STORED[parent], parent=tables_[parent], key=key)


def check_answers(spark, out, tables_, as_of):
    for key, (rollup, _) in rollups.ANSWERS.items():
        if rollup in KEPT:
            got, want = (values(df) for df in (rollups.answer(spark, out, key, tables_, as_of), find(key).build(tables_, as_of)))
            assert sorted(got, key=str) == sorted(want, key=str), key


def test_rollups_read_changed_months_only(spark, folder):
    tables_ = hospital_tables(spark, SF)
    source, out = f"{folder}/source", f"{folder}/rollups"
    ingest(tables_, source)
    first = rollups.refresh(spark, source, out, KEPT)
    assert all(len(months) > 6 for months in first.values()) and "none" in first["leads"]
    check_answers(spark, out, tables_, HOSPITAL_AS_OF)
    assert rollups.refresh(spark, source, out, KEPT) == dict.fromkeys(KEPT, [])

    more = tables_["pre_med"].where("date_format(dt_pre_med, 'yyyy-MM') = '2001-03'").limit(5).withColumn("cd_pre_med", -F.col("cd_pre_med"))
    items = tables_["itpre_med"].join(more.select((-F.col("cd_pre_med")).alias("cd_pre_med")), "cd_pre_med", "left_semi")
    items = items.withColumn("cd_pre_med", -F.col("cd_pre_med"))
    ingest_table(more, "pre_med", source, "dt_pre_med", mode="append")
    ingest_table(items, "itpre_med", source, "dt_pre_med", mode="append", parent=more, key="cd_pre_med")
    assert rollups.refresh(spark, source, out, KEPT) == {**dict.fromkeys(KEPT, []), "products": ["2001-03"], "prescribers": ["2001-03"]}
    now = {**tables_, "pre_med": tables_["pre_med"].unionByName(more.select(tables_["pre_med"].columns)), "itpre_med": tables_["itpre_med"].unionByName(items)}
    check_answers(spark, out, now, HOSPITAL_AS_OF)


def test_a_month_that_goes_is_empty_and_its_scan_is_pruned(spark, folder):
    tables_ = hospital_tables(spark, SF)
    source, out = f"{folder}/source", f"{folder}/rollups"
    ingest(tables_, source, ["pre_med", "itpre_med"])
    rollups.refresh(spark, source, out, ["products"])
    stored = read_parquet_tables(spark, source, ["pre_med", "itpre_med"])
    plan = rollups.ROLLUPS["products"].counted(stored, ["2001-03"])._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert len(scans) == 2 and all("PartitionFilters: [isnotnull(dt_pre_med_month" in x for x in scans)
    for table in ("pre_med", "itpre_med"):
        versions.drop(spark, f"{source}/{table}/dt_pre_med_month=2001-03")
    assert rollups.refresh(spark, source, out, ["products"]) == {"products": ["2001-03"]}
    left = rollups.read_rollup(spark, out, "products")
    assert left.where("date_format(dt_pre_med, 'yyyy-MM') = '2001-03'").count() == 0 and left.count() > 0
    assert rollups.refresh(spark, source, out, ["products"]) == {"products": []}


def test_a_rollup_is_read_from_a_month_on(spark, folder):
    rollups.store(hospital_tables(spark, SF), folder, ["products"])
    some = rollups.read_rollup(spark, folder, "products", datetime(2001, 3, 15))
    assert some.agg(F.min("dt_pre_med")).first()[0] >= datetime(2001, 3, 1)
    whole = rollups.read_rollup(spark, folder, "products")
    assert some.count() == whole.where("dt_pre_med >= timestamp_ntz'2001-03-01'").count() < whole.count()


def test_rollups_of_facts_without_rows_or_dates(spark, folder):
    data = tables(spark, aviso_cirurgia=[{"cd_aviso_cirurgia": 1, "tp_situacao": "R", "cd_multi_empresa": 1}],
                  cirurgia_aviso=[{"cd_cirurgia_aviso": 1, "cd_aviso_cirurgia": 1, "cd_cirurgia": 5}],
                  prestador_aviso=[{"cd_aviso_cirurgia": 1, "cd_cirurgia_aviso": 1, "cd_prestador": 2, "sn_principal": "S"}],
                  prestador=[{"cd_prestador": 2, "nm_prestador": "Dr"}])
    rollups.store(data, folder)
    for key in rollups.ANSWERS:
        assert values(rollups.answer(spark, folder, key, data, AS_OF)) == values(find(key).build(data, AS_OF)), key
    assert values(rollups.answer(spark, folder, "cirurgias_realizadas_por_medico", data, AS_OF)) == [(None, "Dr", 1)]


# The history of snapshots.

def result(spark, at, unit, texts):
    rows = [(at, unit, t) for t in texts]
    kind = "as_of timestamp_ntz, unit_id bigint, text string"
    return {"alerts": spark.createDataFrame(rows, kind), "metrics": spark.createDataFrame([(at, unit, "m")], kind)}


def test_a_snapshot_written_twice_is_one(spark, folder):
    later = datetime(2024, 5, 15, 13)
    for _ in range(2):
        runs.save_snapshot(result(spark, AS_OF, 1, ["a", "b"]), folder, AS_OF)
    runs.save_snapshot(result(spark, later, 1, ["c"]), folder, later)
    runs.save_snapshot(result(spark, AS_OF, 12, ["d"]), folder, AS_OF, 12)

    def texts(table="alerts", **bounds):
        return sorted((r.as_of, r.unit_id, r.text) for r in runs.read_history(spark, folder, table, **bounds).collect())

    assert texts() == [(AS_OF, 1, "a"), (AS_OF, 1, "b"), (AS_OF, 12, "d"), (later, 1, "c")]
    assert texts(since=later) == [(later, 1, "c")] and len(texts(before=later)) == 3
    runs.save_snapshot(result(spark, AS_OF, 1, []), folder, AS_OF)  # no alerts any more
    assert texts() == [(AS_OF, 12, "d"), (later, 1, "c")] and len(texts("metrics")) == 3


def test_a_failed_snapshot_leaves_the_one_before(spark, folder):
    runs.save_snapshot(result(spark, AS_OF, 1, ["a"]), folder, AS_OF)
    bad = result(spark, AS_OF, 1, ["b"])
    bad["metrics"] = bad["metrics"].withColumn("text", F.expr("raise_error('gone')").cast("string"))
    with pytest.raises(Exception, match="gone"):
        runs.save_snapshot(bad, folder, AS_OF)
    assert [r.text for r in runs.read_history(spark, folder, "alerts").collect()] == ["a"]


def test_a_whole_snapshot_is_saved(spark, folder):
    found = runs.snapshot(spark, hospital_tables(spark, SF), HOSPITAL_AS_OF)
    runs.save_snapshot(found, folder, HOSPITAL_AS_OF)
    for name, df in found.items():
        assert runs.read_history(spark, folder, name).count() == df.count()


# The run log.

def jobs_of(spark, work):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_query_runs_once(spark, folder):
    """The rows are made once, however long the result is and whoever uses it; a detail query is not stored."""
    made = spark.sparkContext.accumulator(0)

    def build(tables_, as_of):
        counted = spark.sparkContext.parallelize(range(60), 3).map(lambda k: (made.add(1), (k % 50, k))[1])
        return spark.createDataFrame(counted, "a int, b int").orderBy(F.desc("a"), "b")

    row, stored = runs.run_query(Query("UTI", "q", build), {}, AS_OF, folder)
    sorting = made.value  # the sort looks at its input for its ranges, then sorts it
    assert row[3] == 60 and row[6] and row[4] == ["a", "b"]
    assert row[5][:3] == ['{"a":49,"b":49}', '{"a":48,"b":48}', '{"a":47,"b":47}'] and len(row[5]) == 20
    assert stored.count() == 60 and sorted(values(stored)) == sorted((k % 50, k) for k in range(60))
    assert made.value == sorting <= 120
    row, stored = runs.run_query(Query("UTI", "d", build, detail=True), {}, AS_OF, folder)
    assert row[3] == 60 and len(row[5]) == 20 and stored is None


def test_a_result_costs_two_jobs(spark, folder):
    counts = [
        jobs_of(spark, lambda q=Query("UTI", f"q{rows}", lambda tables_, as_of, n=rows: spark.range(n).toDF("n")): runs.run_query(q, {}, AS_OF, folder))
        for rows in (5, 5000)
    ]
    assert counts == [2, 2]


def test_metrics_read_the_stored_results(spark, monkeypatch):
    """A snapshot builds each query once."""
    built, real = [], runs.catalog()

    def noting(query):
        def build(tables_, as_of):
            built.append(query.key)
            return query.build(tables_, as_of)

        return Query(query.area, query.key, build, query.detail)

    monkeypatch.setattr(runs, "catalog", lambda: [noting(q) for q in real])
    monkeypatch.setattr(runs, "find", lambda key: next(q for q in runs.catalog() if q.key == key))
    found = runs.snapshot(spark, hospital_tables(spark, SF), HOSPITAL_AS_OF)
    assert found["metrics"].count() == 10 and sorted(built) == sorted(q.key for q in real)

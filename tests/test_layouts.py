"""Facts joined where they lie, and unbounded detail page by page."""

import uuid

import pytest
from hospital import AS_OF, at, tables, values
from pyspark.sql import functions as F

from wardlight.operators.pharmacy import PageKey
from wardlight.plans.catalog import find, prescribed_items_page
from wardlight.session import shared_folder
from wardlight.sources import versions
from wardlight.sources.driver_tables import HOSPITAL_AS_OF, hospital_tables
from wardlight.sources.tables import ingest_bucketed, ingest_table, read_catalog_tables, read_parquet_tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def bucketed(spark):
    raw, database = hospital_tables(spark, SF), f"hospital_{uuid.uuid4().hex[:8]}"
    spark.sql(f"create database {database}")
    for name, key in (("pre_med", "cd_pre_med"), ("itpre_med", "cd_pre_med"), ("aviso_cirurgia", "cd_aviso_cirurgia"), ("cirurgia_aviso", "cd_aviso_cirurgia")):
        ingest_bucketed(raw[name], name, key, 4, database)
    yield raw, {**raw, **read_catalog_tables(spark, database, ["pre_med", "itpre_med", "aviso_cirurgia", "cirurgia_aviso"])}
    spark.sql(f"drop database {database} cascade")


@pytest.mark.parametrize("key,by", [
    ("medicamentos_alto_risco", "cd_pre_med"), ("antibioticos_vs_analgesicos", "cd_pre_med"), ("medicacao_administrada", "cd_pre_med"),
    ("medicamentos_prescritos_por_medico", "cd_pre_med"), ("cirurgias_realizadas_por_tipo", "cd_aviso_cirurgia"),
    ("cirurgias_realizadas_por_porte_12m", "cd_aviso_cirurgia"), ("tempo_medio_por_tipo_cirurgia", "cd_aviso_cirurgia"),
])
def test_facts_are_joined_without_a_shuffle(spark, bucketed, key, by):
    raw, stored = bucketed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole, moved = find(key).build(stored, HOSPITAL_AS_OF), find(key).build(raw, HOSPITAL_AS_OF)
        assert f"Exchange hashpartitioning({by}" not in plan(whole) and f"Exchange hashpartitioning({by}" in plan(moved)
        assert sorted(values(whole), key=str) == sorted(values(moved), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("key", ["top_20_medicamentos_ps", "top_20_medicamentos_sc"])
def test_items_stay_where_they_lie_when_prescriptions_move(spark, bucketed, key):
    """Prescriptions are first cut by their encounters, which moves them; the far more numerous items are not moved."""
    raw, stored = bucketed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = find(key).build(stored, HOSPITAL_AS_OF)
        assert plan(whole).count("Exchange hashpartitioning(cd_pre_med") == 1
        assert values(whole) == values(find(key).build(raw, HOSPITAL_AS_OF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def pages(tables_, size):
    out, key = [], None
    while True:
        found, key = prescribed_items_page(tables_, size, key)
        assert len(found) == size if key else len(found) <= size
        out.append([tuple(r) for r in found])
        if key is None:
            return out


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_pages_are_the_slices_of_the_whole(spark, size):
    """With ties, repeated rows, undated prescriptions and months without any."""
    dates = [None, None, "2024-05-15", "2024-05-15", "2024-05-01", "2024-04-30", "2023-12-31"]
    data = tables(
        spark, pre_med=[{"cd_pre_med": k, "cd_prestador": 1, "dt_pre_med": at(d)} for k, d in enumerate(dates)],
        itpre_med=[{"cd_itpre_med": i, "cd_pre_med": k, "cd_produto": 1 + i % 2} for k in range(len(dates)) for i in (1, 2, 2, 2)][::-1],
        produto=[{"cd_produto": 1, "ds_produto": "A"}, {"cd_produto": 2, "ds_produto": "B"}], prestador=[{"cd_prestador": 1, "nm_prestador": "Dr"}],
    )
    whole = values(find("medicacao_administrada").build(data, AS_OF))
    got = [r for page in pages(data, size) for r in page]
    assert got == whole and len(whole) == 28


def test_pages_of_stored_tables_read_their_months_only(spark):
    raw, folder = hospital_tables(spark, SF), shared_folder(spark, "test")
    ingest_table(raw["pre_med"], "pre_med", folder, "dt_pre_med")
    ingest_table(raw["itpre_med"], "itpre_med", folder, "dt_pre_med", parent=raw["pre_med"], key="cd_pre_med")
    stored = {**raw, **read_parquet_tables(spark, folder, ["pre_med", "itpre_med"])}
    rows = sorted(values(find("medicacao_administrada").build(raw, HOSPITAL_AS_OF)), key=lambda r: r[1:])
    whole = sorted(rows, key=lambda r: r[0].split("/")[::-1], reverse=True)[:60]  # a stable sort
    first, key = prescribed_items_page(stored, 30)
    second, _ = prescribed_items_page(stored, 30, key)
    assert [tuple(r) for r in first + second] == whole and isinstance(key, PageKey)
    for (month,) in raw["pre_med"].where("dt_pre_med < timestamp_ntz'2001-01-01'").select(F.date_format("dt_pre_med", "yyyy-MM")).distinct().collect():
        versions.drop(spark, f"{folder}/itpre_med/dt_pre_med_month={month}")
    left = {**raw, **read_parquet_tables(spark, folder, ["pre_med", "itpre_med"])}
    assert prescribed_items_page(left, 30) == (first, key)


def test_pages_of_nothing(spark):
    assert prescribed_items_page(tables(spark), 5) == ([], None)
    with pytest.raises(ValueError):
        prescribed_items_page(tables(spark), 0)

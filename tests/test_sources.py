import json
from pathlib import Path

import pytest
from hospital import AS_OF, table, tables, values
from pyspark.sql import functions as F

from wardlight.operators import counting
from wardlight.plans.catalog import find
from wardlight.session import shared_folder
from wardlight.schemas import schema
from wardlight.sources import sinks
from wardlight.sources.tables import ingest_table, normalised, read_parquet_tables


def test_tables_are_normalised(spark):
    df = spark.createDataFrame([(1, "", "x", 5)], "CD_CID int, DS_CID string, NOTE string, OTHER int")
    assert values(normalised(df)) == [(1, None, "x", 5)]
    known = normalised(df, "cid")
    assert known.columns == ["cd_cid", "ds_cid"] and values(known) == [("1", None)]


def test_parquet_round_trip(spark, tmp_path):
    given = tables(spark, cid=[{"cd_cid": "A", "ds_cid": ""}], produto=[{"cd_produto": 1, "ds_produto": "x"}])
    for name in ("cid", "produto"):
        ingest_table(given[name], name, str(tmp_path))
    read = read_parquet_tables(spark, str(tmp_path), ["cid", "produto"])
    assert values(read["cid"]) == [("A", None)] and values(read["produto"]) == [(1, "x")]
    given["cid"].write.mode("overwrite").parquet(str(tmp_path / "cid"))
    assert values(read_parquet_tables(spark, str(tmp_path), ["cid"])["cid"]) == [("A", "")]
    assert values(read_parquet_tables(spark, str(tmp_path), ["cid"], blank_is_null=True)["cid"]) == [("A", None)]


def test_text_and_date_filters_reach_ingested_tables(spark, tmp_path):
    rows = [{"cd_atendimento": i, "tp_atendimento": "I", "dt_atendimento": AS_OF} for i in range(3)]
    ingest_table(table(spark, "atendime", rows), "atendime", str(tmp_path), "dt_atendimento")
    read = read_parquet_tables(spark, str(tmp_path), ["atendime"])["atendime"]
    found = counting.in_span(read, "dt_atendimento", "2024-05-01").filter(F.col("tp_atendimento") == "I")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    assert "EqualTo(tp_atendimento,I)" in plan(found) and "GreaterThanOrEqual(dt_atendimento" in plan(found)
    assert found.count() == 3
    admitted = find("internados").build({"atendime": read}, AS_OF)
    assert "(dt_atendimento_month#" in plan(admitted).split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert read.drop("dt_atendimento_month").columns == [f.name for f in schema("atendime")]


def test_facts_are_laid_out_by_month(spark, tmp_path):
    df = spark.range(100).withColumn("t", F.expr("timestamp_ntz'2024-01-15' + make_interval(0, cast(id % 3 as int))"))
    path = str(tmp_path / "facts")
    sinks.write_facts(df, path, "t")
    back = spark.read.parquet(path)
    assert back.count() == 100 and back.select("t_month").distinct().count() == 3
    kept = counting.in_span(back, "t", "2024-02-01", up_to="2024-02-28")
    assert "(t_month#" in plan(kept).split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert kept.count() == back.filter("t < '2024-02-28' and t >= '2024-02-01'").count() == 33


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_shuffle(spark):
    for name in ("bucket_a", "bucket_b"):
        sinks.write_bucketed(spark.range(1000).withColumnRenamed("id", "k").withColumn(name, F.lit(1)), name, "k", 4)
    joined = spark.table("bucket_a").hint("merge").join(spark.table("bucket_b"), "k")
    assert "Exchange" not in plan(joined) and joined.count() == 1000


@pytest.mark.parametrize("key", [
    "fila_recepcao", "fila_triagem", "fila_medicacao", "media_espera_classificacao", "atendimento_por_horario",
])
def test_children_are_pruned_by_their_parents_month(spark, tmp_path, key):
    """Even with no broadcast and no runtime filter, other months' steps are not read; the rows are the same."""
    from wardlight.sources.driver_tables import HOSPITAL_AS_OF, hospital_tables

    raw = hospital_tables(spark, "/root/testdata/sf0.001")
    visits, children = raw["triagem_atendimento"], ("sacr_tempo_processo", "sacr_pendencia_sala")
    ingest_table(visits, "triagem_atendimento", str(tmp_path), "dh_pre_atendimento")
    for child in children:
        ingest_table(raw[child], child, str(tmp_path), "dh_pre_atendimento", parent=visits, key="cd_triagem_atendimento")
    stored = read_parquet_tables(spark, str(tmp_path), ["triagem_atendimento", *children])
    assert all(stored[c].count() == raw[c].count() for c in children)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1k"}
    before = {k: spark.conf.get(k) for k in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        built = find(key).build({**raw, **stored}, HOSPITAL_AS_OF)
        scans = [x for x in plan(built).splitlines() if "FileScan" in x and "cd_tipo_tempo_processo" in x or "FileScan" in x and "sacr_tempo_processo" in x]
        assert scans and all("PartitionFilters: [isnotnull(dh_pre_atendimento_month" in x for x in scans if "dh_pre_atendimento_month" in x)
        assert any("dh_pre_atendimento_month" in x for x in scans)
        assert built.collect() == find(key).build(raw, HOSPITAL_AS_OF).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@pytest.mark.parametrize("key,parent,ts,id_,child", [
    ("medicamentos_alto_risco", "pre_med", "dt_pre_med", "cd_pre_med", "itpre_med"),
    ("antibioticos_vs_analgesicos", "pre_med", "dt_pre_med", "cd_pre_med", "itpre_med"),
    ("top_20_medicamentos_ps", "pre_med", "dt_pre_med", "cd_pre_med", "itpre_med"),
    ("medicamentos_prescritos_por_medico", "pre_med", "dt_pre_med", "cd_pre_med", "itpre_med"),
    ("cirurgias_realizadas_por_porte_12m", "aviso_cirurgia", "dt_realizacao", "cd_aviso_cirurgia", "cirurgia_aviso"),
    ("retorno", "atendime", "hr_atendimento", "cd_atendimento", "coleta_sinal_vital"),
    ("retorno", "atendime", "hr_atendimento", "cd_atendimento", "pre_med"),
    ("retorno", "atendime", "hr_atendimento", "cd_atendimento", "triagem_atendimento"),
])
def test_child_facts_are_pruned_by_their_parents_month(spark, tmp_path, key, parent, ts, id_, child):
    """The child's scan has the parent's months as a partition filter; the rows are the same."""
    from wardlight.sources.driver_tables import HOSPITAL_AS_OF, hospital_tables

    raw = hospital_tables(spark, "/root/testdata/sf0.001")
    ingest_table(raw[parent], parent, str(tmp_path), ts)
    ingest_table(raw[child], child, str(tmp_path), ts, parent=raw[parent], key=id_)
    stored = read_parquet_tables(spark, str(tmp_path), [parent, child])
    assert stored[child].count() == raw[child].count() and stored[child].select(f"{ts}_month").distinct().count() > 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        built = find(key).build({**raw, **stored}, HOSPITAL_AS_OF)
        scans = [x for x in plan(built).splitlines() if "FileScan" in x and f"/{child}]" in x]
        assert scans and all(f"PartitionFilters: [isnotnull({ts}_month" in x for x in scans)
        assert built.collect() == find(key).build(raw, HOSPITAL_AS_OF).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_readings_are_pruned_by_their_encounters_month(spark, tmp_path):
    from wardlight.sources.driver_tables import HOSPITAL_AS_OF, hospital_tables

    raw = hospital_tables(spark, "/root/testdata/sf0.001")
    dated = raw["coleta_sinal_vital"].join(raw["atendime"].select("cd_atendimento", "hr_atendimento"), "cd_atendimento")
    ingest_table(raw["itcoleta_sinal_vital"], "itcoleta_sinal_vital", str(tmp_path), "hr_atendimento", parent=dated, key="cd_coleta_sinal_vital")
    stored = read_parquet_tables(spark, str(tmp_path), ["itcoleta_sinal_vital"])
    built = find("retorno").build({**raw, **stored}, HOSPITAL_AS_OF)
    assert "PartitionFilters: [isnotnull(hr_atendimento_month" in plan(built)
    assert built.collect() == find("retorno").build(raw, HOSPITAL_AS_OF).collect()


def test_alerts_as_json(spark, tmp_path):
    df = spark.createDataFrame(
        [(AS_OF, 1, "UTI", "alta", "UTI em lotação", "Ocupação UTI em 93.0%", AS_OF)],
        "as_of timestamp_ntz, unit_id bigint, area string, prioridade string, titulo string, descricao string, timestamp timestamp_ntz",
    )
    sinks.write_alerts_json(df, str(tmp_path / "alerts"))
    line = json.loads("".join(f.read_text() for f in Path(tmp_path / "alerts").glob("*.json")))
    assert line == {"as_of": "2024-05-15T12:00:00.000000Z", "unit_id": 1, "area": "UTI", "prioridade": "alta", "titulo": "UTI em lotação", "descricao": "Ocupação UTI em 93.0%",
                    "timestamp": "2024-05-15T12:00:00.000000Z"}


def test_shared_folder_is_below_the_configured_one(spark):
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))

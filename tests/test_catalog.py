import dataclasses
import glob
from collections.abc import Mapping
from datetime import timedelta

import pytest
from hospital import AS_OF, at, tables, values

from wardlight import fixed
from wardlight.operators import annotations
from wardlight.plans import runs
from wardlight.plans.catalog import Query, catalog, find
from wardlight.plans.runs import METRIC_SOURCES, query_label, run_catalog, run_catalog_results, snapshot
from wardlight.schemas import SOURCE_DDL, schema
from wardlight.sources.driver_tables import HOSPITAL_AS_OF, hospital_tables

TODAY = at("2024-05-15 08:00")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def data(spark):
    def encounter(number, kind="U", company=2, **more):
        return {"cd_atendimento": number, "cd_paciente": 1, "tp_atendimento": kind, "cd_multi_empresa": company,
                "dt_atendimento": TODAY, "hr_atendimento": TODAY, "sn_obito": "N", **more}

    return tables(
        spark,
        atendime=[
            encounter(1, cd_prestador=7, cd_cid="A1"),
            encounter(2, cd_cid="missing"),
            encounter(3, "I", 1),
            encounter(4, "I", 1, cd_atendimento_pai=3),
            encounter(5, "I", 1, dt_atendimento=at("2024-05-01"), dt_alta=TODAY, dt_alta_medica=TODAY, cd_leito=1,
                      dt_prevista_alta=TODAY, sn_obito="S"),
            encounter(6, "I", 1, dt_atendimento=at("2024-05-01"), dt_prevista_alta=TODAY),
            encounter(7, "I", 1, dt_atendimento=at("2023-01-01"), dt_alta=at("2023-05-14"), sn_obito="S"),
        ],
        paciente=[{"cd_paciente": 1, "nm_paciente": "P", "dt_nascimento": at("1964-05-16")}],
        triagem_atendimento=[
            {"cd_triagem_atendimento": t, "cd_atendimento": t, "dh_pre_atendimento": TODAY, "cd_multi_empresa": 2,
             "cd_fila_senha": 7, "cd_cor_referencia": c, "ds_queixa_principal": "dor"} for t, c in ((1, 2), (8, 9), (9, None))
        ],
        sacr_tempo_processo=[
            {"cd_triagem_atendimento": t, "cd_tipo_tempo_processo": s, "dh_processo": TODAY + timedelta(minutes=m)}
            for t, s, m in ((1, 1, 0), (1, 11, 30), (1, 12, 40), (8, 1, 0), (9, 22, 0), (9, 31, 90))
        ],
        sacr_tipo_tempo_processo=[{"cd_tipo_tempo_processo": s} for s in (1, 11, 12, 22, 31)],
        coleta_sinal_vital=[
            {"cd_coleta_sinal_vital": c, "cd_atendimento": 1, "data_coleta": TODAY + timedelta(hours=c)} for c in (1, 2)
        ],
        itcoleta_sinal_vital=[
            {"cd_coleta_sinal_vital": c, "cd_sinal_vital": s, "valor": v} for c, s, v in ((1, 1, 36.0), (2, 1, 38.5), (1, 11, 97.0))
        ],
        pre_med=[{"cd_pre_med": 1, "cd_atendimento": 1, "cd_prestador": 7, "dt_pre_med": TODAY}],
        itpre_med=[
            {"cd_itpre_med": i, "cd_pre_med": 1, "cd_produto": p, "sn_cancelado": c, "ds_itpre_med": t}
            for i, p, c, t in ((1, 2, None, None), (2, 1, "N", "Se dor"), (3, 3, "S", None))
        ],
        produto=[{"cd_produto": p, "ds_produto": n} for p, n in ((1, "Dipirona"), (2, "Soro"), (3, "Cefalexina"))],
        prestador=[{"cd_prestador": 7, "nm_prestador": "Dr"}],
        cid=[{"cd_cid": "A1", "ds_cid": "Cólera"}],
        diagnostico_atendime=[{"cd_atendimento": 5, "cd_cid": "A1"}],
        leito=[{"cd_leito": 1, "cd_unid_int": 1, "tp_ocupacao": "O"}],
        unid_int=[{"cd_unid_int": 1, "ds_unid_int": "Uti 1", "sn_ativo": "S"}],
        aviso_cirurgia=[
            {"cd_aviso_cirurgia": a, "cd_multi_empresa": 1, "tp_situacao": s, "dt_aviso_cirurgia": TODAY, "dt_realizacao": d,
             "dt_inicio_cirurgia": TODAY, "dt_fim_cirurgia": TODAY + timedelta(seconds=7182)}
            for a, s, d in ((1, "R", TODAY), (2, "R", None), (3, "at", None))
        ],
        cirurgia_aviso=[{"cd_cirurgia_aviso": 1, "cd_aviso_cirurgia": a, "cd_cirurgia": 1} for a in (1, 2, 3)],
        cirurgia=[{"cd_cirurgia": 1, "ds_cirurgia": "Apendicectomia", "tp_cirurgia": "X"}],
        prestador_aviso=[
            {"cd_aviso_cirurgia": a, "cd_cirurgia_aviso": n, "cd_prestador": 7, "sn_principal": s}
            for a, n, s in ((1, 1, "S"), (2, 1, "S"), (1, 2, "S"), (1, 1, "N"))
        ],
        solicitacao_os=[
            {"cd_os": 1, "cd_oficina": 5, "tp_situacao": "A", "dt_pedido": TODAY, "ds_servico": "porta"},
            {"cd_os": 2, "cd_oficina": 5, "tp_situacao": "S", "dt_pedido": AS_OF - timedelta(hours=30), "ds_servico_geral": "luz"},
            {"cd_os": 3, "cd_oficina": 4, "tp_situacao": "A", "dt_pedido": TODAY},
        ],
    )


EXPECTED = {
    "evolucao_atendimentos_internacao": [("05/2024", "Internação", 3)],
    "evolucao_atendimentos_externos": [],
    "evolucao_atendimentos_ambulatorio": [],
    "internacao_e_altas": [(1, "Internados Hoje", 1), (2, "Altas Hospitalar", 1), (3, "Altas Médicas", 1),
                           (4, "Previsão de Altas", 2), (5, "Previsão de Altas com Atraso", 1)],
    "obitos_mes": [("2024-05", 1)],
    "evolucao_atendimentos_urgencia": [("05/2024", "Urgência", 2)],
    "fila_recepcao": [(1,)],
    "fila_triagem": [(1,)],
    "fila_atendimento_medico": [(0,)],
    "fila_medicacao": [(0,)],
    "media_espera_classificacao": [(30.0, 30.0)],
    "media_espera_atendimento_medico": [(90.0, 90.0)],
    "media_espera_cadastro": [(0.0, None)],
    "qtd_pacientes_retorno_7_dias": [(0,)],
    "retorno": [
        (1, 1, "P", "15/05/2024 08:00", "Dr", "A1 - Cólera", "VERMELHO", "dor", 38.5, None, None, None, 97.0, None, "Dipirona | Soro"),
        (2, 1, "P", "15/05/2024 08:00", None, " - ", "NÃO CLASSIFICADO", None, None, None, None, None, None, None, None),
    ],
    "internados": [(1,)],
    "leito_uti": [(1,)],
    "tmp_por_setor": [("Uti 1", 14.33)],
    "obitos_faixa_etaria_cid": [("18–59", "A1", "Cólera", 1)],
    "cirurgias_status_mes": [("2024-05", "R", 2), ("2024-05", "at", 1)],
    "cirurgias_realizadas_por_tipo": [("2024-05", "Apendicectomia", 1)],
    "medicamentos_alto_risco": [("2024-05", "Dipirona", 1), ("2024-05", "Soro", 1)],
    "top_20_medicamentos_ps": [("Soro", 1, 1)],
    "top_20_medicamentos_sc": [],
    "antibioticos_vs_analgesicos": [(at("2024-05-01"), "ANALGESICO", 1), (at("2024-05-01"), "OUTROS", 1)],
    "tempo_medio_por_tipo_cirurgia": [("Apendicectomia", 1, 60.0)],
    "cirurgias_realizadas_por_porte_12m": [("05/2024", None, 1)],
    "cirurgias_realizadas_por_medico": [("2024-05", "Dr", 1), (None, "Dr", 1)],
    "os_manutencao_aberta_ate_12h": [(1, "A", TODAY, 4.0, "porta", None)],
    "os_manutencao_aberta_12_24h": [],
    "os_manutencao_aberta_mais_24h": [(2, "S", AS_OF - timedelta(hours=30), 30.0, "luz", None)],
    "medicacao_administrada": [("15/05/2024", 1, 1, "Soro", "Dr")],
    "medicamentos_prescritos_por_medico": [("Dr", 2)],
    "atendimento_por_horario": [("15/05/2024", "08", 2)],
}


def test_the_catalog_is_complete():
    assert [q.key for q in catalog()] == list(EXPECTED) and len(catalog()) == 34
    assert {q.area for q in catalog()} == set(fixed.AREAS)


@pytest.mark.parametrize("key", list(EXPECTED))
def test_catalog_query(data, key):
    assert sorted(values(find(key).build(data, AS_OF)), key=str) == sorted(EXPECTED[key], key=str)


def test_run_log_isolates_failures_and_keeps_a_sample(spark, data):
    broken = Query("UTI", "quebrada", lambda tables, as_of: tables["nope"])
    failing = Query("UTI", "falha", lambda tables, as_of: tables["cid"].selectExpr("raise_error('x') as y"))
    many = Query("UTI", "muitas_12h", lambda tables, as_of: spark.range(25).toDF("n"))
    none = Query("UTI", "nenhuma", lambda tables, as_of: tables["cid"].filter("false"))
    log = {r.query_key: r for r in run_catalog(spark, data, AS_OF, [broken, failing, many, none]).collect()}
    assert log["quebrada"].row_count == 0 and "nope" in log["quebrada"].error and log["falha"].error
    assert (log["muitas_12h"].row_count, log["muitas_12h"].truncated, len(log["muitas_12h"].sample)) == (25, True, 20)
    assert log["muitas_12h"].sample[0] == '{"n":0}' and log["muitas_12h"].columns == ["n"]
    assert log["nenhuma"].error is None and log["nenhuma"].columns == []
    assert log["muitas_12h"].query_label == "Muitas 12H"
    assert query_label("cirurgias_realizadas_por_porte_12m") == "Cirurgias Realizadas Por Porte 12M"


def test_snapshot(spark, data):
    result = snapshot(spark, data, AS_OF)
    figures = {r.metric: r.value for r in result["metrics"].collect()}
    assert figures == {
        "ocupacao_percent": 50.0, "obitos_mes_atual": 1.0, "fila_total": 2.0, "tempo_medio_espera_min": 25.0,
        "ocupacao_uti_percent": 1 / 30.0 * 100, "pacientes_criticos": 1.0, "cirurgias_atrasadas": 1.0,
        "taxa_cancelamento_percent": 33.33, "itens_ruptura": 0.0, "itens_alto_risco_baixo": 2.0,
    }
    assert sorted((r.titulo, r.rank) for r in result["alerts"].collect()) == [("Cancelamentos elevados", 1)]
    classes = {r.query_key: r.classification for r in result["run_log"].collect()}
    assert len(classes) == 34 and classes["os_manutencao_aberta_mais_24h"] == "crítica"
    titles = {r.title for r in result["findings"].collect()}
    assert titles == {"Risco de vício/uso recorrente em medicação", "Conferência de prescrição", "Manutenção com fila envelhecida"}
    summary = result["summary"].first()
    assert (summary.queries, summary.errors, summary.high_alerts) == (34, 0, 1)


@pytest.mark.parametrize("key", sorted(METRIC_SOURCES.values()))
def test_snapshot_survives_a_failing_query(spark, data, key, monkeypatch):
    """The run log, the failure's alert and the other metrics come back; the lost ones are unknown, not 0."""
    real = runs.catalog()

    def broken(tables, as_of):
        raise RuntimeError("source is gone")

    query = next(q for q in real if q.key == key)
    bad = dataclasses.replace(query, build=broken)
    monkeypatch.setattr(runs, "catalog", lambda: [bad if q.key == key else q for q in real if q.key in METRIC_SOURCES.values()])
    monkeypatch.setattr(runs, "find", lambda k: next(q for q in runs.catalog() if q.key == k))
    result = snapshot(spark, data, AS_OF)
    errors = {r.query_key: r.error for r in result["run_log"].collect() if r.error}
    assert set(errors) == {key}
    figures = {r.metric: r.value for r in result["metrics"].collect()}
    lost = {m for m, v in figures.items() if v is None}
    assert len(figures) == 10 and lost and lost == {
        "internacao_e_altas": {"ocupacao_percent"}, "obitos_mes": {"obitos_mes_atual"},
        "fila_recepcao": {"fila_total", "tempo_medio_espera_min"}, "fila_triagem": {"fila_total", "tempo_medio_espera_min"},
        "internados": {"ocupacao_uti_percent", "pacientes_criticos"},
        "cirurgias_status_mes": {"cirurgias_atrasadas", "taxa_cancelamento_percent"},
        "medicamentos_alto_risco": {"itens_alto_risco_baixo"},
    }[key]
    assert result["alerts"].count() >= 1 and result["summary"].first().errors == 1
    states = {r.metric: r.status for r in result["status"].collect()}
    assert all(states[m] == fixed.STATUS_UNKNOWN for m in lost)


def test_two_notes_for_one_alert_give_one_alert(spark):
    rows = [(None, 1, "UTI", "alta", "UTI em lotação", "texto", None)]
    found = spark.createDataFrame(rows, schema("alerts"))
    notes = spark.createDataFrame([("UTI", "UTI em lotação", "media", "primeira", 1), ("UTI", "UTI em lotação", "baixa", "segunda", 2)],
                                  "area string, titulo string, prioridade string, descricao_contextual string, seq bigint")
    got = annotations.annotate_alerts(found, notes).collect()
    assert [r.prioridade for r in got] == ["baixa"] and got[0].descricao.endswith("segunda")


def test_snapshot_with_annotations(spark, data):
    notes = spark.createDataFrame([("Centro Cirúrgico", "Cancelamentos elevados", "media", "x" * 600)], schema("alert_notes"))
    extra = spark.createDataFrame([(1, "UTI", "baixa", "Nova", "texto novo")], schema("alert_additions"))
    labels = spark.createDataFrame([(1, "obitos_mes", "crítica", "revisada")], schema("run_notes"))
    result = snapshot(spark, data, AS_OF, alert_notes=notes, extra_alerts=extra, run_notes=labels)
    assert [(r.titulo, r.problem) for r in result["quarantine"].collect()] == [("Cancelamentos elevados", "descricao")]
    assert [(r.titulo, r.prioridade) for r in result["alerts"].collect()] == [("Nova", "baixa")]
    run = result["run_log"].filter("query_key = 'obitos_mes'").first()
    assert (run.classification, run.summary) == ("crítica", "revisada")


def test_every_table_has_a_schema(data):
    assert set(data) == set(SOURCE_DDL) and len(SOURCE_DDL) == 21


# Queries that share a fact, and the large source table that they all read before.
SHARING = {
    "triagem_atendimento": ["fila_recepcao", "fila_triagem", "fila_atendimento_medico", "fila_medicacao", "media_espera_classificacao",
                            "media_espera_atendimento_medico", "media_espera_cadastro", "atendimento_por_horario"],
    "itpre_med": ["medicamentos_alto_risco", "top_20_medicamentos_ps", "top_20_medicamentos_sc", "antibioticos_vs_analgesicos",
                  "medicamentos_prescritos_por_medico"],
    "cirurgia_aviso": ["cirurgias_realizadas_por_tipo", "tempo_medio_por_tipo_cirurgia", "cirurgias_realizadas_por_porte_12m",
                       "cirurgias_realizadas_por_medico"],
    "pre_med": ["retorno"],
}


@pytest.mark.parametrize("table", list(SHARING))
def test_a_run_joins_a_history_once(spark, tmp_path, table):
    """Queries of a run share what they join alike, with the results that each has alone; nothing of it is left."""
    hospital, read = hospital_tables(spark, SF), []

    class Noting(Mapping):
        def __getitem__(self, name):
            read.append(name)
            return hospital[name]

        def __iter__(self):
            return iter(hospital)

        def __len__(self):
            return len(hospital)

    queries = [find(key) for key in SHARING[table]]
    left = set(facts_left(spark))
    log, found = run_catalog_results(spark, Noting(), HOSPITAL_AS_OF, queries, folder=str(tmp_path / "out"))
    assert [r.error for r in log.collect()] == [None] * len(queries)
    assert read.count(table) == 1 and set(facts_left(spark)) == left
    for query in queries:
        alone = sorted(values(query.build(hospital, HOSPITAL_AS_OF)), key=str)
        assert alone and sorted(values(found[query.key]), key=str) == alone


def facts_left(spark):
    return glob.glob(f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file:')}/wardlight/facts-*")


def test_a_fact_that_fails_is_in_the_log_of_its_queries(spark, data):
    lost = {name: df for name, df in data.items() if name != "itpre_med"}
    wanted = [find(key) for key in ("medicamentos_alto_risco", "top_20_medicamentos_ps", "fila_recepcao", "retorno")]
    log = {r.query_key: r for r in run_catalog(spark, lost, AS_OF, wanted).collect()}
    assert "itpre_med" in log["medicamentos_alto_risco"].error and "itpre_med" in log["top_20_medicamentos_ps"].error
    assert log["fila_recepcao"].error is None and log["fila_recepcao"].row_count == 1

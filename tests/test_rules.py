"""Metrics, alerts, annotations and findings."""

import pytest
from hospital import AS_OF, values
from pyspark.sql import functions as F

from wardlight import fixed
from wardlight.operators import alerts, annotations, findings, metrics
from wardlight.schemas import schema

# Metric values of one busy day, their status and the alert they raise.
DAY = [
    ("Diretoria", "ocupacao_percent", 96.2, "crítico", "Capacidade crítica", "96.2%"),
    ("Diretoria", "obitos_mes_atual", 18.0, "atenção", None, "18"),
    ("Enfermagem", "fila_total", 52.0, "crítico", "Sobrecarga operacional", "52 pacientes"),
    ("Enfermagem", "tempo_medio_espera_min", 48.0, "crítico", "Espera elevada", "48 min"),
    ("UTI", "ocupacao_uti_percent", 93.0, "crítico", "UTI em lotação", "93.0%"),
    ("UTI", "pacientes_criticos", 16.0, "crítico", "Alta criticidade clínica", "16 pacientes"),
    ("Centro Cirúrgico", "cirurgias_atrasadas", 10.0, "crítico", "Atrasos cirúrgicos", "10 cirurgias"),
    ("Centro Cirúrgico", "taxa_cancelamento_percent", 9.5, "atenção", None, "9.5%"),
    ("Farmácia", "itens_ruptura", 2.0, "crítico", "Risco de falta", "2 itens"),
    ("Farmácia", "itens_alto_risco_baixo", 5.0, "crítico", "Estoque crítico de alto risco", "5 itens"),
]


def metric_rows(spark, rows):
    return spark.createDataFrame([(AS_OF, 1, *row) for row in rows], schema("metrics"))


def run_rows(spark, rows):
    kind = "as_of timestamp_ntz, unit_id bigint, area string, query_key string, row_count bigint, error string"
    return spark.createDataFrame([(AS_OF, 1, *row) for row in rows], kind)


@pytest.fixture(scope="module")
def day(spark):
    return metric_rows(spark, [row[:3] for row in DAY])


def test_status_and_text(spark, day):
    got = {r.metric: (r.status, r.value_text, r.thresholds) for r in metrics.metric_status(day, metrics.metric_catalog(spark)).collect()}
    assert {m: (s, t) for _, m, _, s, _, t in DAY} == {m: g[:2] for m, g in got.items()}
    assert got["ocupacao_percent"][2] == "Atenção > 85 | Crítico > 95"
    odd = metric_rows(spark, [("UTI", "leitos_EM_uso", 3.25), ("UTI", "fila_total", None), ("UTI", "itens_ruptura", 1.0)])
    rows = {r.metric: r for r in metrics.metric_status(odd, metrics.metric_catalog(spark)).collect()}
    assert (rows["leitos_EM_uso"].label, rows["leitos_EM_uso"].value_text) == ("Leitos em uso", "3.2")
    assert (rows["leitos_EM_uso"].status, rows["leitos_EM_uso"].thresholds) == ("informativo", "Sem limite configurado")
    assert rows["fila_total"].status == "informativo" and rows["itens_ruptura"].status == "atenção"


def test_alerts_of_the_day(spark, day):
    raised = alerts.threshold_alerts(day, alerts.threshold_rules(spark)).unionByName(alerts.cross_alerts(day))
    linked = alerts.link_alert_metric(raised, day, metrics.metric_catalog(spark))
    ranked = alerts.alert_order(linked).collect()
    titles = {r.titulo: r for r in ranked}
    assert set(titles) == {row[4] for row in DAY if row[4]} | {rule[2] for rule in fixed.CROSS_RULES}
    assert sum(r.prioridade == "media" for r in ranked) == 2 and len(ranked) == 11
    assert [r.prioridade for r in ranked] == ["alta"] * 9 + ["media"] * 2 and [r.rank for r in ranked] == list(range(1, 12))
    assert titles["Capacidade crítica"].descricao == "Ocupação em 96.2%"
    assert titles["Atrasos cirúrgicos"].descricao == "10 cirurgias com atraso"
    about = {t: r.metric for t, r in titles.items()}
    assert about["Pressão assistencial sistêmica"] == "ocupacao_percent"
    assert about["Alta criticidade clínica"] is None and about["Gargalo entre UTI e Centro Cirúrgico"] is None
    assert about["Risco operacional por insumos"] == "itens_ruptura"
    assert titles["Alta criticidade clínica"].metric_label == "Contexto geral"
    assert titles["UTI em lotação"].metric_value == "93.0%" and titles["UTI em lotação"].priority_label == "Alta prioridade"
    first = alerts.alert_order(linked, compat=True).first()
    assert first.prioridade == "media"


@pytest.mark.parametrize("step,count", [(0.0, 0), (-0.001, 0), (0.001, 10)])
def test_limits_are_strict(spark, step, count):
    edge = metric_rows(spark, [(rule[0], rule[1], rule[2] + step) for rule in fixed.THRESHOLD_RULES])
    assert alerts.threshold_alerts(edge, alerts.threshold_rules(spark)).count() == count


def test_missing_metrics_count_as_zero(spark):
    assert values(alerts.cross_alerts(metric_rows(spark, [("UTI", "ocupacao_uti_percent", 99.0)]))) == []


def test_area_pressure(spark, day):
    got = {r.area: (r.score, r.is_top) for r in metrics.area_pressure(day, metrics.metric_catalog(spark)).collect()}
    assert got == {"Diretoria": (3.0, False), "Enfermagem": (4.0, True), "UTI": (4.0, False),
                   "Centro Cirúrgico": (3.0, False), "Farmácia": (4.0, False)}


def metrics_from(spark, indicators=(), admitted=0, status=(), deaths=(), newest=False):
    keyed = "as_of timestamp_ntz, unit_id bigint, "

    def df(rows, ddl):
        return spark.createDataFrame([(AS_OF, 1, *r) for r in rows], keyed + ddl)

    table = metrics.metric_table({
        "period_indicators": df(indicators, "ord int, indic string, quant bigint"),
        "admitted_now": df([(admitted,)], "quant bigint"),
        "surgery_status": df(status, "mes string, tp_situacao string, qtde bigint"),
        "deaths": df(deaths, "mes_ano string, qtd_obitos bigint"),
    }, newest_deaths=newest)
    return {r.metric: r.value for r in table.collect()}


def test_metric_derivation(spark):
    names = list(zip(range(1, 6), fixed.INDICATORS, (10, 4, 3, 2, 5)))
    got = metrics_from(spark, names, 10, [("2024-05", "A", 3), ("2024-05", "at", 1), ("2024-04", "R", 12)], [("2024-05", 2), ("2023-06", 9)])
    assert round(got["ocupacao_percent"], 2) == 66.67 and round(got["ocupacao_uti_percent"], 2) == 33.33
    assert (got["pacientes_criticos"], got["cirurgias_atrasadas"], got["taxa_cancelamento_percent"]) == (6.0, 4.0, 25.0)
    assert got["obitos_mes_atual"] == 9.0 and got["tempo_medio_espera_min"] == 25.0
    more = metrics_from(spark, [], 30, [], [("2024-05", 2), ("2023-06", 9)], newest=True)
    assert (more["ocupacao_percent"], more["ocupacao_uti_percent"], more["pacientes_criticos"]) == (0.0, 100.0, 16.0)
    assert more["taxa_cancelamento_percent"] == 0.0 and more["obitos_mes_atual"] == 2.0


@pytest.mark.parametrize("key,rows,error,want", [
    ("x", 0, "boom", "crítica"), ("x", 0, None, "atenção"), ("x", 1, "", "saudável"), ("x", 1001, None, "atenção"),
])
def test_run_classes(spark, key, rows, error, want):
    assert findings.classify_runs(run_rows(spark, [("UTI", key, rows, error)])).first().classification == want


def test_run_class_marks(spark):
    cases = [
        ("os_manutencao_aberta_mais_24h", 1, "crítica"), ("os_manutencao_aberta_mais_24h", 1001, "atenção"),
        ("medicacao_administrada", 300, "saudável"), ("medicacao_administrada", 301, "atenção"),
        ("tempo_medio_por_tipo_cirurgia", 200, "saudável"), ("tempo_medio_por_tipo_cirurgia", 201, "atenção"),
    ]
    got = findings.classify_runs(run_rows(spark, [("UTI", k, n, None) for k, n, _ in cases])).collect()
    assert [(r.query_key, r.row_count, r.classification) for r in got] == cases


def test_collection_failures(spark):
    log = run_rows(spark, [("UTI", "a", 0, "x"), ("UTI", "b", 0, "y"), ("Farmácia", "c", 1, ""), ("Farmácia", "d", 1, None)])
    got = alerts.collection_failure_alerts(log).collect()
    assert [(r.area, r.prioridade, r.titulo) for r in got] == [("UTI", "media", "Falha de coleta de dados")]
    assert got[0].descricao.startswith("2 queries com erro")


def found(spark, day, rows):
    log = run_rows(spark, [("Operações Integradas", k, n, None) for k, n in rows])
    return {r.title: (r.classification, r.summary) for r in findings.cross_findings(log, day).collect()}


def test_findings(spark, day):
    empty = found(spark, day, [("outra", 1)])
    assert {t: c for t, (c, _) in empty.items()} == {
        "Possível ociosidade da manutenção": "saudável", "Pressão simultânea: Enfermagem e Farmácia": "crítica",
    }
    some = found(spark, day, [("medicacao_administrada", 399), ("medicamentos_prescritos_por_medico", 1), ("os_manutencao_aberta_mais_24h", 7)])
    assert some["Risco de vício/uso recorrente em medicação"][0] == "atenção"
    assert some["Manutenção com fila envelhecida"][1].startswith("7 OS acima de 24h")
    many = found(spark, day, [("medicacao_administrada", 400), ("medicamentos_prescritos_por_medico", 1), ("os_manutencao_aberta_ate_12h", 1)])
    assert many["Risco de vício/uso recorrente em medicação"][0] == "crítica"
    assert "Possível ociosidade da manutenção" not in many


def test_run_summary(spark, day):
    log = run_rows(spark, [("UTI", "a", 7, None), ("UTI", "b", 0, "x"), ("UTI", "c", 3, "")])
    raised = alerts.threshold_alerts(day, alerts.threshold_rules(spark))
    got = findings.run_summary(log, raised).first()
    assert (got.queries, got.rows, got.errors, got.high_alerts, got.medium_alerts, got.rows_per_query) == (3, 10, 1, 6, 2, 3.3)


def test_annotations(spark, day):
    raised = alerts.threshold_alerts(day, alerts.threshold_rules(spark))
    notes = spark.createDataFrame([
        ("UTI", "UTI em lotação", "baixa", "  alta prevista "), ("Farmácia", "Risco de falta", "urgente", "  "),
    ], schema("alert_notes"))
    got = {r.titulo: r for r in annotations.merge_annotations(raised, notes, "alert").collect()}
    assert len(got) == 8
    assert (got["UTI em lotação"].prioridade, got["UTI em lotação"].descricao) == ("baixa", "Ocupação UTI em 93.0% | Contexto IA: alta prevista")
    assert (got["Risco de falta"].prioridade, got["Risco de falta"].descricao) == ("alta", "2 itens em ruptura")

    extra = [
        (1, "UTI", "alta", "UTI em lotação", "repetida"), (2, "UTI", "baixa", " Nova ", " texto novo "),
        (3, "UTI", "alta", "Nova", "segunda"), (4, "UTI", "alta", "ab", "texto longo"), (5, "UTI", "alta", "Outra", "abcd"),
        (6, "UTI", "urgente", "Terceira", "texto longo"), (7, None, "alta", "Quarta", "texto longo"),
    ]
    additions = spark.createDataFrame([(AS_OF, 1, *e) for e in extra], "as_of timestamp_ntz, unit_id bigint, seq bigint, area string, prioridade string, titulo string, descricao string")
    merged = annotations.merge_annotations(raised, additions, "extra").collect()
    assert len(merged) == 9
    new = [r for r in merged if r.titulo == "Nova"]
    assert [(r.prioridade, r.descricao, r.timestamp) for r in new] == [("baixa", "texto novo", AS_OF)]

    classified = findings.classify_runs(run_rows(spark, [("UTI", "a", 7, None), ("UTI", "b", 1, None)]))
    labels = spark.createDataFrame([
        (1, " a", "CRÍTICA ", "12345"), (2, "a", "grave", "ignorada"), (3, "b", "atenção", "1234"), (4, "zz", "atenção", "12345"),
    ], schema("run_notes"))
    done = {r.query_key: (r.classification, r.summary) for r in annotations.merge_annotations(classified, labels, "query", ()).collect()}
    assert done == {"a": ("crítica", "12345"), "b": ("saudável", "Consulta dentro do esperado.")}


def test_alert_contract(spark):
    rows = [
        ("UTI", "alta", "abc", "12345", None), ("Geral", "alta", "abc", "12345", "area"), ("UTI", "grave", "abc", "12345", "prioridade"),
        ("UTI", "alta", "ab", "12345", "titulo"), ("UTI", "alta", "a" * 121, "12345", "titulo"), ("UTI", "alta", None, "12345", "titulo"),
        ("UTI", "alta", "abc", "1" * 601, "descricao"), ("UTI", "alta", "a" * 120, "1" * 600, None),
    ]
    df = spark.createDataFrame(rows, "area string, prioridade string, titulo string, descricao string, want string")
    assert all(r.problem == r.want for r in alerts.check_alerts(df).select("problem", F.col("want")).collect())


def test_first_number(spark):
    df = spark.createDataFrame([(1, "x", None, 5), (2, "y", 2.5, 6), (3, "z", None, 7)], "o int, t string, a double, b int")
    assert values(metrics.first_number(df, ["t", "a"], ["o"])) == [(2.5,)]
    assert values(metrics.first_number(df, ["a", "b"], ["o"])) == [(5.0,)]
    assert values(metrics.first_number(df, ["t"], ["o"])) == [(0.0,)]
    assert values(metrics.first_number(df.limit(0), ["b"], ["o"])) == [(0.0,)]

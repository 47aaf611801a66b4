"""The bound queries of ``driver_queries`` as SQL for DuckDB, written over the test tables."""

from __future__ import annotations

from wardlight import fixed
from wardlight.plans.catalog import catalog
from wardlight.plans.rollups import ANSWERS
from wardlight.plans.runs import query_label
from wardlight.sources.driver_tables import DRUG_NAMES, EVENTS_AS_OF, HOSPITAL_AS_OF

SQL: dict[str, str] = {}

# Shared table expressions.

_DRUG = "p_name"
for _noun, _name in DRUG_NAMES.items():
    _DRUG = f"replace({_DRUG}, '{_noun}', '{_name}')"

_SHIFT = int((EVENTS_AS_OF - HOSPITAL_AS_OF).total_seconds())

_CTE = {
    # Orders seen as encounters, triage visits and surgery notices.
    "encounters": """
        SELECT o_orderkey AS enc, o_custkey AS patient, o_custkey // 15 AS doctor,
               CASE WHEN o_totalprice < 20000 THEN o_custkey END AS parent,
               substr(o_orderpriority, 1, 1) AS severity, o_orderpriority AS complaint, o_totalprice AS price,
               CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS company,
               CASE substr(o_orderpriority, 1, 1)
                    WHEN '1' THEN 'U' WHEN '2' THEN 'I' WHEN '3' THEN 'A' WHEN '4' THEN 'E' ELSE 'H' END AS kind,
               arrival,
               CASE WHEN o_totalprice >= 50000 THEN arrival + to_seconds(CAST(floor(o_totalprice) AS BIGINT)) END AS left_at,
               arrival + to_seconds(CAST(floor(o_totalprice / 4) AS BIGINT)) AS expected
        FROM (SELECT *, TIMESTAMP '2001-08-01' + to_seconds(CAST(floor(o_totalprice / 100) AS BIGINT)
                        - 7200 * date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01')) AS arrival
              FROM orders)""",
    "steps": """
        SELECT l_orderkey AS visit,
               CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 11 WHEN 3 THEN 12 WHEN 4 THEN 21 WHEN 5 THEN 22 WHEN 6 THEN 31
                    ELSE CASE WHEN l_quantity > 40 THEN 90 ELSE 32 END END AS step,
               TIMESTAMP '2001-07-31'
                 + to_seconds(l_linenumber * 1800 + CAST(floor(l_extendedprice / 10) AS BIGINT)) AS at
        FROM lineitem""",
    "wards": """
        SELECT n_nationkey AS ward, 'Uti ' || n_nationkey AS setor, n_regionkey <> 0 AS active FROM nation""",
    "given_items": f"""
        SELECT l_orderkey AS rx, l_linenumber AS item, l_quantity AS quantity, o_orderdate AS day,
               o_custkey // 15 AS doctor, {_DRUG} AS drug, split_part(p_name, ' ', 2) AS noun
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
        WHERE l_returnflag <> 'R'""",
    "surgeries": """
        SELECT o_orderkey AS notice, CASE WHEN o_totalprice >= 30000 THEN o_orderdate + INTERVAL 1 DAY END AS done,
               substr(o_orderpriority, 1, 1) AS severity, CAST(floor(o_totalprice / 25) AS BIGINT) AS seconds,
               l_linenumber AS line, l_suppkey AS supplier, p_brand AS brand, p_size AS size
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
        WHERE o_orderstatus = 'F'""",
    # Visits of the event table: one per user and day.
    "visit_events": """
        SELECT user_id * 1000 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS visit, ts, value, user_id,
               event_type,
               CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 11 WHEN 'click' THEN 12 WHEN 'purchase' THEN 22
                    ELSE 32 END AS step
        FROM events""",
    "visits": "SELECT visit, min(ts) AS arrival FROM visit_events GROUP BY visit",
    # Snapshots: year and nation.
    "facts": """
        SELECT CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS as_of, CAST(c_nationkey AS BIGINT) AS unit_id,
               o_orderstatus AS status, substr(o_orderpriority, 1, 1) AS severity, o_totalprice AS price,
               strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS quarter
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "sizes": "SELECT as_of, unit_id, count(*) AS n FROM facts GROUP BY ALL",
    "first_quarter": """
        SELECT as_of, unit_id, arg_min(n, quarter) AS deaths
        FROM (SELECT as_of, unit_id, quarter, count(*) AS n FROM facts GROUP BY ALL) GROUP BY ALL""",
    "low_groups": """
        SELECT as_of, unit_id, count(*) FILTER (n < 10) AS low
        FROM (SELECT as_of, unit_id, quarter, price > 250000 AS dear, count(*) AS n FROM facts GROUP BY ALL) GROUP BY ALL""",
    "figures": """
        SELECT as_of, unit_id, deaths, low,
               count(*) FILTER (severity IN ('1', '2')) AS admitted,
               count(*) FILTER (status = 'P' AND price < 30000) AS discharged,
               count(*) FILTER (severity IN ('1', '5')) AS queue,
               count(*) FILTER (status = 'F') AS inside,
               count(*) FILTER (price < 60000) AS late, count(*) AS surgeries
        FROM facts JOIN first_quarter USING (as_of, unit_id) JOIN low_groups USING (as_of, unit_id)
        GROUP BY ALL""",
    "metrics": """
        SELECT as_of, unit_id, area, metric, value FROM (
          SELECT *, unnest([
            {area: 'Diretoria', metric: 'ocupacao_percent', value:
              CASE WHEN admitted = 0 THEN 0.0::DOUBLE
                   ELSE least(100.0::DOUBLE, admitted::DOUBLE / greatest(admitted + discharged, 1) * 100) END},
            {area: 'Diretoria', metric: 'obitos_mes_atual', value: deaths::DOUBLE},
            {area: 'Enfermagem', metric: 'fila_total', value: queue::DOUBLE},
            {area: 'Enfermagem', metric: 'tempo_medio_espera_min',
              value: CASE WHEN queue > 30 THEN 50.0::DOUBLE ELSE 25.0::DOUBLE END},
            {area: 'UTI', metric: 'ocupacao_uti_percent', value: least(100.0::DOUBLE, inside::DOUBLE / 30 * 100)},
            {area: 'UTI', metric: 'pacientes_criticos', value: format('{:.0f}', inside * 0.55::DOUBLE)::DOUBLE},
            {area: 'Centro Cirúrgico', metric: 'cirurgias_atrasadas', value: late::DOUBLE},
            {area: 'Centro Cirúrgico', metric: 'taxa_cancelamento_percent',
              value: format('{:.2f}', late::DOUBLE / surgeries * 100)::DOUBLE},
            {area: 'Farmácia', metric: 'itens_ruptura', value: 0.0::DOUBLE},
            {area: 'Farmácia', metric: 'itens_alto_risco_baixo', value: low::DOUBLE}
          ], recursive := true) FROM figures)""",
    "limits": "SELECT * FROM (VALUES {}) AS t(metric, label, unit, warn, critical)".format(
        ", ".join(f"('{m}', '{l}', '{u}', {w:.0f}, {c:.0f})" for m, l, u, w, c in fixed.METRIC_CATALOG)
    ),
    "shown": """
        SELECT as_of, unit_id, area, metric, value, label, warn, critical,
               CASE WHEN unit = '%' THEN format('{:.1f}', value) || '%'
                    ELSE trim(CASE WHEN value = floor(value) THEN format('{:.0f}', value) ELSE format('{:.1f}', value) END
                              || ' ' || unit) END AS value_text,
               'Atenção > ' || warn || ' | Crítico > ' || critical AS thresholds
        FROM metrics JOIN limits USING (metric)""",
    "rules": "SELECT * FROM (VALUES {}) AS t(metric, above, prioridade, titulo, before, after, pattern)".format(
        ", ".join(
            f"('{m}', {x}, '{p}', '{t}', '{b}', '{a}', '{{:.{d}f}}')"
            for _, m, x, p, t, b, a, d in fixed.THRESHOLD_RULES
        )
    ),
    "limit_alerts": """
        SELECT as_of, unit_id, area, prioridade, titulo,
               before || CASE pattern WHEN '{:.0f}' THEN format('{:.0f}', value) ELSE format('{:.1f}', value) END
                 || after AS descricao, as_of AS "timestamp"
        FROM metrics JOIN rules USING (metric) WHERE value > above""",
    "wide": """
        SELECT as_of, unit_id, max(value) FILTER (metric = 'ocupacao_percent') AS occupancy,
               max(value) FILTER (metric = 'fila_total') AS queue,
               max(value) FILTER (metric = 'ocupacao_uti_percent') AS icu,
               max(value) FILTER (metric = 'cirurgias_atrasadas') AS late,
               max(value) FILTER (metric = 'itens_ruptura') AS missing,
               max(value) FILTER (metric = 'taxa_cancelamento_percent') AS cancelled,
               max(value) FILTER (metric = 'itens_alto_risco_baixo') AS low
        FROM metrics GROUP BY ALL""",
    "joint_alerts": "SELECT as_of, unit_id, area, prioridade, titulo, descricao, as_of AS \"timestamp\" FROM ("
    + " UNION ALL ".join(
        f"SELECT as_of, unit_id, '{area}' AS area, '{priority}' AS prioridade, '{title}' AS titulo, "
        f"'{text}' AS descricao FROM wide WHERE {condition}"
        for (area, priority, title, text, _), condition in zip(
            fixed.CROSS_RULES,
            ["occupancy > 95 AND queue > 40", "icu > 90 AND late > 8", "missing > 0 AND cancelled > 8"],
        )
    )
    + ")",
    "alerts": "SELECT * FROM limit_alerts UNION ALL SELECT * FROM joint_alerts",
    "runs": """
        SELECT as_of, unit_id, area, query_key, rows AS row_count, error FROM (
          SELECT as_of, unit_id, unnest([
            {area: 'Operações Integradas', query_key: 'medicacao_administrada', rows: sum(floor(price / 60000))::BIGINT, error: NULL::VARCHAR},
            {area: 'Operações Integradas', query_key: 'medicamentos_prescritos_por_medico', rows: count(*) FILTER (price > 480000), error: NULL},
            {area: 'Operações Integradas', query_key: 'os_manutencao_aberta_ate_12h', rows: count(*) FILTER (price < 1500), error: NULL},
            {area: 'Operações Integradas', query_key: 'os_manutencao_aberta_12_24h', rows: count(*) FILTER (price BETWEEN 1500 AND 3000), error: NULL},
            {area: 'Operações Integradas', query_key: 'os_manutencao_aberta_mais_24h', rows: count(*) FILTER (price > 495000), error: NULL},
            {area: 'Operações Integradas', query_key: 'tempo_medio_por_tipo_cirurgia', rows: sum(floor(price / 100000))::BIGINT, error: NULL},
            {area: 'Enfermagem', query_key: 'retorno', rows: sum(floor(price / 20000))::BIGINT,
             error: CASE WHEN count(*) FILTER (price < 20000) = 4 THEN '' END},
            {area: 'UTI', query_key: 'tmp_por_setor', rows: count(*) FILTER (price < 20000),
             error: CASE WHEN count(*) FILTER (price < 20000) > 5 THEN 'timeout' END}
          ], recursive := true) FROM facts GROUP BY as_of, unit_id)""",
    "classified": """
        SELECT *,
          CASE WHEN error = 'timeout' THEN 'crítica' WHEN row_count = 0 OR row_count > 1000 THEN 'atenção'
               WHEN query_key = 'os_manutencao_aberta_mais_24h' THEN 'crítica'
               WHEN query_key = 'medicacao_administrada' AND row_count > 300 THEN 'atenção'
               WHEN query_key = 'tempo_medio_por_tipo_cirurgia' AND row_count > 200 THEN 'atenção'
               ELSE 'saudável' END AS classification,
          CASE WHEN error = 'timeout' THEN 'Falha de execução da query: revisar conectividade, SQL ou permissões.'
               WHEN row_count = 0 THEN 'Sem dados retornados; validar se é comportamento esperado para o período.'
               WHEN row_count > 1000 THEN 'Volume elevado de dados; monitorar impacto operacional e performance.'
               WHEN query_key = 'os_manutencao_aberta_mais_24h' THEN 'Existem OS de manutenção acima de 24h em aberto.'
               WHEN query_key = 'medicacao_administrada' AND row_count > 300
                 THEN 'Volume alto de medicação administrada; monitorar frequência por paciente.'
               WHEN query_key = 'tempo_medio_por_tipo_cirurgia' AND row_count > 200
                 THEN 'Grande dispersão de tempos cirúrgicos; revisar gargalos por especialidade.'
               ELSE 'Consulta dentro do esperado.' END AS summary
        FROM runs""",
}

_NEEDS = {
    "visits": ["visit_events"],
    "sizes": ["facts"], "first_quarter": ["facts"], "low_groups": ["facts"],
    "figures": ["facts", "first_quarter", "low_groups"], "metrics": ["figures"],
    "shown": ["metrics", "limits"], "limit_alerts": ["metrics", "rules"], "wide": ["metrics"],
    "joint_alerts": ["wide"], "alerts": ["limit_alerts", "joint_alerts"], "runs": ["facts"], "classified": ["runs"],
}


def _with(names: str, body: str, given: dict[str, str] | None = None) -> str:
    """``body`` preceded by the named table expressions and those they need; ``given`` ones stand for others of their name."""
    order: list[str] = []
    given = given or {}

    def visit(name: str) -> None:
        for needed in [] if name in given else _NEEDS.get(name, []):
            visit(needed)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    parts = ",\n".join(f"{n} AS ({given.get(n, _CTE[n]).strip()})" for n in order)
    return f"WITH {parts}\n{body.strip()}" if order else body.strip()


# Families over the test tables.

SQL["monthly_evolution"] = """
SELECT strftime(o_orderdate, '%m/%Y') AS competencia,
       CASE o_orderstatus WHEN 'F' THEN 'Fechado' WHEN 'O' THEN 'Aberto' END AS tp_atendimento, count(*) AS qtd
FROM orders WHERE o_totalprice > 20000 AND year(o_orderdate) BETWEEN 1996 AND 1999 GROUP BY 1, 2"""

_SHIPPED = "l_shipdate BETWEEN TIMESTAMP '2001-07-01' AND TIMESTAMP '2001-08-01'"
SQL["period_indicators"] = " UNION ALL ".join(
    f"SELECT {i} AS ord, '{name}' AS indic, count(*) AS quant FROM lineitem JOIN orders ON o_orderkey = l_orderkey "
    f"WHERE o_totalprice > 20000 AND {condition}"
    for i, (name, condition) in enumerate([
        ("ordered", "o_orderdate >= TIMESTAMP '2001-07-01'"),
        ("shipped", _SHIPPED),
        ("shipped and returned", f"{_SHIPPED} AND l_returnflag = 'R'"),
        ("shipped of open orders", f"{_SHIPPED} AND o_orderstatus = 'O'"),
        ("shipped late", f"{_SHIPPED} AND l_shipdate > o_orderdate"),
    ], 1)
)

SQL["count_in_period"] = """
SELECT count(*) AS quant FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '2001-07-01' AND TIMESTAMP '2001-08-01' AND o_orderstatus <> 'P'"""

SQL["monthly_count"] = """
SELECT strftime(o_orderdate, '%Y-%m') AS mes, count(*) AS qtde FROM orders
WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '2000-08-01' GROUP BY 1"""

SQL["monthly_count_dim"] = """
SELECT strftime(o_orderdate, '%Y-%m') AS mes, o_orderstatus, count(*) AS qtde FROM orders GROUP BY 1, 2"""

SQL["monthly_count_joined"] = """
SELECT strftime(o_orderdate, '%Y-%m') AS mes, p_name, count(*) AS qtde
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
WHERE o_orderdate >= TIMESTAMP '2000-09-01' GROUP BY 1, 2"""

SQL["monthly_count_label"] = """
SELECT mesano, CASE code WHEN '1-URGENT' THEN 'Urgente' WHEN '2-HIGH' THEN 'Alta' WHEN '3-MEDIUM' THEN 'Normal' END
         AS o_orderpriority, qtde
FROM (SELECT strftime(o_orderdate, '%m/%Y') AS mesano, o_orderpriority AS code, count(*) AS qtde FROM orders GROUP BY 1, 2)"""

SQL["monthly_count_two_key"] = """
SELECT strftime(l.l_shipdate, '%Y-%m') AS mes, s_name, count(*) AS qtde
FROM lineitem l
JOIN (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS lead FROM lineitem GROUP BY 1, 2) p
  ON p.l_orderkey = l.l_orderkey AND p.l_linenumber = l.l_linenumber
JOIN supplier ON s_suppkey = p.lead GROUP BY 1, 2"""

SQL["count_by_entity"] = """
SELECT s_name, count(*) AS qtde FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
WHERE l_shipdate >= TIMESTAMP '2000-08-01' GROUP BY 1"""

SQL["hourly_arrivals"] = _with("visits", """
SELECT strftime(v.arrival, '%d/%m/%Y') AS data, strftime(v.arrival, '%H') AS horario, count(*) AS quantidade
FROM visits v JOIN visit_events e ON e.visit = v.visit
WHERE CAST(v.arrival AS DATE) = DATE '2024-01-30' GROUP BY 1, 2""")


def _stalled(step: int, extra: str = "") -> str:
    return _with("visits", f"""
SELECT count(DISTINCT v.visit) AS n FROM visits v JOIN visit_events e ON e.visit = v.visit AND e.step = {step}
WHERE v.arrival >= TIMESTAMP '2024-01-23' {extra}
  AND NOT EXISTS (SELECT 1 FROM visit_events f WHERE f.visit = v.visit AND f.step > {step})""")


SQL["stalled_at_step"] = _stalled(12)
SQL["stalled_with_pending"] = _stalled(
    22, "AND v.visit IN (SELECT visit FROM visit_events WHERE event_type = 'view' AND value > 20)"
)

SQL["single_event_queue"] = _with("visits", """
SELECT coalesce(sum(n), 0)::BIGINT AS quantidade FROM (
  SELECT v.visit, count(*) AS n FROM visits v JOIN visit_events e ON e.visit = v.visit
  WHERE CAST(v.arrival AS DATE) = DATE '2024-01-30' GROUP BY 1 HAVING count(*) = 1)""")


def _pairs(visits: str, events: str, start: int, end: int, fold: bool) -> str:
    """Mean wait by forming every pair; ``visits`` selects ids, ``events`` has (visit, step, at)."""
    shown = "CASE WHEN minutes < 60 THEN minutes WHEN minutes > 60 THEN minutes / 60 END" if fold else "minutes"
    return f"""
SELECT coalesce({shown}, 0)::DOUBLE AS dif_em_hrs, minutes FROM (
  SELECT round(avg(round(date_sub('microsecond', a.at, b.at) / 60000000.0))) AS minutes
  FROM ({events}) a JOIN ({events}) b ON b.visit = a.visit
  WHERE a.step = {start} AND b.step = {end} AND a.visit IN ({visits}))"""


_RECENT = "SELECT visit FROM visits WHERE arrival >= TIMESTAMP '2024-01-23'"
_EVENTS = "SELECT visit, step, ts AS at FROM visit_events"
SQL["step_wait"] = _with("visits", _pairs(_RECENT, _EVENTS, 1, 11, fold=False))
SQL["step_wait_folded"] = _with("visits", _pairs(_RECENT, _EVENTS, 12, 22, fold=True))

SQL["frequent_returners"] = """
SELECT count(*) AS n FROM (
  SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 365 DAY
  GROUP BY 1 HAVING count(DISTINCT o_orderkey) > 2)"""


def _hours_minutes(source: str, group: str) -> str:
    """Mean of whole seconds ``s`` as hours and rounded rest minutes, on integers."""
    return f"""
SELECT {group}, (t // (n * 3600))::BIGINT AS horas,
       ((2 * (t % (n * 3600)) + n * 60) // (2 * n * 60))::DOUBLE AS minutos
FROM (SELECT {group}, sum(s)::HUGEINT AS t, count(*)::HUGEINT AS n FROM ({source}) GROUP BY 1)"""


SQL["mean_duration_hm"] = _hours_minutes(
    "SELECT p_brand, date_sub('second', o_orderdate, l_shipdate) AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey "
    "JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= o_orderdate", "p_brand",
)

SQL["latest_pivot"] = """
SELECT user_id, {} FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
WHERE r = 1 GROUP BY 1""".format(
    ", ".join(
        f"max(value) FILTER (event_type = '{t}') AS last_{t}" for t in ["signup", "view", "click", "purchase", "error"]
    )
)

SQL["ordered_list"] = """
SELECT l_orderkey, string_agg(p_name, ' | ' ORDER BY p_name) AS lista
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1"""

SQL["occupied_beds"] = """
SELECT count(s_suppkey) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey
WHERE s_acctbal > 0 AND n_regionkey <> 4 AND n_name LIKE 'NATION@_1%' ESCAPE '@'"""

SQL["mean_stay_by_group"] = """
SELECT n_name, (sum(date_sub('microsecond', o_orderdate, l_shipdate))::HUGEINT * 100
                // (count(*) * 86400000000))::DOUBLE / 100 AS tmp_dias
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey
WHERE l_shipdate >= o_orderdate AND l_shipdate >= TIMESTAMP '2000-01-01' GROUP BY 1"""


def _months(later: str, earlier: str) -> str:
    """Months between two timestamps, fractions by 31-day months."""
    return f"""(12 * (year({later}) - year({earlier})) + month({later}) - month({earlier})
      + CASE WHEN day({later}) = day({earlier})
               OR (CAST({later} AS DATE) = last_day({later}) AND CAST({earlier} AS DATE) = last_day({earlier})) THEN 0
             ELSE (86400 * (day({later}) - day({earlier})) + date_sub('second', date_trunc('day', {later}), {later})
                   - date_sub('second', date_trunc('day', {earlier}), {earlier})) / 2678400.0 END)"""


SQL["count_by_age_band"] = f"""
SELECT CASE WHEN age < 1 THEN 'below 1' WHEN age < 3 THEN '1 to 2' ELSE '3 and more' END AS faixa, l_returnflag,
       count(*) AS qtd
FROM (SELECT trunc({_months('l_shipdate', 'o_orderdate')} / 12) AS age, l_returnflag
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1, 2"""

SQL["top_k_by_count"] = """
SELECT * FROM (
  SELECT p_name, count(*) AS qtde, row_number() OVER (ORDER BY count(*) DESC, p_name) AS rn
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 3 AND l_returnflag <> 'R' GROUP BY 1) WHERE rn <= 20"""

SQL["keyword_class_monthly"] = """
SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS mes,
       CASE WHEN regexp_matches(p_name, 'ring|rod') THEN 'ROUND' WHEN regexp_matches(p_name, 'plate|gear') THEN 'FLAT'
            WHEN p_name LIKE '%cold%' THEN 'COLD' ELSE 'OTHER' END AS classe, count(*) AS qtde
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= TIMESTAMP '2000-08-01' GROUP BY 1, 2"""

SQL["prescription_detail"] = """
SELECT strftime(o_orderdate, '%d/%m/%Y') AS data_prescricao, l_orderkey, l_linenumber, p_name AS medicamento,
       s_name AS medico
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag <> 'N'"""

_AGED = """
SELECT event_id, event_type, hours AS horas_em_aberto, bucket FROM (
  SELECT event_id, event_type, (100 * age // 3600000000)::DOUBLE / 100 AS hours,
         CASE WHEN age <= 12 * 3600000000 THEN 'ate_12h' WHEN age <= 24 * 3600000000 THEN '12_24h' ELSE 'mais_24h' END AS bucket
  FROM (SELECT *, date_sub('microsecond', ts, TIMESTAMP '2024-01-30 23:59:59') AS age FROM events
        WHERE event_type IN ('error', 'click')))"""
SQL["aging"] = _AGED
for _bucket in ("ate_12h", "12_24h", "mais_24h"):
    SQL[f"aging_{_bucket}"] = f"{_AGED} WHERE bucket = '{_bucket}'"

# Metrics, alerts, findings.

SQL["first_number"] = "SELECT o_totalprice AS number FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1"

SQL["metric_table"] = _with("metrics", "SELECT * FROM metrics")

_STATUS = """
SELECT as_of, unit_id, area, metric, value, label, value_text, thresholds,
       CASE WHEN value > critical THEN 'crítico' WHEN value > warn THEN 'atenção' ELSE 'controlado' END AS status
FROM shown"""
SQL["metric_status"] = _with("shown", _STATUS)

SQL["area_pressure"] = _with("shown", """
SELECT as_of, unit_id, area, score, score = max(score) OVER w AND place = min(CASE WHEN score = top THEN place END) OVER w AS is_top
FROM (SELECT *, max(score) OVER (PARTITION BY as_of, unit_id) AS top FROM (
  SELECT as_of, unit_id, area, list_position(['Diretoria', 'Enfermagem', 'UTI', 'Centro Cirúrgico', 'Farmácia'], area) AS place,
         sum(CASE WHEN value > critical THEN 2 WHEN value > warn THEN 1 ELSE 0 END)::DOUBLE AS score
  FROM shown GROUP BY 1, 2, 3))
WINDOW w AS (PARTITION BY as_of, unit_id)""")

SQL["threshold_alerts"] = _with("limit_alerts", "SELECT * FROM limit_alerts")
SQL["cross_alerts"] = _with("joint_alerts", "SELECT * FROM joint_alerts")

# Which metric the alerts are about, by title.
_ABOUT = {
    "Capacidade crítica": "ocupacao_percent", "Óbitos acima do esperado": "obitos_mes_atual",
    "Sobrecarga operacional": "fila_total", "Espera elevada": "tempo_medio_espera_min",
    "UTI em lotação": "ocupacao_uti_percent", "Atrasos cirúrgicos": "cirurgias_atrasadas",
    "Cancelamentos elevados": "taxa_cancelamento_percent", "Risco de falta": "itens_ruptura",
    "Estoque crítico de alto risco": "itens_alto_risco_baixo", "Pressão assistencial sistêmica": "ocupacao_percent",
    "Risco operacional por insumos": "itens_ruptura",
}
SQL["link_alert_metric"] = _with("alerts shown", """
SELECT a.*, s.metric, coalesce(s.label, 'Contexto geral') AS metric_label,
       coalesce(s.value_text, '""" + fixed.NO_METRIC_VALUE + """') AS metric_value,
       coalesce(s.thresholds, 'Sem limite configurado') AS metric_limits,
       CASE a.prioridade WHEN 'alta' THEN 'Alta prioridade' WHEN 'media' THEN 'Prioridade média' ELSE 'Baixa prioridade' END
         AS priority_label
FROM alerts a LEFT JOIN (VALUES {}) AS t(titulo, metric) ON t.titulo = a.titulo
LEFT JOIN shown s ON s.as_of = a.as_of AND s.unit_id = a.unit_id AND s.metric = t.metric""".format(
    ", ".join(f"('{title}', '{metric}')" for title, metric in _ABOUT.items())
))


def _ranked(priority: str) -> str:
    return _with("alerts", f"""
SELECT *, row_number() OVER (PARTITION BY as_of, unit_id ORDER BY {priority} DESC,
  list_position(['Diretoria', 'Enfermagem', 'UTI', 'Centro Cirúrgico', 'Farmácia'], area), titulo) AS rank FROM alerts""")


SQL["alert_order"] = _ranked("prioridade = 'alta'")
SQL["alert_order_by_text"] = _ranked("prioridade")

SQL["collection_failure_alerts"] = _with("runs", """
SELECT as_of, unit_id, area, 'media' AS prioridade, 'Falha de coleta de dados' AS titulo,
       count(*) || ' queries com erro podem comprometer a análise da área' AS descricao, as_of AS "timestamp"
FROM runs WHERE error = 'timeout' GROUP BY as_of, unit_id, area""")

SQL["classify_runs"] = _with("classified", "SELECT * FROM classified")

SQL["run_summary"] = _with("runs alerts", """
SELECT r.*, coalesce(high, 0) AS high_alerts, coalesce(medium, 0) AS medium_alerts,
       format('{:.1f}', rows::DOUBLE / queries)::DOUBLE AS rows_per_query
FROM (SELECT as_of, unit_id, count(*) AS queries, sum(row_count)::BIGINT AS rows,
             count(*) FILTER (error = 'timeout') AS errors FROM runs GROUP BY 1, 2) r
LEFT JOIN (SELECT as_of, unit_id, count(*) FILTER (prioridade = 'alta') AS high,
                  count(*) FILTER (prioridade = 'media') AS medium FROM alerts GROUP BY 1, 2) USING (as_of, unit_id)""")

_TITLES = fixed.FINDINGS
_FINDINGS = """
WITH counts AS (
  SELECT as_of, unit_id, queue, low,
         max(row_count) FILTER (query_key = 'medicacao_administrada') AS given,
         max(row_count) FILTER (query_key = 'medicamentos_prescritos_por_medico') AS doctors,
         max(row_count) FILTER (query_key = 'os_manutencao_aberta_ate_12h') AS young,
         max(row_count) FILTER (query_key = 'os_manutencao_aberta_12_24h') AS middle,
         max(row_count) FILTER (query_key = 'os_manutencao_aberta_mais_24h') AS old
  FROM runs JOIN wide USING (as_of, unit_id) GROUP BY ALL)
""" + " UNION ALL ".join(
    f"SELECT as_of, unit_id, '{_TITLES[name][0]}' AS title, {level} AS classification, "
    f"{before}'{_TITLES[name][1]}' AS summary FROM counts WHERE {condition}"
    for name, level, before, condition in [
        ("recurrence", "CASE WHEN given < 400 THEN 'atenção' ELSE 'crítica' END", "", "given > 0 AND doctors > 0"),
        ("audit", "'atenção'", "", "doctors > 0"),
        ("aged_orders", "'crítica'", "old || ", "old > 0"),
        ("idle_shop", "'saudável'", "", "old = 0 AND young + middle = 0"),
        ("idle_wards", "'atenção'", "", "queue < 12 AND low <= 1"),
        ("pressed_wards", "'crítica'", "", "queue > 35 AND low >= 3"),
    ]
)
SQL["cross_findings"] = _with("runs wide", f"SELECT * FROM ({_FINDINGS})")

SQL["merge_annotations_alert"] = _with("alerts sizes", """
SELECT a.as_of, a.unit_id, a.area,
       CASE WHEN a.titulo = 'UTI em lotação' AND n > 80 THEN 'media'
            WHEN a.titulo = 'Estoque crítico de alto risco' THEN 'baixa' ELSE a.prioridade END AS prioridade,
       a.titulo, a.descricao || CASE WHEN a.titulo = 'UTI em lotação' THEN ' | Contexto IA: revisto com ' || n || ' casos'
                                     ELSE '' END AS descricao, a."timestamp"
FROM alerts a JOIN sizes USING (as_of, unit_id)""")

SQL["merge_annotations_extra"] = _with("alerts sizes", """
, extras AS (
  SELECT as_of, unit_id, 'UTI' AS area, 'alta' AS prioridade, 'UTI em lotação' AS titulo, 'já existente ou nova' AS descricao
  FROM sizes s WHERE NOT EXISTS (SELECT 1 FROM alerts a WHERE a.as_of = s.as_of AND a.unit_id = s.unit_id
                                 AND a.titulo = 'UTI em lotação')
  UNION ALL
  SELECT as_of, unit_id, 'Diretoria', CASE WHEN n > 80 THEN 'alta' ELSE 'baixa' END, 'Volume anual',
         CASE WHEN n > 80 THEN 'volume fora do padrão' ELSE 'segunda versão' END FROM sizes
  UNION ALL
  SELECT as_of, unit_id, 'Farmácia', 'media', 'Compra', 'n' || n FROM sizes WHERE length('n' || n) >= 5)
SELECT * FROM alerts UNION ALL SELECT *, as_of FROM extras""").replace(")\n, extras", "),\nextras")

SQL["merge_annotations_query"] = _with("classified sizes", """
SELECT c.as_of, c.unit_id, area, c.query_key, row_count, error,
       CASE WHEN query_key = 'retorno' THEN CASE WHEN n > 80 THEN 'crítica' ELSE 'atenção' END
            WHEN query_key = 'tmp_por_setor' AND length('n' || n) >= 5 THEN 'saudável'
            ELSE classification END AS classification,
       CASE WHEN query_key = 'retorno' THEN CASE WHEN n > 80 THEN 'segunda análise' ELSE 'primeira análise' END
            WHEN query_key = 'tmp_por_setor' AND length('n' || n) >= 5 THEN 'n' || n ELSE summary END AS summary
FROM classified c JOIN sizes USING (as_of, unit_id)""")

SQL["check_alerts"] = """
SELECT doc_id, CASE WHEN lang = 'fr' THEN 'area' WHEN lang = 'de' THEN 'prioridade'
                    WHEN length(source) < 3 OR length(source) > 120 THEN 'titulo'
                    WHEN length(text) < 5 OR length(text) > 600 THEN 'descricao' END AS problem FROM documents"""

# Catalog queries over the test tables read as hospital tables.

_TODAY = "BETWEEN TIMESTAMP '2001-07-31' AND TIMESTAMP '2001-07-31 18:00:00'"
_ROOT = "parent IS NULL AND kind = 'I' AND company = 1"


def _evolution(kind: str, label: str, company: int, years: str = "2001 AND 2001") -> str:
    return _with("encounters", f"""
SELECT strftime(arrival, '%m/%Y') AS competencia, '{label}' AS tp_atendimento, count(*) AS qtd FROM encounters
WHERE kind = '{kind}' AND company = {company} AND parent IS NULL AND year(arrival) BETWEEN {years} GROUP BY 1""")


_EVOLUTIONS = {
    "evolucao_atendimentos_internacao": ("I", "Internação", 1),
    "evolucao_atendimentos_externos": ("E", "Externo", 1),
    "evolucao_atendimentos_ambulatorio": ("A", "Ambulatório", 1),
    "evolucao_atendimentos_urgencia": ("U", "Urgência", 2),
}
for _key, _evolution_args in _EVOLUTIONS.items():
    SQL[_key] = _evolution(*_evolution_args)

SQL["internacao_e_altas"] = _with("encounters", " UNION ALL ".join(
    f"SELECT {i} AS ord, '{name}' AS indic, count(*) AS quant FROM encounters WHERE {_ROOT} AND {condition}"
    for i, (name, condition) in enumerate(zip(fixed.INDICATORS, [
        f"arrival {_TODAY}", f"left_at {_TODAY}", f"left_at - INTERVAL 2 HOUR {_TODAY}", f"expected {_TODAY}",
        f"expected {_TODAY} AND left_at IS NULL",
    ]), 1)
))

SQL["obitos_mes"] = _with("encounters", """
SELECT strftime(left_at, '%Y-%m') AS mes_ano, count(*) AS qtd_obitos FROM encounters
WHERE price > 400000 AND left_at >= TIMESTAMP '2000-07-31' GROUP BY 1""")


def _waiting(name: str, step: int, beyond: str, extra: str = "") -> str:
    return _with("encounters steps", f"""
SELECT count(*) AS {name} FROM encounters
WHERE arrival >= TIMESTAMP '2001-07-30 18:00:00' AND enc IN (SELECT visit FROM steps WHERE step = {step})
  AND enc NOT IN (SELECT visit FROM steps WHERE step {beyond}) {extra}""")


SQL["fila_recepcao"] = _waiting("qtde_pacientes_fila", 12, "> 12")
SQL["fila_atendimento_medico"] = _waiting("qtde_pacientes_fila_consulta", 22, "> 22")
SQL["fila_medicacao"] = _waiting(
    "qtde_pacientes_fila_med", 32, ">= 71",
    "AND enc IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O')",
)

SQL["fila_triagem"] = _with("encounters", """
SELECT count(*) AS quantidade FROM encounters
WHERE CAST(arrival AS DATE) = DATE '2001-07-31' AND company = 2 AND severity <> '4'
  AND enc IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 1)""")

_DAY_VISITS = "SELECT enc FROM encounters WHERE arrival >= TIMESTAMP '2001-07-30 18:00:00'"
_KNOWN = "SELECT * FROM steps WHERE step IN (SELECT n_nationkey + 8 FROM nation)"
SQL["media_espera_classificacao"] = _with("encounters steps", _pairs(_DAY_VISITS, "SELECT * FROM steps", 1, 11, fold=True))
SQL["media_espera_atendimento_medico"] = _with("encounters steps", _pairs(
    _DAY_VISITS + " AND arrival <= TIMESTAMP '2001-07-31 18:00:00'", _KNOWN, 22, 31, fold=False
))
SQL["media_espera_cadastro"] = _with("encounters steps", _pairs(_DAY_VISITS, _KNOWN, 12, 21, fold=True))

SQL["qtd_pacientes_retorno_7_dias"] = _with("encounters", """
SELECT count(*) AS pacientes_reconsultadores FROM (
  SELECT patient FROM encounters WHERE kind = 'U' AND company = 2 AND arrival >= TIMESTAMP '2001-07-24 18:00:00'
  GROUP BY 1 HAVING count(*) > 2)""")


SQL["returners_by_doctor"] = _with("encounters", """
SELECT count(*) AS n FROM (
  SELECT doctor FROM encounters WHERE kind = 'U' AND company = 2 AND arrival >= TIMESTAMP '2001-07-24 18:00:00'
  GROUP BY 1 HAVING count(*) > 1)""")


def _sheet(condition: str) -> str:
    return _with("encounters given_items", f"""
, readings AS (
  SELECT event_id // 5 AS enc, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2),
drugs AS (SELECT rx, string_agg(drug, ' | ' ORDER BY drug) AS medicamentos FROM given_items GROUP BY 1)
SELECT e.enc AS cd_atendimento, e.patient AS cd_paciente, c_name AS nm_paciente,
       strftime(arrival, '%d/%m/%Y %H:%M') AS dt_atendimento, s_name AS medico,
       coalesce(r_regionkey::VARCHAR, '') || ' - ' || coalesce(r_name, '') AS cid,
       CASE WHEN price > 400000 THEN 'NÃO CLASSIFICADO'
            ELSE ['BRANCO', 'VERMELHO', 'AMARELO', 'VERDE', 'AZUL'][severity::INT] END AS classificacao,
       complaint AS anamnese, medicamentos,
       (SELECT value FROM readings r WHERE r.enc = e.enc AND event_type = 'signup') AS temperatura,
       (SELECT value FROM readings r WHERE r.enc = e.enc AND event_type = 'view') AS frequencia_cardiaca,
       (SELECT value FROM readings r WHERE r.enc = e.enc AND event_type = 'click') AS pressao_sistolica,
       (SELECT value FROM readings r WHERE r.enc = e.enc AND event_type = 'purchase') AS pressao_diastolica,
       (SELECT value FROM readings r WHERE r.enc = e.enc AND event_type = 'error') AS spo2,
       NULL::DOUBLE AS glicemia
FROM encounters e JOIN customer ON c_custkey = e.patient LEFT JOIN supplier ON s_suppkey = e.doctor
LEFT JOIN region ON r_regionkey::VARCHAR = e.severity LEFT JOIN drugs ON rx = e.enc
WHERE {condition}""").replace(")\n, readings", "),\nreadings")


SQL["retorno"] = _sheet("kind = 'U' AND company = 2 AND arrival >= TIMESTAMP '2001-07-01' AND arrival < TIMESTAMP '2001-08-01'")
SQL["encounter_summary"] = _sheet("kind <> 'H' AND arrival >= TIMESTAMP '2001-01-01' AND arrival < TIMESTAMP '2001-08-01'")

SQL["internados"] = _with("encounters", f"SELECT count(*) AS quant FROM encounters WHERE {_ROOT} AND arrival {_TODAY}")

SQL["leito_uti"] = _with("wards", """
SELECT count(*) AS leitos_ocupados_uti FROM customer JOIN wards ON ward = c_nationkey
WHERE active AND setor LIKE 'Uti 1%' AND c_acctbal >= 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')""")

SQL["tmp_por_setor"] = _with("encounters wards", """
SELECT setor, (sum(date_sub('microsecond', arrival, left_at))::HUGEINT * 100 // (count(*) * 86400000000))::DOUBLE / 100
         AS tmp_dias
FROM encounters JOIN customer ON c_custkey = patient JOIN wards ON ward = c_nationkey
WHERE kind = 'I' AND active AND left_at >= TIMESTAMP '2001-07-01' GROUP BY 1""")

SQL["obitos_faixa_etaria_cid"] = _with("encounters", f"""
SELECT CASE WHEN age < 18 THEN '0–17' WHEN age < 60 THEN '18–59' ELSE '60+' END AS faixa_etaria,
       severity AS cd_cid, r_name AS nome_cid, count(*) AS qtd_obitos
FROM (SELECT severity, trunc({_months('left_at', 'birth')} / 12) AS age
      FROM encounters JOIN (
        SELECT c_custkey, CASE WHEN c_mktsegment <> 'FURNITURE'
                               THEN TIMESTAMP '2001-01-01' - to_days(CAST(floor(c_acctbal * 3) AS INTEGER)) END AS birth
        FROM customer) ON c_custkey = patient
      WHERE price > 400000)
JOIN region ON r_regionkey::VARCHAR = severity GROUP BY ALL""")

SQL["cirurgias_status_mes"] = """
SELECT strftime(o_orderdate, '%Y-%m') AS mes, CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'A' ELSE 'at' END AS tp_situacao,
       count(*) AS qtde FROM orders GROUP BY 1, 2"""

SQL["cirurgias_realizadas_por_tipo"] = _with("surgeries", """
SELECT strftime(done, '%Y-%m') AS mes, brand AS tipo_cirurgia, count(*) AS qtde FROM surgeries
WHERE done IS NOT NULL GROUP BY 1, 2""")

SQL["medicamentos_alto_risco"] = _with("given_items", """
SELECT strftime(day, '%Y-%m') AS mes, drug AS ds_produto, count(*) AS qtde FROM given_items
WHERE day >= TIMESTAMP '2000-08-01' GROUP BY 1, 2""")

# Texts of items below quantity 14 all start with a conditional prefix.
for _key, _company in (("top_20_medicamentos_ps", 2), ("top_20_medicamentos_sc", 1)):
    SQL[_key] = _with("given_items encounters", f"""
SELECT * FROM (
  SELECT drug AS medicamento, count(*) AS qtde_prescricoes, row_number() OVER (ORDER BY count(*) DESC, drug) AS rn
  FROM given_items JOIN encounters ON enc = rx
  WHERE day >= TIMESTAMP '2000-07-31' AND company = {_company} AND quantity >= 14 GROUP BY 1)
WHERE rn <= 20""")

SQL["antibioticos_vs_analgesicos"] = _with("given_items", """
SELECT CAST(date_trunc('month', day) AS TIMESTAMP) AS mes,
       CASE WHEN noun IN ('bolt', 'rod', 'plate') THEN 'ANTIBIOTICO' WHEN noun IN ('anvil', 'gear', 'ring') THEN 'ANALGESICO'
            ELSE 'OUTROS' END AS classe, count(*) AS qtde
FROM given_items WHERE day >= TIMESTAMP '2000-07-31' GROUP BY 1, 2""")

SQL["tempo_medio_por_tipo_cirurgia"] = _with("surgeries", _hours_minutes(
    "SELECT brand AS tipo_cirurgia, seconds AS s FROM surgeries WHERE severity <> '5'", "tipo_cirurgia"
))

SQL["cirurgias_realizadas_por_porte_12m"] = _with("surgeries", """
SELECT mesano, ['Pequeno Porte', 'Médio Porte', 'Grande Porte', 'Especial', NULL, NULL][band] AS porte, qtde FROM (
  SELECT strftime(done, '%m/%Y') AS mesano,
         CASE WHEN size <= 40 THEN greatest(1, (size - 1) // 10 + 1) WHEN size <= 45 THEN 5 ELSE 6 END AS band,
         count(*) AS qtde
  FROM surgeries WHERE done >= TIMESTAMP '2000-07-01' AND severity <= '3' GROUP BY 1, 2)""")

SQL["cirurgias_realizadas_por_medico"] = _with("surgeries", """
SELECT strftime(done, '%Y-%m') AS mes, s_name AS medico, count(*) AS qtde
FROM (SELECT done, severity, min(supplier) OVER (PARTITION BY notice, line) AS lead FROM surgeries)
JOIN supplier ON s_suppkey = lead WHERE severity <= '3' GROUP BY 1, 2""")

_WORK = f"""
SELECT event_id AS cd_os, CASE WHEN value < 20 THEN 'A' ELSE 'S' END AS tp_situacao, asked AS dt_pedido,
       (100 * age // 3600000000)::DOUBLE / 100 AS horas_em_aberto,
       CASE event_type WHEN 'error' THEN props ELSE event_type END AS descricao_os, 'Requester ' || user_id AS nm_solicitante
FROM (SELECT *, date_sub('microsecond', asked, TIMESTAMP '2001-07-31 18:00:00') AS age
      FROM (SELECT *, ts - to_seconds({_SHIFT}) AS asked FROM events))
WHERE event_type IN ('error', 'click') AND value < 50 AND age """
SQL["os_manutencao_aberta_ate_12h"] = _WORK + "<= 43200000000"
SQL["os_manutencao_aberta_12_24h"] = _WORK + "> 43200000000 AND age <= 86400000000"
SQL["os_manutencao_aberta_mais_24h"] = _WORK + "> 86400000000"

SQL["medicacao_administrada"] = _with("given_items", """
SELECT strftime(day, '%d/%m/%Y') AS data_prescricao, rx AS cd_pre_med, item AS cd_itpre_med, drug AS medicamento,
       s_name AS medico
FROM given_items JOIN supplier ON s_suppkey = doctor WHERE quantity >= 14""")

SQL["prescription_pages"] = _with("given_items", """
SELECT (nth - 1)::INTEGER // 40 AS page, strftime(day, '%d/%m/%Y') AS data_prescricao, rx AS cd_pre_med, item AS cd_itpre_med,
       drug AS medicamento, s_name AS medico
FROM (SELECT *, row_number() OVER (ORDER BY day DESC, rx, item, drug, s_name) AS nth
      FROM given_items JOIN supplier ON s_suppkey = doctor WHERE quantity >= 14) WHERE nth <= 120""")

SQL["medicamentos_prescritos_por_medico"] = _with("given_items", """
SELECT s_name AS medico, count(*) AS qtde_medicamentos FROM given_items JOIN supplier ON s_suppkey = doctor
WHERE day >= TIMESTAMP '2000-07-31' GROUP BY 1""")

SQL["atendimento_por_horario"] = _with("encounters steps", """
SELECT strftime(arrival, '%d/%m/%Y') AS data, strftime(arrival, '%H') AS horario, count(*) AS quantidade
FROM encounters JOIN steps ON visit = enc
WHERE step = 1 AND company = 2 AND CAST(arrival AS DATE) = DATE '2001-07-31' GROUP BY 1, 2""")

# Streams: windows that the watermark has closed.

_CLOSED = "(SELECT max(ts) FROM events) - INTERVAL {}"
SQL["stream_hourly_arrivals"] = """
SELECT strftime(hour, '%d/%m/%Y') AS data, strftime(hour, '%H') AS horario, count(*) AS quantidade
FROM (SELECT date_trunc('hour', ts) AS hour FROM events WHERE event_type = 'signup')
WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events WHERE event_type = 'signup') - INTERVAL 10 MINUTE GROUP BY 1, 2"""

SQL["stream_step_wait"] = _with("visit_events", _pairs(
    "SELECT visit FROM visit_events", _EVENTS + """ WHERE CAST(ts AS DATE) + INTERVAL 1 DAY
      <= (SELECT max(ts) FROM events WHERE event_type IN ('signup', 'view')) - INTERVAL 10 MINUTE""", 1, 11, fold=False,
))

SQL["stream_stalled_visits"] = _stalled(12)

# Visits of a user from 18:00 to 18:00, which cross midnight.
_OVERNIGHT = """night_events AS (
  SELECT user_id * 1000 + date_diff('day', DATE '2024-01-01', CAST(ts + INTERVAL 6 HOUR AS DATE)) AS visit, ts, event_type, value,
    CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 11 WHEN 'click' THEN 12 WHEN 'purchase' THEN 22 WHEN 'error' THEN 32 END AS step
  FROM events),
nights AS (SELECT visit, min(ts) AS arrival FROM night_events GROUP BY 1)"""


def _stalled_overnight(step: int, since: str, extra: str = "") -> str:
    return f"""WITH {_OVERNIGHT}
SELECT count(DISTINCT v.visit) AS n FROM nights v JOIN night_events e ON e.visit = v.visit AND e.step = {step}
WHERE v.arrival >= TIMESTAMP '{since}' {extra}
  AND NOT EXISTS (SELECT 1 FROM night_events f WHERE f.visit = v.visit AND f.step > {step})"""


SQL["stream_step_wait_overnight"] = f"""WITH {_OVERNIGHT},
final AS (SELECT visit, step, ts AS at FROM night_events WHERE step IN (1, 11) AND date_trunc('hour', ts) + INTERVAL 1 HOUR
      <= (SELECT max(ts) FROM night_events WHERE step IN (1, 11)) - INTERVAL 10 MINUTE),
recent AS (SELECT visit FROM final GROUP BY 1 HAVING min("at") >= TIMESTAMP '2024-01-23')
""" + _pairs("SELECT visit FROM recent", "SELECT * FROM final", 1, 11, fold=False)

SQL["stream_stalled_overnight"] = _stalled_overnight(12, "2024-01-29 23:59:59")

SQL["stream_stalled_with_pending"] = _stalled_overnight(
    22, "2024-01-23", "AND v.visit IN (SELECT visit FROM night_events WHERE event_type = 'view' AND value > 20)"
)

SQL["stream_latest_visits"] = f"""WITH {_OVERNIGHT}
SELECT visit, min(ts) AS arrival, bool_or(step = 12) AS reached, bool_or(step > 12) AS passed
FROM night_events GROUP BY 1 HAVING min(ts) >= TIMESTAMP '2024-01-29 23:59:59'"""

SQL["stream_threshold_alerts"] = """
SELECT DISTINCT user_id AS unit_id, 'Enfermagem' AS area, 'Sobrecarga operacional' AS titulo
FROM (SELECT user_id, date_trunc('day', ts) AS day, sum(value) AS value FROM events GROUP BY 1, 2)
WHERE value > 40 AND day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""

# Run log of the whole catalog.

_COLUMNS = {
    "internacao_e_altas": "ord,indic,quant",
    "obitos_mes": "mes_ano,qtd_obitos",
    "fila_recepcao": "qtde_pacientes_fila",
    "fila_triagem": "quantidade",
    "fila_atendimento_medico": "qtde_pacientes_fila_consulta",
    "fila_medicacao": "qtde_pacientes_fila_med",
    "media_espera_classificacao": "dif_em_hrs,minutes",
    "media_espera_atendimento_medico": "dif_em_hrs,minutes",
    "media_espera_cadastro": "dif_em_hrs,minutes",
    "qtd_pacientes_retorno_7_dias": "pacientes_reconsultadores",
    "retorno": "cd_atendimento,cd_paciente,nm_paciente,dt_atendimento,medico,cid,classificacao,anamnese,temperatura,"
    "frequencia_cardiaca,pressao_sistolica,pressao_diastolica,spo2,glicemia,medicamentos",
    "internados": "quant",
    "leito_uti": "leitos_ocupados_uti",
    "tmp_por_setor": "setor,tmp_dias",
    "obitos_faixa_etaria_cid": "faixa_etaria,cd_cid,nome_cid,qtd_obitos",
    "cirurgias_status_mes": "mes,tp_situacao,qtde",
    "cirurgias_realizadas_por_tipo": "mes,tipo_cirurgia,qtde",
    "medicamentos_alto_risco": "mes,ds_produto,qtde",
    "top_20_medicamentos_ps": "medicamento,qtde_prescricoes,rn",
    "top_20_medicamentos_sc": "medicamento,qtde_prescricoes,rn",
    "antibioticos_vs_analgesicos": "mes,classe,qtde",
    "tempo_medio_por_tipo_cirurgia": "tipo_cirurgia,horas,minutos",
    "cirurgias_realizadas_por_porte_12m": "mesano,porte,qtde",
    "cirurgias_realizadas_por_medico": "mes,medico,qtde",
    "os_manutencao_aberta_ate_12h": "cd_os,tp_situacao,dt_pedido,horas_em_aberto,descricao_os,nm_solicitante",
    "os_manutencao_aberta_12_24h": "cd_os,tp_situacao,dt_pedido,horas_em_aberto,descricao_os,nm_solicitante",
    "os_manutencao_aberta_mais_24h": "cd_os,tp_situacao,dt_pedido,horas_em_aberto,descricao_os,nm_solicitante",
    "medicacao_administrada": "data_prescricao,cd_pre_med,cd_itpre_med,medicamento,medico",
    "medicamentos_prescritos_por_medico": "medico,qtde_medicamentos",
    "atendimento_por_horario": "data,horario,quantidade",
}


def _log_row(area: str, key: str) -> str:
    if key in _EVOLUTIONS:
        body, columns = _evolution(*_EVOLUTIONS[key], "2001 AND 2001"), "competencia,tp_atendimento,qtd"
    else:
        body, columns = SQL[key], _COLUMNS[key]
    return (
        f"SELECT '{area}' AS area, '{key}' AS query_key, '{query_label(key)}' AS query_label, n AS row_count, "
        f"CASE WHEN n > 0 THEN '{columns}' ELSE '' END AS columns, n > 20 AS truncated, NULL::VARCHAR AS error "
        f"FROM (SELECT count(*) AS n FROM ({body}))"
    )


SQL["catalog_run_log"] = " UNION ALL ".join(_log_row(q.area, q.key) for q in catalog())

# Samples: the first 20 rows of each result as JSON, in the order of the result.
_SAMPLE_ORDER = {
    "internacao_e_altas": "ord", "obitos_mes": "mes_ano", "cirurgias_status_mes": "mes NULLS LAST, tp_situacao NULLS LAST",
    "top_20_medicamentos_ps": "rn", "top_20_medicamentos_sc": "rn",
    **{key: "competencia, tp_atendimento" for key in _EVOLUTIONS},
}


def _sample(key: str) -> str:
    body = _evolution(*_EVOLUTIONS[key], "2001 AND 2001") if key in _EVOLUTIONS else SQL[key]
    columns = "competencia,tp_atendimento,qtd" if key in _EVOLUTIONS else _COLUMNS[key]
    pairs = ", ".join(f"{c} := {c}" for c in columns.split(","))
    return f"""SELECT '{key}' AS query_key, n > 20 AS truncated, (nth - 1)::INTEGER AS place, to_json(struct_pack({pairs}))::VARCHAR AS row
FROM (SELECT *, row_number() OVER (ORDER BY {_SAMPLE_ORDER.get(key, "1")}) AS nth, count(*) OVER () AS n FROM ({body})) WHERE nth <= 20"""


SQL["catalog_samples"] = " UNION ALL ".join(_sample(key) for key in [
    *_EVOLUTIONS, "internacao_e_altas", "obitos_mes", "fila_recepcao", "fila_triagem", "internados", "leito_uti", "cirurgias_status_mes",
    "top_20_medicamentos_ps", "top_20_medicamentos_sc", "qtd_pacientes_retorno_7_dias",
])

# The snapshot of the catalog: its figures come from seven catalog queries, its run log from those of the shared area.

_SNAPSHOT = {
    "figures": f"""
        SELECT TIMESTAMP '2001-07-31 18:00:00' AS as_of, 1::BIGINT AS unit_id,
               coalesce((SELECT arg_min(qtd_obitos, mes_ano) FROM ({SQL["obitos_mes"]})), 0) AS deaths,
               (SELECT count(*) FROM ({SQL["medicamentos_alto_risco"]}) WHERE qtde < 10) AS low,
               coalesce((SELECT arg_max(quant, ord) FROM ({SQL["internacao_e_altas"]}) WHERE indic ILIKE '%internados%'), 0) AS admitted,
               coalesce((SELECT arg_max(quant, ord) FROM ({SQL["internacao_e_altas"]})
                         WHERE indic ILIKE '%altas%' AND indic NOT ILIKE '%internados%'), 0) AS discharged,
               (SELECT qtde_pacientes_fila FROM ({SQL["fila_recepcao"]})) + (SELECT quantidade FROM ({SQL["fila_triagem"]})) AS queue,
               (SELECT quant FROM ({SQL["internados"]})) AS inside,
               (SELECT sum(qtde) FROM ({SQL["cirurgias_status_mes"]}) WHERE tp_situacao IN ('A', 'at')) AS late,
               (SELECT sum(qtde) FROM ({SQL["cirurgias_status_mes"]})) AS surgeries""",
    "runs": "SELECT TIMESTAMP '2001-07-31 18:00:00' AS as_of, 1::BIGINT AS unit_id, area, query_key, row_count, error FROM ("
    + " UNION ALL ".join(_log_row(q.area, q.key) for q in catalog() if q.area == "Operações Integradas") + ")",
}
SQL["catalog_metrics"] = _with("metrics", "SELECT * FROM metrics", _SNAPSHOT)
SQL["catalog_status"] = _with("shown", _STATUS, _SNAPSHOT)
SQL["catalog_alerts"] = _with("alerts", "SELECT * FROM alerts", _SNAPSHOT)
SQL["catalog_findings"] = _with("runs wide", f"SELECT * FROM ({_FINDINGS})", _SNAPSHOT)

# Every hour of July 2001, by comparing each hour with each row.

_HOURS = "unnest(generate_series(TIMESTAMP '2001-07-01', TIMESTAMP '2001-07-31 23:00:00', INTERVAL 1 HOUR))"
_TIMELINE = {
    "hours": f"SELECT {_HOURS} AS as_of",
    "marks": """
        SELECT visit, min("at") FILTER (step = 12) AS reached, min("at") FILTER (step > 12) AS passed FROM steps GROUP BY 1""",
    "hourly_queue": """
        SELECT as_of, company AS cd_multi_empresa, count(*) AS n FROM hours, encounters JOIN marks ON visit = enc
        WHERE arrival <= as_of AND arrival >= as_of - INTERVAL 1 DAY AND reached <= as_of AND (passed IS NULL OR passed > as_of)
        GROUP BY 1, 2""",
    "hourly_triage": """
        SELECT as_of, company AS cd_multi_empresa, count(*) AS quantidade
        FROM (SELECT as_of, enc, company FROM hours, encounters JOIN steps ON visit = enc
              WHERE severity IN ('1', '2', '3', '5') AND CAST(arrival AS DATE) = CAST(as_of AS DATE) AND arrival <= as_of AND "at" <= as_of
              GROUP BY ALL HAVING count(*) = 1) GROUP BY 1, 2""",
    "inpatients": "SELECT *, left_at - INTERVAL 2 HOUR AS medical FROM encounters WHERE parent IS NULL AND kind = 'I'",
    "hourly_indicators": "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT as_of, company AS cd_multi_empresa, {k} AS ord, '{name}' AS indic, count(*) AS quant FROM hours, inpatients "
        f"WHERE arrival <= as_of AND {ts} BETWEEN date_trunc('day', as_of) AND as_of {more} GROUP BY 1, 2"
        for k, (name, ts, more) in enumerate(zip(
            fixed.INDICATORS, ["arrival", "left_at", "medical", "expected", "expected"],
            ["", "", "", "", "AND (left_at IS NULL OR left_at > as_of)"]), 1)
    ) + ")",
    "figures": """
        SELECT h.as_of, u.unit_id, NULL::BIGINT AS deaths, NULL::BIGINT AS low, NULL::BIGINT AS late, NULL::BIGINT AS surgeries,
               coalesce(a.quant, 0) AS admitted, coalesce(d.quant, 0) AS discharged, coalesce(a.quant, 0) AS inside,
               coalesce(q.n, 0) + coalesce(t.quantidade, 0) AS queue
        FROM hours h CROSS JOIN (SELECT unnest([1, 2, 3])::BIGINT AS unit_id) u
        LEFT JOIN hourly_indicators a ON a.as_of = h.as_of AND a.cd_multi_empresa = u.unit_id AND a.ord = 1
        LEFT JOIN hourly_indicators d ON d.as_of = h.as_of AND d.cd_multi_empresa = u.unit_id AND d.ord = 5
        LEFT JOIN hourly_queue q ON q.as_of = h.as_of AND q.cd_multi_empresa = u.unit_id
        LEFT JOIN hourly_triage t ON t.as_of = h.as_of AND t.cd_multi_empresa = u.unit_id""",
}
_CTE |= {name: body for name, body in _TIMELINE.items() if name != "figures"}
_NEEDS |= {
    "marks": ["steps"], "hourly_queue": ["hours", "encounters", "marks"], "hourly_triage": ["hours", "encounters", "steps"],
    "inpatients": ["encounters"], "hourly_indicators": ["hours", "inpatients"],
}
_HOURLY = "hourly_queue hourly_triage hourly_indicators"
_FIGURES = {"figures": _TIMELINE["figures"]}
SQL["timeline_queue"] = _with("hourly_queue", "SELECT * FROM hourly_queue")
SQL["timeline_triage"] = _with("hourly_triage", "SELECT * FROM hourly_triage")
SQL["timeline_indicators"] = _with("hourly_indicators", "SELECT * FROM hourly_indicators")
SQL["timeline_census"] = _with("hours inpatients", """
SELECT as_of, company AS cd_multi_empresa, count(*) AS n FROM hours, inpatients
WHERE arrival <= as_of AND (left_at IS NULL OR left_at > as_of) GROUP BY 1, 2""")
SQL["timeline_metrics"] = _with(f"{_HOURLY} metrics", "SELECT * FROM metrics", _FIGURES)
SQL["timeline_alerts"] = _with(f"{_HOURLY} limit_alerts", "SELECT * FROM limit_alerts", _FIGURES)

# The same rows from stored counts.
SQL |= {f"rollup_{key}": SQL[key] for key in ANSWERS}

"""Every operator bound to the test tables.

Emergency visits are user days of ``events``; encounters and prescriptions are
orders; items are lines; products are parts; prescribers are suppliers; wards
are nations.  ``driver_sql`` has the same queries in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import fixed
from wardlight.functions.dates import days_before, ntz, shift_months
from wardlight.operators import aging as ageing
from wardlight.operators import alerts, annotations, counting, encounters, findings, metrics, pharmacy, queues, stays, waits
from wardlight.operators.timeline import Grid
from wardlight.plans import rollups
from wardlight.plans import timeline as timelines
from wardlight.plans.catalog import catalog, find, prescribed_items_page
from wardlight.plans.runs import run_catalog, snapshot_metrics
from wardlight.session import shared_folder, written
from wardlight.sources.driver_tables import (
    EVENTS_AS_OF,
    HOSPITAL_AS_OF,
    ORDERS_AS_OF,
    driver_table,
    hospital_tables,
)
from wardlight.streaming import jobs
from wardlight.streaming import visits as live

QueryFn = Callable[[SparkSession, str], DataFrame]

STEP_OF_EVENT = {"signup": 1, "view": 11, "click": 12, "purchase": 22, "error": 32}
STATUS_LABELS = {"F": "Fechado", "O": "Aberto"}
PRIORITY_LABELS = {"1-URGENT": "Urgente", "2-HIGH": "Alta", "3-MEDIUM": "Normal"}
NAME_RULES = [("ROUND", ["RING", "ROD"]), ("FLAT", ["PLATE", "GEAR"]), ("COLD", ["COLD"])]
VISITS_SINCE = datetime(2024, 1, 23)
SPAN_BANDS = [("below 1", 1), ("1 to 2", 3)]

QUERIES: dict[str, QueryFn] = {}


def _bound(build: QueryFn) -> QueryFn:
    QUERIES[build.__name__] = build
    return build


# Inputs.

def _orders(spark, folder):
    return driver_table(spark, folder, "orders")


def _lines(spark, folder):
    return driver_table(spark, folder, "lineitem")


def _parts(spark, folder):
    return driver_table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")


def _lines_of_orders(spark, folder):
    lines = _lines(spark, folder)
    return lines.join(_orders(spark, folder), lines["l_orderkey"] == F.col("o_orderkey"))


def _step_events(spark, folder):
    """Events with their visit (user and day) and step code."""
    step = F.create_map(*[F.lit(x) for pair in STEP_OF_EVENT.items() for x in pair])[F.col("event_type")]
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return driver_table(spark, folder, "events").select(
        (F.col("user_id") * 1000 + day).alias("visit"), step.alias("step"), "ts", "value", "user_id", "event_type"
    )


def _visits(spark, folder):
    return _step_events(spark, folder).groupBy("visit").agg(F.min("ts").alias("arrival"))


# Counts.

@_bound
def monthly_evolution(spark, folder):
    return counting.monthly_evolution(
        _orders(spark, folder), "o_orderdate", "o_orderstatus", STATUS_LABELS, F.col("o_totalprice") > 20000, 1996, 1999
    )


@_bound
def period_indicators(spark, folder):
    month = (F.col("o_orderdate") >= F.lit("2001-07-01").cast("timestamp_ntz"))
    shipped = F.col("l_shipdate").between(
        F.lit("2001-07-01").cast("timestamp_ntz"), F.lit("2001-08-01").cast("timestamp_ntz")
    )
    return counting.period_indicators(_lines_of_orders(spark, folder), [
        ("ordered", month),
        ("shipped", shipped),
        ("shipped and returned", shipped & (F.col("l_returnflag") == "R")),
        ("shipped of open orders", shipped & (F.col("o_orderstatus") == "O")),
        ("shipped late", shipped & (F.col("l_shipdate") > F.col("o_orderdate"))),
    ], F.col("o_totalprice") > 20000)


@_bound
def count_in_period(spark, folder):
    return counting.count_in_period(
        _orders(spark, folder), "o_orderdate", shift_months(ORDERS_AS_OF, -1), ORDERS_AS_OF,
        F.col("o_orderstatus") != "P",
    )


@_bound
def monthly_count(spark, folder):
    return counting.monthly_count(
        _orders(spark, folder), "o_orderdate", where=F.col("o_orderstatus") == "F",
        since=shift_months(ORDERS_AS_OF, -12),
    )


@_bound
def monthly_count_dim(spark, folder):
    return counting.monthly_count(_orders(spark, folder), "o_orderdate", ["o_orderstatus"])


@_bound
def monthly_count_joined(spark, folder):
    rows = _lines_of_orders(spark, folder).filter(F.col("o_orderdate") >= F.lit("2000-09-01").cast("timestamp_ntz"))
    counted = counting.monthly_count(rows, "o_orderdate", ["l_partkey"])
    return counting.counts_by_name(counted, _parts(spark, folder), "l_partkey", "p_name", ["mes"])


@_bound
def monthly_count_label(spark, folder):
    return counting.monthly_count(
        _orders(spark, folder), "o_orderdate", ["o_orderpriority"], {"o_orderpriority": PRIORITY_LABELS},
        fmt="MM/yyyy", month="mesano",
    )


@_bound
def monthly_count_two_key(spark, folder):
    lines = _lines(spark, folder)
    leads = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("lead"))
    counted = counting.monthly_count(lines.join(leads, ["l_orderkey", "l_linenumber"]), "l_shipdate", ["lead"])
    names = driver_table(spark, folder, "supplier").select(F.col("s_suppkey").alias("lead"), "s_name")
    return counting.counts_by_name(counted, names, "lead", "s_name", ["mes"])


@_bound
def count_by_entity(spark, folder):
    counted = counting.count_by_entity(_lines(spark, folder), "l_suppkey", "l_shipdate", shift_months(ORDERS_AS_OF, -12))
    names = driver_table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return counting.counts_by_name(counted, names, "l_suppkey", "s_name")


@_bound
def hourly_arrivals(spark, folder):
    return counting.hourly_arrivals(
        _visits(spark, folder), _step_events(spark, folder), "visit", "arrival", EVENTS_AS_OF
    )


# Queues and waits.

def _stalled(spark, folder, at, require=None):
    return queues.stalled_at_step(
        _visits(spark, folder), _step_events(spark, folder), "visit", "step", at, F.col("step") > at, VISITS_SINCE,
        "arrival", require,
    )


@_bound
def stalled_at_step(spark, folder):
    return _stalled(spark, folder, 12)


@_bound
def stalled_with_pending(spark, folder):
    pending = _step_events(spark, folder).filter("event_type = 'view' and value > 20")
    return _stalled(spark, folder, 22, pending)


@_bound
def single_event_queue(spark, folder):
    return queues.single_event_queue(
        _visits(spark, folder), _step_events(spark, folder), "visit", EVENTS_AS_OF, "arrival"
    )


def _wait(spark, folder, fold, from_step=1, to_step=11):
    return waits.step_wait(
        _visits(spark, folder), _step_events(spark, folder), "visit", "step", "ts", from_step, to_step, "arrival",
        VISITS_SINCE, fold_hours=fold,
    )


@_bound
def step_wait(spark, folder):
    return _wait(spark, folder, fold=False)


@_bound
def step_wait_folded(spark, folder):
    return _wait(spark, folder, fold=True, from_step=12, to_step=22)


@_bound
def frequent_returners(spark, folder):
    return queues.frequent_returners(
        _orders(spark, folder), "o_custkey", "o_orderkey", "o_orderdate", ORDERS_AS_OF, 365, 2,
        F.col("o_orderstatus") != "P",
    )


@_bound
def mean_duration_hm(spark, folder):
    rows = _lines_of_orders(spark, folder).filter("l_shipdate >= o_orderdate")
    totals = waits.duration_totals(rows, ["l_partkey"], "o_orderdate", "l_shipdate")
    return waits.mean_duration_hm(
        waits.duration_totals_by(totals, _parts(spark, folder), "l_partkey", "p_brand"), "p_brand"
    )


# Encounters, beds, stays.

@_bound
def latest_pivot(spark, folder):
    codes = {name: f"last_{name}" for name in STEP_OF_EVENT}
    events = driver_table(spark, folder, "events")
    return encounters.latest_pivot(events, ["user_id"], "event_type", "value", "ts", "event_id", codes)


@_bound
def ordered_list(spark, folder):
    rows = _lines(spark, folder).join(_parts(spark, folder), "l_partkey")
    return encounters.ordered_list(rows, "l_orderkey", "p_name")


@_bound
def encounter_summary(spark, folder):
    return encounters.encounter_summary(
        hospital_tables(spark, folder), datetime(2001, 1, 1), F.col("tp_atendimento") != "H", months=7
    )


@_bound
def occupied_beds(spark, folder):
    return stays.occupied_beds(
        driver_table(spark, folder, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"),
        driver_table(spark, folder, "nation"), "nation_1", "n_nationkey", "s_suppkey", "n_name",
        F.col("s_acctbal") > 0, F.col("n_regionkey") != 4,
    )


@_bound
def mean_stay_by_group(spark, folder):
    customers = driver_table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nations = driver_table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = _lines_of_orders(spark, folder).join(customers, "o_custkey").join(nations, "c_nationkey")
    return stays.mean_stay_by_group(
        rows, "n_name", "o_orderdate", "l_shipdate", datetime(2000, 1, 1), F.expr("l_shipdate >= o_orderdate")
    )


@_bound
def count_by_age_band(spark, folder):
    return stays.count_by_age_band(
        _lines_of_orders(spark, folder), "o_orderdate", "l_shipdate", SPAN_BANDS, "3 and more", ["l_returnflag"]
    )


# Pharmacy and work orders.

@_bound
def top_k_by_count(spark, folder):
    return pharmacy.top_k_by_count(
        _lines(spark, folder), "l_partkey", 20, F.col("l_quantity") > 3, "l_returnflag", ["R"],
        _parts(spark, folder), "p_name",
    )


@_bound
def keyword_class_monthly(spark, folder):
    return pharmacy.keyword_class_monthly(
        _lines(spark, folder), "l_shipdate", "l_partkey", _parts(spark, folder), "p_name", NAME_RULES, "OTHER",
        shift_months(ORDERS_AS_OF, -12),
    )


@_bound
def prescription_detail(spark, folder):
    orders = _orders(spark, folder).select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return pharmacy.prescription_detail(
        _lines(spark, folder), orders, _parts(spark, folder),
        driver_table(spark, folder, "supplier").withColumnRenamed("s_suppkey", "l_suppkey"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "o_orderdate", "p_name", "s_name",
        "l_returnflag", ["N"],
    )


def _aged(bucket):
    def build(spark, folder):
        events = driver_table(spark, folder, "events")
        where = F.col("event_type").isin("error", "click")
        return ageing.aging(events, "ts", EVENTS_AS_OF, where, ["event_id", "event_type"], only=bucket)

    return build


QUERIES["aging_ate_12h"] = _aged("ate_12h")
QUERIES["aging_12_24h"] = _aged("12_24h")
QUERIES["aging_mais_24h"] = _aged("mais_24h")
QUERIES["aging"] = _aged(None)


# Metrics and alerts: one snapshot per year and nation, drawn from its orders.

KEYS = ["as_of", "unit_id"]


def _facts(spark, folder):
    customers = driver_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("unit_id")
    )
    quarter = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-Q"), F.quarter("o_orderdate").cast("string"))
    return (
        _orders(spark, folder).join(customers, "o_custkey")
        .withColumns({
            "as_of": F.date_trunc("YEAR", "o_orderdate").cast("timestamp_ntz"),
            "quarter": quarter,
            "price": F.col("o_totalprice"),
        })
    )


def _cells(spark, folder):
    """Orders counted once per snapshot and every trait a metric looks at.

    All metric parts read these counts; Spark runs the common shuffle once.
    """
    state = F.when(F.col("price") < 40000, "A").when(F.col("price") < 60000, "at").otherwise("R")
    return _facts(spark, folder).groupBy(
        *KEYS, "quarter", "o_orderpriority", "o_orderstatus", state.alias("tp_situacao"),
        (F.col("price") > 250000).alias("dear"), (F.col("price") < 30000).alias("cheap"),
    ).agg(F.count(F.lit(1)).alias("n"))


def _metrics(spark, folder):
    cells = _cells(spark, folder)

    def total(name, *keys, where=None):
        amount = F.col("n") if where is None else F.when(where, F.col("n")).otherwise(0)
        return cells.groupBy(*KEYS, *keys).agg(F.sum(amount).alias(name))

    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    indicators = [
        (fixed.INDICATORS[0], priority.isin("1-URGENT", "2-HIGH")),
        (fixed.INDICATORS[1], status == "F"),
        (fixed.INDICATORS[2], status == "O"),
        (fixed.INDICATORS[3], status == "P"),
        (fixed.INDICATORS[4], (status == "P") & F.col("cheap")),
    ]
    return metrics.metric_table({
        "period_indicators": counting.period_indicators(cells, indicators, keys=KEYS, weight="n"),
        "deaths": total("qtd_obitos", F.col("quarter").alias("mes_ano")),
        "reception_queue": total("n", where=priority == "1-URGENT"),
        "triage_queue": total("quantidade", where=priority == "5-LOW"),
        "admitted_now": total("quant", where=status == "F"),
        "surgery_status": total("qtde", "tp_situacao"),
        "product_months": total("qtde", "quarter", "dear"),
    })


def _written_metrics(spark, folder):
    """The metric table as later steps of a snapshot job see it: computed once."""
    return written(_metrics(spark, folder), "metrics")


def _alerts(spark, folder, table=None):
    table = _written_metrics(spark, folder) if table is None else table
    return alerts.threshold_alerts(table, alerts.threshold_rules(spark)).unionByName(alerts.cross_alerts(table))


def _run_log(spark, folder):
    """Six runs per snapshot whose row counts are sums over the snapshot's orders."""
    price = F.col("price")
    low = F.count_if(price < 20000)
    none = F.lit(None).cast("string")
    runs = [
        (5, "medicacao_administrada", F.sum(F.floor(price / 60000)), none),
        (5, "medicamentos_prescritos_por_medico", F.count_if(price > 480000), none),
        (5, "os_manutencao_aberta_ate_12h", F.count_if(price < 1500), none),
        (5, "os_manutencao_aberta_12_24h", F.count_if(price.between(1500, 3000)), none),
        (5, "os_manutencao_aberta_mais_24h", F.count_if(price > 495000), none),
        (5, "tempo_medio_por_tipo_cirurgia", F.sum(F.floor(price / 100000)), none),
        (1, "retorno", F.sum(F.floor(price / 20000)), F.when(low == 4, "")),
        (2, "tmp_por_setor", low, F.when(low > 5, "timeout")),
    ]
    counted = _facts(spark, folder).groupBy(*KEYS).agg(*[
        F.struct(
            F.lit(fixed.AREAS[area]).alias("area"), F.lit(key).alias("query_key"), rows.alias("row_count"),
            error.alias("error"),
        ).alias(key)
        for area, key, rows, error in runs
    ])
    return counted.select(*KEYS, F.inline(F.array(*[F.col(key) for _, key, _, _ in runs])))


@_bound
def first_number(spark, folder):
    return metrics.first_number(
        _orders(spark, folder), ["o_orderpriority", "o_totalprice"], ["o_orderdate", "o_orderkey"]
    )


@_bound
def metric_table(spark, folder):
    return _metrics(spark, folder)


@_bound
def metric_status(spark, folder):
    return metrics.metric_status(_metrics(spark, folder), metrics.metric_catalog(spark))


@_bound
def area_pressure(spark, folder):
    return metrics.area_pressure(_metrics(spark, folder), metrics.metric_catalog(spark))


@_bound
def threshold_alerts(spark, folder):
    return alerts.threshold_alerts(_metrics(spark, folder), alerts.threshold_rules(spark))


@_bound
def cross_alerts(spark, folder):
    return alerts.cross_alerts(_metrics(spark, folder))


@_bound
def link_alert_metric(spark, folder):
    table = _written_metrics(spark, folder)
    return alerts.link_alert_metric(_alerts(spark, folder, table), table, metrics.metric_catalog(spark))


@_bound
def alert_order(spark, folder):
    return alerts.alert_order(_alerts(spark, folder))


@_bound
def alert_order_by_text(spark, folder):
    return alerts.alert_order(_alerts(spark, folder), compat=True)


@_bound
def collection_failure_alerts(spark, folder):
    return alerts.collection_failure_alerts(_run_log(spark, folder))


@_bound
def classify_runs(spark, folder):
    return findings.classify_runs(_run_log(spark, folder))


@_bound
def run_summary(spark, folder):
    return findings.run_summary(_run_log(spark, folder), _alerts(spark, folder), KEYS)


@_bound
def cross_findings(spark, folder):
    return findings.cross_findings(_run_log(spark, folder), _metrics(spark, folder))


def _snapshot_sizes(spark, folder):
    return _facts(spark, folder).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


@_bound
def merge_annotations_alert(spark, folder):
    size = F.col("n")
    notes = _snapshot_sizes(spark, folder).select(
        *KEYS,
        F.inline(F.array(
            F.struct(
                F.lit("UTI").alias("area"), F.lit("UTI em lotação").alias("titulo"),
                F.when(size > 80, "media").otherwise("urgente").alias("prioridade"),
                F.concat(F.lit("  revisto com "), size.cast("string"), F.lit(" casos ")).alias("descricao_contextual"),
            ),
            F.struct(
                F.lit("Farmácia").alias("area"), F.lit("Estoque crítico de alto risco").alias("titulo"),
                F.lit("baixa").alias("prioridade"), F.lit("   ").alias("descricao_contextual"),
            ),
        )),
    )
    return annotations.merge_annotations(_alerts(spark, folder), notes, "alert")


@_bound
def merge_annotations_extra(spark, folder):
    size = F.col("n")

    def extra(seq, area, priority, title, text):
        return F.struct(
            F.lit(seq).cast("bigint").alias("seq"), F.lit(area).alias("area"), priority.alias("prioridade"),
            F.lit(title).alias("titulo"), text.alias("descricao"),
        )

    additions = _snapshot_sizes(spark, folder).select(*KEYS, F.inline(F.array(
        extra(1, "UTI", F.lit("alta"), "UTI em lotação", F.lit("já existente ou nova")),
        extra(2, "Diretoria", F.when(size > 80, "alta").otherwise("urgente"), "  Volume anual ", F.lit("volume fora do padrão")),
        extra(3, "Diretoria", F.lit("baixa"), "Volume anual", F.lit("segunda versão")),
        extra(4, "Farmácia", F.lit("media"), "AB", F.lit("título curto")),
        extra(5, "Farmácia", F.lit("media"), "Compra", F.concat(F.lit(" n"), size.cast("string"), F.lit(" "))),
        extra(6, "", F.lit("media"), "Sem área", F.lit("sem área definida")),
    )))
    return annotations.merge_annotations(_alerts(spark, folder), additions, "extra")


@_bound
def merge_annotations_query(spark, folder):
    size = F.col("n")

    def note(seq, key, name, text):
        return F.struct(
            F.lit(seq).cast("bigint").alias("seq"), F.lit(key).alias("query_key"), name.alias("classification"),
            text.alias("summary"),
        )

    notes = _snapshot_sizes(spark, folder).select(*KEYS, F.inline(F.array(
        note(1, " retorno ", F.lit("ATENÇÃO"), F.lit("primeira análise")),
        note(2, "retorno", F.when(size > 80, " crítica").otherwise("grave"), F.lit("segunda análise")),
        note(3, "tmp_por_setor", F.lit("saudável"), F.concat(F.lit("n"), size.cast("string"))),
        note(4, "desconhecida", F.lit("crítica"), F.lit("consulta desconhecida")),
    )))
    classified = findings.classify_runs(_run_log(spark, folder))
    return annotations.merge_annotations(classified, notes, "query")


@_bound
def check_alerts(spark, folder):
    """Alert contract over alerts whose texts come from the documents, whole."""
    docs = driver_table(spark, folder, "documents")
    made = docs.select(
        F.when(F.col("lang") == "fr", "Geral").otherwise("UTI").alias("area"),
        F.when(F.col("lang") == "de", "urgente").otherwise("alta").alias("prioridade"),
        F.col("source").alias("titulo"), F.col("text").alias("descricao"), "doc_id",
    )
    return alerts.check_alerts(made).select("doc_id", "problem")


# The catalog.

def _from_catalog(query):
    def build(spark, folder):
        return query.build(hospital_tables(spark, folder), HOSPITAL_AS_OF)

    return build


for _catalog_query in catalog():
    QUERIES[_catalog_query.key] = _from_catalog(_catalog_query)


@_bound
def returners_by_doctor(spark, folder):
    """Doctors with more than one emergency encounter in a week, as ``qtd_pacientes_retorno_7_dias`` counts patients."""
    where = (F.col("tp_atendimento") == "U") & (F.col("cd_multi_empresa") == 2)
    return queues.frequent_returners(
        hospital_tables(spark, folder)["atendime"], "cd_prestador", "cd_atendimento", "dt_atendimento", HOSPITAL_AS_OF, 7, 1, where)


@_bound
def catalog_run_log(spark, folder):
    """Run log of the whole catalog, without the sample rows."""
    log = run_catalog(spark, hospital_tables(spark, folder), HOSPITAL_AS_OF)
    return log.select(
        "area", "query_key", "query_label", "row_count", F.concat_ws(",", "columns").alias("columns"), "truncated",
        "error",
    )


# The metric layer as a snapshot job has it: metrics from seven catalog queries.

# Queries whose rows come in one order and whose columns are texts and whole numbers.
SAMPLED = (
    "evolucao_atendimentos_internacao", "evolucao_atendimentos_externos", "evolucao_atendimentos_ambulatorio",
    "evolucao_atendimentos_urgencia", "internacao_e_altas", "obitos_mes", "fila_recepcao", "fila_triagem", "internados", "leito_uti",
    "cirurgias_status_mes", "top_20_medicamentos_ps", "top_20_medicamentos_sc", "qtd_pacientes_retorno_7_dias",
)


@_bound
def catalog_samples(spark, folder):
    """The first rows of catalog results, as the run log keeps them."""
    log = run_catalog(spark, hospital_tables(spark, folder), HOSPITAL_AS_OF, [find(key) for key in SAMPLED])
    return log.select("query_key", "truncated", F.posexplode("sample").alias("place", "row"))


def _catalog_table(spark, folder):
    return snapshot_metrics(spark, hospital_tables(spark, folder), HOSPITAL_AS_OF)


@_bound
def catalog_metrics(spark, folder):
    return _catalog_table(spark, folder)


@_bound
def catalog_status(spark, folder):
    return metrics.metric_status(_catalog_table(spark, folder), metrics.metric_catalog(spark))


@_bound
def catalog_alerts(spark, folder):
    return _alerts(spark, folder, written(_catalog_table(spark, folder), "metrics"))


@_bound
def catalog_findings(spark, folder):
    """Findings over the run log of the shared area, which they are about, and the catalog's metrics."""
    shared = [q for q in catalog() if q.area == fixed.AREAS[5]]
    log = run_catalog(spark, hospital_tables(spark, folder), HOSPITAL_AS_OF, shared)
    stamp = {"as_of": ntz(HOSPITAL_AS_OF), "unit_id": F.lit(1).cast("bigint")}
    return findings.cross_findings(log.withColumns(stamp), _catalog_table(spark, folder))


# Many moments and units at once.

JULY = Grid(datetime(2001, 7, 1), datetime(2001, 7, 31, 23))


@_bound
def timeline_queue(spark, folder):
    """The reception queue of every hour of a month, per company; moments without a queue left out."""
    return timelines.reception_queue(hospital_tables(spark, folder), JULY).where("n > 0")


@_bound
def timeline_triage(spark, folder):
    return timelines.triage_queue(hospital_tables(spark, folder), JULY).where("quantidade > 0")


@_bound
def timeline_census(spark, folder):
    return timelines.inpatient_census(hospital_tables(spark, folder), JULY).where("n > 0")


@_bound
def timeline_indicators(spark, folder):
    return timelines.day_indicators(hospital_tables(spark, folder), JULY).where("quant > 0")


@_bound
def timeline_metrics(spark, folder):
    """The live metrics of every hour of a month and three companies."""
    return timelines.live_metrics(spark, hospital_tables(spark, folder), JULY, [1, 2, 3])


@_bound
def timeline_alerts(spark, folder):
    """Alerts of every hour of a month and three companies."""
    table = timelines.live_metrics(spark, hospital_tables(spark, folder), JULY, [1, 2, 3])
    return alerts.threshold_alerts(table, alerts.threshold_rules(spark))


# Catalog queries answered from daily counts that are stored and read back.

def _from_rollup(key):
    def build(spark, folder):
        tables, out = hospital_tables(spark, folder), shared_folder(spark, "rollups")
        rollups.store(tables, out, [rollups.ANSWERS[key][0]])
        return rollups.answer(spark, out, key, tables, HOSPITAL_AS_OF)

    build.__name__ = f"rollup_{key}"
    return build


for _key in rollups.ANSWERS:
    _bound(_from_rollup(_key))


@_bound
def prescription_pages(spark, folder):
    """The first three pages of the prescribed items, each from where the one before ended."""
    tables, key, rows = hospital_tables(spark, folder), None, []
    for page in range(3):
        found, key = prescribed_items_page(tables, 40, key)
        rows += [(page, *r) for r in found]
    return spark.createDataFrame(rows, "page int, data_prescricao string, cd_pre_med long, cd_itpre_med long, medicamento string, medico string")


# Streams: replays of the event file, written below the shared folder and read back.

def _event_stream(spark, folder):
    schema = driver_table(spark, folder, "events").schema
    stream = jobs.read_stream(spark, folder, schema, "events.parquet")
    step = F.create_map(*[F.lit(x) for pair in STEP_OF_EVENT.items() for x in pair])[F.col("event_type")]
    return stream.withColumn("step", step)


def _replayed(spark, stream, write):
    path = shared_folder(spark, "stream")
    query = write(stream, f"{path}/out", f"{path}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")


@_bound
def stream_hourly_arrivals(spark, folder):
    tickets = _event_stream(spark, folder)
    return _replayed(
        spark, jobs.stream_hourly_arrivals(tickets, "ts", where=F.col("step") == 1), jobs.write_appends
    )


def _visit_stream(spark, folder):
    """Events with the visit of a user and a calendar day, as the batch queries have it."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return _event_stream(spark, folder).withColumn("visit", F.col("user_id") * 1000 + day)


def _overnight_stream(spark, folder):
    """Events with the visit of a user and a day from 18:00 to 18:00, so that visits cross midnight."""
    day = F.datediff(F.to_date(F.expr("ts + interval 6 hours")), F.lit("2024-01-01").cast("date"))
    return _event_stream(spark, folder).withColumn("visit", F.col("user_id") * 1000 + day)


def _followed(spark, *signals, hours=24):
    path = shared_folder(spark, "stream")
    live.follow_visits(live.merged(*signals), ["visit"], f"{path}/out", f"{path}/checkpoint", hours).awaitTermination()
    return live.visit_states(spark, f"{path}/out")


def _steps(stream, at):
    return live.steps(stream, [F.col("visit")], "step", "ts", at, F.col("step") > at, arriving=True)


@_bound
def stream_step_wait(spark, folder):
    """Waits from instants that are final day by day."""
    instants = jobs.stream_step_instants(_visit_stream(spark, folder), [F.col("visit")], "step", "ts", 1, 11, window="1 day")
    return jobs.stream_step_wait(_replayed(spark, instants, jobs.write_appends), ["visit"], fold_hours=False)


@_bound
def stream_step_wait_overnight(spark, folder):
    """Waits of visits that cross midnight, from instants that are final hour by hour, for visits that arrived since ``VISITS_SINCE``."""
    instants = jobs.stream_step_instants(_overnight_stream(spark, folder), [F.col("visit")], "step", "ts", 1, 11)
    done = _replayed(spark, instants, partial(jobs.write_appends, by=["day"]))
    arrived = done.groupBy("visit").agg(F.min("instant").alias("arrival"))
    return jobs.stream_step_wait(done, ["visit"], False, arrived, VISITS_SINCE)


@_bound
def stream_stalled_visits(spark, folder):
    states = _followed(spark, _steps(_visit_stream(spark, folder), 12), hours=8 * 24)
    return live.stalled_visits(states, VISITS_SINCE)


@_bound
def stream_stalled_overnight(spark, folder):
    """Visits of the last 24 hours that stalled, from state that is kept for 24 hours; they cross midnight."""
    states = _followed(spark, _steps(_overnight_stream(spark, folder), 12))
    return live.stalled_visits(states, days_before(EVENTS_AS_OF, 1))


@_bound
def stream_stalled_with_pending(spark, folder):
    """Visits that stalled with a pending order, orders from a stream of their own."""
    orders = _overnight_stream(spark, folder).where("event_type = 'view' and value > 20")
    signals = _steps(_overnight_stream(spark, folder), 22), live.pending_orders(orders, [F.col("visit")], "ts")
    return live.stalled_visits(_followed(spark, *signals, hours=8 * 24), VISITS_SINCE, pending=True)


@_bound
def stream_latest_visits(spark, folder):
    """The state of the visits of the last 24 hours."""
    states = _followed(spark, _steps(_overnight_stream(spark, folder), 12))
    return states.where(F.col("arrival") >= ntz(days_before(EVENTS_AS_OF, 1))).select("visit", "arrival", "reached", "passed")


@_bound
def stream_threshold_alerts(spark, folder):
    """Queue alerts from a stream of daily totals per user."""
    timed = _event_stream(spark, folder).withColumn("event_time", F.col("ts").cast("timestamp"))
    daily = (
        timed.withWatermark("event_time", "1 hour")
        .groupBy(F.window("event_time", "1 day").alias("day"), "user_id")
        .agg(F.sum("value").alias("value"))
    )
    figures = daily.select(
        F.window_time("day").alias("event_time"),
        F.col("day.start").cast("timestamp_ntz").alias("as_of"), F.col("user_id").alias("unit_id"),
        F.lit("Enfermagem").alias("area"), F.lit("fila_total").alias("metric"), "value",
    )
    raised = jobs.stream_threshold_alerts(figures, alerts.threshold_rules(spark))
    return _replayed(spark, raised, jobs.write_appends).select("unit_id", "area", "titulo")

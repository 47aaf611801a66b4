"""The catalog: 34 named queries in six areas over the hospital tables.

Every query is a function of (tables, as_of) and returns a lazy DataFrame.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from wardlight import fixed
from wardlight.functions.dates import day_so_far, day_start, days_before, month_start, shift_months
from wardlight.functions.text import label_of
from wardlight.operators import aging as ageing
from wardlight.operators import counting, encounters, pharmacy, queues, stays, waits

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Query:
    """A named query; one that lists ``detail`` gives a row per fact and is not stored whole by a run."""

    area: str
    key: str
    build: Callable[[Tables, datetime], DataFrame]
    detail: bool = False


_REGISTRY: dict[str, Query] = {}


def _query(area: str, key: str, detail: bool = False):
    def register(build: Callable[[Tables, datetime], DataFrame]):
        _REGISTRY[key + "@" + area] = Query(area, key, build, detail)
        return build

    return register


def catalog() -> list[Query]:
    """All queries in area order, then in the order of definition."""
    return sorted(_REGISTRY.values(), key=lambda q: fixed.AREAS.index(q.area))


def find(key: str) -> Query:
    return next(q for q in _REGISTRY.values() if q.key == key)


BOARD, NURSING, ICU, SURGERY, PHARMACY, SHARED = fixed.AREAS


# Facts that several queries look at, or one looks at from several sides, by name.  A run of the catalog
# has them among its tables (``runs.RunTables``): each is made once and stored, so a history is shuffled
# once, and what is small is known to be small.  Without them a query starts from the source tables.
FACTS: dict[str, Callable[[Tables, datetime], DataFrame]] = {}


def _fact(name: str):
    def register(make: Callable[[Tables, datetime], DataFrame]):
        FACTS[name] = make
        return make

    return register


def _inpatients() -> Column:
    """Root encounters of the inpatient company and type."""
    return (F.col("cd_multi_empresa") == 1) & F.col("cd_atendimento_pai").isNull() & (F.col("tp_atendimento") == "I")


# Encounters per month and type.

def _evolution(kind: str, company: int):
    def build(tables: Tables, as_of: datetime, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
        where = (
            (F.col("cd_multi_empresa") == company)
            & F.col("cd_atendimento_pai").isNull()
            & (F.col("tp_atendimento") == kind)
        )
        return counting.monthly_evolution(
            tables["atendime"], "dt_atendimento", "tp_atendimento", fixed.ENCOUNTER_TYPES, where, year_from, year_to, as_of
        )

    return build


evolution_inpatient = _query(BOARD, "evolucao_atendimentos_internacao")(_evolution("I", 1))
evolution_external = _query(BOARD, "evolucao_atendimentos_externos")(_evolution("E", 1))
evolution_outpatient = _query(BOARD, "evolucao_atendimentos_ambulatorio")(_evolution("A", 1))
evolution_emergency = _query(NURSING, "evolucao_atendimentos_urgencia")(_evolution("U", 2))


@_query(BOARD, "internacao_e_altas")
def admissions_and_discharges(tables: Tables, as_of: datetime) -> DataFrame:
    expected = day_so_far(F.col("dt_prevista_alta"), as_of)
    conditions = [
        day_so_far(F.col("dt_atendimento"), as_of),
        day_so_far(F.col("dt_alta"), as_of),
        day_so_far(F.col("dt_alta_medica"), as_of),
        expected,
        expected & F.col("dt_alta").isNull(),
    ]
    return counting.period_indicators(tables["atendime"], list(zip(fixed.INDICATORS, conditions)), _inpatients())


@_query(BOARD, "obitos_mes")
def deaths_per_month(tables: Tables, as_of: datetime) -> DataFrame:
    return counting.monthly_count(
        tables["atendime"], "dt_alta", where=F.col("sn_obito") == "S",
        since=shift_months(day_start(as_of), -12), month="mes_ano", count="qtd_obitos",
    ).orderBy("mes_ano")


# Queues.

@_fact("recent_visits")
def recent_visits(tables: Tables, as_of: datetime) -> DataFrame:
    """Triage visits of the last 24 hours; those of the day are among them."""
    return counting.in_span(tables["triagem_atendimento"], "dh_pre_atendimento", days_before(as_of, 1))


def _visits(tables: Tables) -> DataFrame:
    return tables["recent_visits" if "recent_visits" in tables else "triagem_atendimento"]


def _stalled(at: int, later: Callable[[Column], Column], count: str, pending: bool = False):
    def build(tables: Tables, as_of: datetime) -> DataFrame:
        require = None
        if pending:
            require = tables["sacr_pendencia_sala"].filter("tp_situacao = 'INI' and tp_pedido = 'MED'")
        step = "cd_tipo_tempo_processo"
        return queues.stalled_at_step(
            _visits(tables), tables["sacr_tempo_processo"], "cd_triagem_atendimento", step, at,
            later(F.col(step)), days_before(as_of, 1), "dh_pre_atendimento", require, count,
        )

    return build


reception_queue = _query(NURSING, "fila_recepcao")(
    _stalled(fixed.STEP_CLASSIFICATION_OUT, lambda s: s > fixed.STEP_CLASSIFICATION_OUT, "qtde_pacientes_fila")
)


@_query(NURSING, "fila_triagem")
def triage_queue(tables: Tables, as_of: datetime) -> DataFrame:
    return queues.single_event_queue(
        _visits(tables), tables["sacr_tempo_processo"], "cd_triagem_atendimento", as_of,
        "dh_pre_atendimento",
        (F.col("cd_multi_empresa") == 2) & F.col("cd_fila_senha").isin(fixed.TRIAGE_QUEUES),
    )


doctor_queue = _query(NURSING, "fila_atendimento_medico")(
    _stalled(fixed.STEP_REGISTRATION_END, lambda s: s > fixed.STEP_REGISTRATION_END, "qtde_pacientes_fila_consulta")
)
medication_queue = _query(NURSING, "fila_medicacao")(
    _stalled(fixed.STEP_CARE_END, lambda s: s >= fixed.STEP_AFTER_MEDICATION, "qtde_pacientes_fila_med", pending=True)
)


# Waits.

def _wait(from_step: int, to_step: int, fold: bool, known_steps: bool, closed: bool = False):
    def build(tables: Tables, as_of: datetime) -> DataFrame:
        return waits.step_wait(
            _visits(tables), tables["sacr_tempo_processo"], "cd_triagem_atendimento",
            "cd_tipo_tempo_processo", "dh_processo", from_step, to_step, "dh_pre_atendimento",
            days_before(as_of, 1), as_of if closed else None,
            tables["sacr_tipo_tempo_processo"] if known_steps else None, fold,
        )

    return build


wait_classification = _query(NURSING, "media_espera_classificacao")(
    _wait(fixed.STEP_TICKET, fixed.STEP_CLASSIFICATION_IN, fold=True, known_steps=False)
)
wait_doctor = _query(NURSING, "media_espera_atendimento_medico")(
    _wait(fixed.STEP_REGISTRATION_END, fixed.STEP_INTAKE_START, fold=False, known_steps=True, closed=True)
)
wait_registration = _query(NURSING, "media_espera_cadastro")(
    _wait(fixed.STEP_CLASSIFICATION_OUT, fixed.STEP_REGISTRATION_START, fold=True, known_steps=True)
)


@_query(NURSING, "qtd_pacientes_retorno_7_dias")
def returners(tables: Tables, as_of: datetime) -> DataFrame:
    return queues.frequent_returners(
        tables["atendime"], "cd_paciente", "cd_atendimento", "dt_atendimento", as_of, 7, 2, _emergency(),
        "pacientes_reconsultadores",
    )


def _emergency() -> Column:
    return (F.col("tp_atendimento") == "U") & (F.col("cd_multi_empresa") == 2)


def _month(as_of: datetime) -> tuple[datetime, datetime]:
    return month_start(as_of), shift_months(month_start(as_of), 1)


@_fact("sheet_encounters")
def sheet_encounters(tables: Tables, as_of: datetime) -> DataFrame:
    """The encounters of the month's sheet."""
    start, end = _month(as_of)
    return counting.in_span(tables["atendime"], "hr_atendimento", start, end).filter(_emergency())


def _of_sheet(name: str):
    def make(tables: Tables, as_of: datetime) -> DataFrame:
        rows = counting.months_in_span(tables[name], "hr_atendimento", *_month(as_of))
        return rows.join(tables["sheet_encounters"].select("cd_atendimento"), "cd_atendimento", "left_semi")

    return make


# The tables of the sheet that are cut to its encounters, and what holds their rows in a run.
_SHEET = {"atendime": "sheet_encounters", "pre_med": "sheet_prescriptions", "coleta_sinal_vital": "sheet_readings"}
for _name in ("pre_med", "coleta_sinal_vital"):
    _fact(_SHEET[_name])(_of_sheet(_name))


@_query(NURSING, "retorno")
def encounter_sheet(tables: Tables, as_of: datetime) -> DataFrame:
    own = {name: tables[fact] for name, fact in _SHEET.items() if fact in tables}
    return encounters.encounter_summary(ChainMap(own, tables), month_start(as_of), _emergency())


# Beds and stays.

@_query(ICU, "internados")
def admitted_today(tables: Tables, as_of: datetime) -> DataFrame:
    return counting.count_in_period(tables["atendime"], "dt_atendimento", day_start(as_of), as_of, _inpatients())


@_query(ICU, "leito_uti")
def icu_beds(tables: Tables, as_of: datetime) -> DataFrame:
    return stays.occupied_beds(
        tables["leito"], tables["unid_int"], "UTI 1",
        where=F.col("dt_desativacao").isNull() & (F.col("tp_ocupacao") == "O"),
        units_where=F.col("sn_ativo") == "S", count="leitos_ocupados_uti",
    )


@_query(ICU, "tmp_por_setor")
def mean_stay(tables: Tables, as_of: datetime) -> DataFrame:
    left = counting.in_span(tables["atendime"], "dt_alta", days_before(day_start(as_of), 30))
    where = F.col("tp_atendimento") == "I"
    per_bed = waits.duration_totals(left, ["cd_leito"], "dt_atendimento", "dt_alta", where)
    wards = tables["unid_int"].filter("sn_ativo = 'S'").select("cd_unid_int", F.col("ds_unid_int").alias("setor"))
    per_ward = waits.duration_totals_by(per_bed, tables["leito"], "cd_leito", "cd_unid_int")
    return waits.mean_days(waits.duration_totals_by(per_ward, wards, "cd_unid_int", "setor"), "setor")


@_query(ICU, "obitos_faixa_etaria_cid")
def deaths_by_age(tables: Tables, as_of: datetime) -> DataFrame:
    deaths = tables["atendime"].filter("sn_obito = 'S' and dt_alta is not null")
    rows = (
        deaths.select("cd_atendimento", "cd_paciente", "dt_alta")
        .join(tables["paciente"].select("cd_paciente", "dt_nascimento"), "cd_paciente")
        .join(tables["diagnostico_atendime"].select("cd_atendimento", "cd_cid"), "cd_atendimento")
    )
    counted = stays.count_by_age_band(
        rows, "dt_nascimento", "dt_alta", fixed.AGE_BANDS, fixed.LAST_AGE_BAND, ["cd_cid"],
        band="faixa_etaria", count="qtd_obitos",
    )
    names = tables["cid"].select("cd_cid", F.col("ds_cid").alias("nome_cid"))
    return counting.counts_by_name(
        counted, names, "cd_cid", ["cd_cid", "nome_cid"], ["faixa_etaria"], "qtd_obitos"
    )


# Surgery.

@_query(SURGERY, "cirurgias_status_mes")
def surgery_status(tables: Tables, as_of: datetime) -> DataFrame:
    return counting.monthly_count(
        tables["aviso_cirurgia"], "dt_aviso_cirurgia", ["tp_situacao"],
        where=F.col("dt_aviso_cirurgia").isNotNull(),
    ).orderBy(F.asc_nulls_last("mes"), F.asc_nulls_last("tp_situacao"))


@_fact("performed")
def performed_procedures(tables: Tables, as_of: datetime) -> DataFrame:
    """Performed surgery notices of all times with their procedures."""
    return _joined_procedures(tables).select(
        "cd_aviso_cirurgia", "cd_cirurgia_aviso", "cd_cirurgia", "cd_multi_empresa", "dt_realizacao", "dt_inicio_cirurgia",
        "dt_fim_cirurgia")


def _performed(tables: Tables, *conditions: Column, since: datetime | None = None) -> DataFrame:
    """Performed surgery notices with their procedures."""
    if "performed" in tables:
        return counting.kept(counting.in_span(tables["performed"], "dt_realizacao", since), *conditions)
    return _joined_procedures(tables, *conditions, since=since)


def _joined_procedures(tables: Tables, *conditions: Column, since: datetime | None = None) -> DataFrame:
    notices = counting.in_span(tables["aviso_cirurgia"], "dt_realizacao", since)
    notices = counting.kept(notices, F.col("tp_situacao") == "R", *conditions)
    return notices.join(counting.children_in_span(tables["cirurgia_aviso"], "dt_realizacao", since), "cd_aviso_cirurgia")


@_query(SURGERY, "cirurgias_realizadas_por_tipo")
def surgeries_by_type(tables: Tables, as_of: datetime) -> DataFrame:
    rows = _performed(tables, F.col("dt_realizacao").isNotNull())
    counted = counting.monthly_count(rows, "dt_realizacao", ["cd_cirurgia"])
    names = tables["cirurgia"].select("cd_cirurgia", F.col("ds_cirurgia").alias("tipo_cirurgia"))
    named = counting.counts_by_name(counted, names, "cd_cirurgia", "tipo_cirurgia", ["mes"])
    return named.orderBy(F.asc_nulls_last("mes"), F.desc_nulls_first("qtde"))


# Pharmacy.

# Items that were not cancelled.
GIVEN = "coalesce(sn_cancelado, 'N') = 'N'"


def _since_a_year(as_of: datetime) -> datetime:
    return shift_months(day_start(as_of), -12)


@_fact("given_items")
def given_items(tables: Tables, as_of: datetime) -> DataFrame:
    """Items of the last twelve months that were not cancelled; no query asks for older ones."""
    return _joined_items(tables, _since_a_year(as_of)).select("cd_atendimento", "cd_prestador", "dt_pre_med", "cd_produto", "ds_itpre_med")


def _items(tables: Tables, since: datetime, company: int | None = None) -> DataFrame:
    """Items that were not cancelled, with their prescription's date, doctor and encounter.

    Items that are stored by their prescription's months are read from the month of ``since`` on.
    Prescriptions are cut to the encounters of a company before the far more
    numerous items are joined.
    """
    if "given_items" not in tables:
        return _joined_items(tables, since, company)
    items = counting.in_span(tables["given_items"], "dt_pre_med", since)
    return items if company is None else items.join(_of_company(tables, company), "cd_atendimento")


def _of_company(tables: Tables, company: int) -> DataFrame:
    return tables["atendime"].filter(F.col("cd_multi_empresa") == company).select("cd_atendimento")


def _joined_items(tables: Tables, since: datetime, company: int | None = None) -> DataFrame:
    orders = counting.in_span(tables["pre_med"], "dt_pre_med", since)
    if company is not None:
        orders = orders.join(_of_company(tables, company), "cd_atendimento")
    items = counting.children_in_span(tables["itpre_med"], "dt_pre_med", since)
    return items.filter(GIVEN).join(orders, "cd_pre_med")


@_query(PHARMACY, "medicamentos_alto_risco")
def items_per_product_month(tables: Tables, as_of: datetime) -> DataFrame:
    rows = _items(tables, shift_months(month_start(as_of), -11))
    counted = counting.monthly_count(rows, "dt_pre_med", ["cd_produto"])
    named = counting.counts_by_name(counted, tables["produto"], "cd_produto", "ds_produto", ["mes"])
    return named.orderBy(F.asc_nulls_last("mes"), F.desc_nulls_first("qtde"))


def _top_20(company: int):
    def build(tables: Tables, as_of: datetime) -> DataFrame:
        rows = _items(tables, _since_a_year(as_of), company)
        names = tables["produto"].select("cd_produto", F.col("ds_produto").alias("medicamento"))
        return pharmacy.top_k_by_count(
            rows, "cd_produto", 20, text="ds_itpre_med", exclude_prefixes=fixed.CONDITIONAL_PREFIXES,
            lookup=names, name="medicamento", count="qtde_prescricoes",
        )

    return build


top_products_emergency = _query(PHARMACY, "top_20_medicamentos_ps")(_top_20(2))
top_products_inpatient = _query(PHARMACY, "top_20_medicamentos_sc")(_top_20(1))


@_query(PHARMACY, "antibioticos_vs_analgesicos")
def drug_classes(tables: Tables, as_of: datetime) -> DataFrame:
    return pharmacy.keyword_class_monthly(
        _items(tables, _since_a_year(as_of)), "dt_pre_med", "cd_produto", tables["produto"],
        "ds_produto", fixed.DRUG_CLASSES, fixed.OTHER_DRUGS,
    )


# Shared operations.

@_query(SHARED, "tempo_medio_por_tipo_cirurgia")
def surgery_duration(tables: Tables, as_of: datetime) -> DataFrame:
    rows = _performed(tables, F.col("dt_inicio_cirurgia").isNotNull(), F.col("dt_fim_cirurgia").isNotNull())
    totals = waits.duration_totals(rows, ["cd_cirurgia"], "dt_inicio_cirurgia", "dt_fim_cirurgia")
    names = tables["cirurgia"].select("cd_cirurgia", F.col("ds_cirurgia").alias("tipo_cirurgia"))
    return waits.mean_duration_hm(
        waits.duration_totals_by(totals, names, "cd_cirurgia", "tipo_cirurgia"), "tipo_cirurgia"
    )


@_query(SHARED, "cirurgias_realizadas_por_porte_12m")
def surgeries_by_size(tables: Tables, as_of: datetime) -> DataFrame:
    since = shift_months(month_start(as_of), -12)
    rows = _performed(tables, F.col("cd_multi_empresa") == 1, since=since)
    counted = counting.monthly_count(rows, "dt_realizacao", ["cd_cirurgia"], fmt="MM/yyyy", month="mesano")
    sized = counting.counts_by_name(counted, tables["cirurgia"], "cd_cirurgia", "tp_cirurgia", ["mesano"])
    labelled = sized.select("mesano", label_of(F.col("tp_cirurgia"), fixed.SURGERY_SIZES).alias("porte"), "qtde")
    return labelled.orderBy(F.substring("mesano", 4, 4), F.substring("mesano", 1, 2), F.asc_nulls_last("porte"))


@_query(SHARED, "cirurgias_realizadas_por_medico")
def surgeries_by_doctor(tables: Tables, as_of: datetime) -> DataFrame:
    leads = tables["prestador_aviso"].filter("sn_principal = 'S'")
    rows = _performed(tables, F.col("cd_multi_empresa") == 1).join(leads, ["cd_aviso_cirurgia", "cd_cirurgia_aviso"])
    counted = counting.monthly_count(rows, "dt_realizacao", ["cd_prestador"])
    names = tables["prestador"].select("cd_prestador", F.col("nm_prestador").alias("medico"))
    named = counting.counts_by_name(counted, names, "cd_prestador", "medico", ["mes"])
    return named.orderBy(F.asc_nulls_last("mes"), F.desc_nulls_first("qtde"))


def _open_orders(bucket: str):
    def build(tables: Tables, as_of: datetime) -> DataFrame:
        where = (F.col("cd_oficina") == 5) & F.col("tp_situacao").isin("A", "S")
        columns = {
            "cd_os": F.col("cd_os"),
            "tp_situacao": F.col("tp_situacao"),
            "dt_pedido": F.col("dt_pedido"),
            "descricao_os": F.coalesce("ds_servico_geral", "ds_servico"),
            "nm_solicitante": F.col("nm_solicitante"),
        }
        aged = ageing.aging(tables["solicitacao_os"], "dt_pedido", as_of, where, columns, only=bucket)
        return aged.select("cd_os", "tp_situacao", "dt_pedido", "horas_em_aberto", "descricao_os", "nm_solicitante")

    return build


orders_to_12h = _query(SHARED, "os_manutencao_aberta_ate_12h")(_open_orders("ate_12h"))
orders_12_24h = _query(SHARED, "os_manutencao_aberta_12_24h")(_open_orders("12_24h"))
orders_over_24h = _query(SHARED, "os_manutencao_aberta_mais_24h")(_open_orders("mais_24h"))


def _detail(operator, tables: Tables, **more):
    return operator(
        tables["itpre_med"], tables["pre_med"], tables["produto"], tables["prestador"],
        "cd_pre_med", "cd_produto", "cd_prestador", "cd_itpre_med", "dt_pre_med", "ds_produto", "nm_prestador",
        "ds_itpre_med", fixed.CONDITIONAL_PREFIXES, F.expr(GIVEN), **more,
    )


@_query(SHARED, "medicacao_administrada", detail=True)
def prescribed_items(tables: Tables, as_of: datetime) -> DataFrame:
    return _detail(pharmacy.prescription_detail, tables)


def prescribed_items_page(
    tables: Tables, size: int = 1000, after: pharmacy.PageKey | None = None,
) -> tuple[list[Row], pharmacy.PageKey | None]:
    """``medicacao_administrada`` page by page (``pharmacy.prescription_page``)."""
    return _detail(pharmacy.prescription_page, tables, size=size, after=after)


@_query(SHARED, "medicamentos_prescritos_por_medico")
def items_per_prescriber(tables: Tables, as_of: datetime) -> DataFrame:
    rows = _items(tables, _since_a_year(as_of))
    counted = counting.count_by_entity(
        rows, "cd_prestador", where=F.col("cd_produto").isNotNull(), count="qtde_medicamentos"
    )
    names = tables["prestador"].select("cd_prestador", F.col("nm_prestador").alias("medico"))
    return counting.counts_by_name(counted, names, "cd_prestador", "medico", count="qtde_medicamentos")


@_query(SHARED, "atendimento_por_horario")
def arrivals_by_hour(tables: Tables, as_of: datetime) -> DataFrame:
    return counting.hourly_arrivals(
        _visits(tables), tables["sacr_tempo_processo"], "cd_triagem_atendimento",
        "dh_pre_atendimento", as_of, "cd_tipo_tempo_processo", fixed.STEP_TICKET, F.col("cd_multi_empresa") == 2,
    )

"""Daily counts of the facts, kept by month, from which the monthly catalog queries are answered.

A rollup has a row per day and combination of codes with the number of facts.
Counts of parts add up to counts of the whole, so a query over any days needs the
rollup and the name tables, not the facts.  Names are looked up when a query is
answered, so a renamed product needs no refresh.

``refresh`` reads only the months that changed: it compares the data files of each
month's folder (names and times) with those of the last refresh, counts the changed
months again, and puts them in the place of the old ones in one step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import fixed
from wardlight.functions.dates import day_start, month_column, month_start, shift_months
from wardlight.functions.text import label_of
from wardlight.operators import counting, pharmacy
from wardlight.plans.catalog import GIVEN
from wardlight.sources.tables import read_parquet_tables
from wardlight.sources.versions import PART, read_parts, replace_parts

Tables = Mapping[str, DataFrame]
NO_MONTH = "none"  # the part of facts without a date
COUNT = "n"


@dataclass(frozen=True)
class Rollup:
    """Counts of ``facts`` by day of ``ts`` and ``dims``; ``children`` are stored by the same months."""

    name: str
    facts: str
    ts: str
    dims: tuple[str, ...]
    rows: Callable[[Tables], DataFrame]
    children: tuple[str, ...] = ()

    def counted(self, tables: Tables, months: Iterable[str] | None = None) -> DataFrame:
        """The rollup with ``part``, its month; of all months or of some."""
        if months is not None:
            wanted = list(months)
            tables = {**tables, **{t: _of_months(tables[t], self.ts, wanted) for t in (self.facts, *self.children)}}
        rows = self.rows(tables)
        day = F.date_trunc("DAY", self.ts).cast("timestamp_ntz").alias(self.ts)
        counted = rows.groupBy(day, *self.dims).agg(F.count(F.lit(1)).alias(COUNT))
        return counted.withColumn(PART, _month(self.ts))


def _month(ts: str) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit(NO_MONTH))


def _of_months(df: DataFrame, ts: str, months: list[str]) -> DataFrame:
    """Rows of some months, by the partition column where the table has it and by the date where it has that."""
    column = month_column(ts)
    if column in df.columns:
        df = df.where(F.coalesce(F.col(column), F.lit(NO_MONTH)).isin(months) if NO_MONTH in months else F.col(column).isin(months)).drop(column)
    return df.where(_month(ts).isin(months)) if ts in df.columns else df


def _procedures(tables: Tables) -> DataFrame:
    done = tables["aviso_cirurgia"].where("tp_situacao = 'R'").select("cd_aviso_cirurgia", "dt_realizacao", "cd_multi_empresa")
    return done.join(tables["cirurgia_aviso"].select("cd_aviso_cirurgia", "cd_cirurgia_aviso", "cd_cirurgia"), "cd_aviso_cirurgia")


def _leads(tables: Tables) -> DataFrame:
    leads = tables["prestador_aviso"].where("sn_principal = 'S'").select("cd_aviso_cirurgia", "cd_cirurgia_aviso", "cd_prestador")
    return _procedures(tables).join(leads, ["cd_aviso_cirurgia", "cd_cirurgia_aviso"])


def _given(tables: Tables) -> DataFrame:
    orders = tables["pre_med"].select("cd_pre_med", "cd_prestador", "dt_pre_med")
    return tables["itpre_med"].where(GIVEN).select("cd_pre_med", "cd_produto").join(orders, "cd_pre_med")


ROLLUPS = {r.name: r for r in [
    Rollup(
        "encounters", "atendime", "dt_atendimento", ("tp_atendimento", "cd_multi_empresa", "root"),
        lambda t: t["atendime"].withColumn("root", F.col("cd_atendimento_pai").isNull()),
    ),
    Rollup("discharges", "atendime", "dt_alta", ("sn_obito",), lambda t: t["atendime"].where("dt_alta is not null")),
    Rollup("notices", "aviso_cirurgia", "dt_aviso_cirurgia", ("tp_situacao",), lambda t: t["aviso_cirurgia"]),
    Rollup("procedures", "aviso_cirurgia", "dt_realizacao", ("cd_cirurgia", "cd_multi_empresa"), _procedures, ("cirurgia_aviso",)),
    Rollup("leads", "aviso_cirurgia", "dt_realizacao", ("cd_prestador", "cd_multi_empresa"), _leads, ("cirurgia_aviso", "prestador_aviso")),
    Rollup("products", "pre_med", "dt_pre_med", ("cd_produto",), _given, ("itpre_med",)),
    Rollup("prescribers", "pre_med", "dt_pre_med", ("cd_prestador",), lambda t: _given(t).where("cd_produto is not null"), ("itpre_med",)),
]}


# Keeping them.

def store(tables: Tables, out: str, names: Iterable[str] = tuple(ROLLUPS)) -> None:
    """Count all months of the named rollups afresh."""
    for name in names:
        replace_parts({"rows": ROLLUPS[name].counted(tables)}, f"{out}/{name}")


def file_marks(spark: SparkSession, folder: str, rollup: Rollup) -> DataFrame:
    """(part, mark): what tells that the files of a month changed, for tables stored by the rollup's months."""
    marks = None
    for table in (rollup.facts, *rollup.children):
        files = spark.read.parquet(f"{folder.rstrip('/')}/{table}").select(
            F.coalesce(F.col(month_column(rollup.ts)).cast("string"), F.lit(NO_MONTH)).alias(PART),
            F.concat_ws(" ", "_metadata.file_name", "_metadata.file_size", "_metadata.file_modification_time").alias("file"),
        ).groupBy(PART, "file").agg(F.count(F.lit(1)).alias("n"))
        # few files a month: their hashes added up, in any order
        found = files.groupBy(PART).agg(F.sum(F.xxhash64("file", "n").cast("decimal(38,0)")).alias("sum"), F.count(F.lit(1)).alias("n"))
        found = found.select(PART, F.concat_ws(" ", F.lit(table), "sum", "n").alias("mark"))
        marks = found if marks is None else marks.unionByName(found)
    return marks.groupBy(PART).agg(F.array_join(F.array_sort(F.collect_list("mark")), ";").alias("mark"))  # one per table


def refresh(spark: SparkSession, folder: str, out: str, names: Iterable[str] = tuple(ROLLUPS)) -> dict[str, list[str]]:
    """Bring the named rollups in ``out`` up to the tables in ``folder`` (``ingest_table``); gives the months that were read."""
    done = {}
    for name in names:
        rollup, path = ROLLUPS[name], f"{out}/{name}"
        now = file_marks(spark, folder, rollup)
        try:
            before = read_parts(spark, path, "marks")
        except FileNotFoundError:
            before = spark.createDataFrame([], now.schema)
        before = before.select(PART, F.col("mark").alias("old"))
        changed = now.join(before, PART, "full").where(~F.col("mark").eqNullSafe(F.col("old")))
        found = {r[0]: r[1] for r in changed.select(PART, "mark").collect()}  # a row per changed month
        if found:
            tables = read_parquet_tables(spark, folder, sorted({rollup.facts, *rollup.children}))
            marks = spark.createDataFrame([(p, m) for p, m in found.items() if m is not None], f"{PART} string, mark string")
            replace_parts({"rows": rollup.counted(tables, found), "marks": marks}, path, sorted(found))
        done[name] = sorted(found)
    return done


def read_rollup(spark: SparkSession, out: str, name: str, since: datetime | None = None) -> DataFrame:
    """A rollup's rows; with ``since`` only the months from that on are read."""
    first = None if since is None else f"{since:%Y-%m}"
    rows = read_parts(spark, f"{out}/{name}", "rows", first, None if since is None else "9999-12")
    return rows.drop(PART)


# The catalog queries over them.  Each takes (read, names, as_of): ``read(name, since)``
# gives a rollup, ``names`` are the name tables.

Read = Callable[[str, datetime | None], DataFrame]


def _evolution(kind: str, company: int):
    def answer(read: Read, names: Tables, as_of: datetime) -> DataFrame:
        where = (F.col("cd_multi_empresa") == company) & F.col("root") & (F.col("tp_atendimento") == kind)
        return counting.monthly_evolution(
            read("encounters", datetime(as_of.year, 1, 1)), "dt_atendimento", "tp_atendimento", fixed.ENCOUNTER_TYPES, where, as_of=as_of,
            weight=COUNT,
        )

    return answer


def _deaths(read: Read, names: Tables, as_of: datetime) -> DataFrame:
    since = shift_months(day_start(as_of), -12)
    return counting.monthly_count(
        read("discharges", since), "dt_alta", where=F.col("sn_obito") == "S", since=since, month="mes_ano", count="qtd_obitos", weight=COUNT,
    ).orderBy("mes_ano")


def _status(read: Read, names: Tables, as_of: datetime) -> DataFrame:
    dated = F.col("dt_aviso_cirurgia").isNotNull()
    counted = counting.monthly_count(read("notices", None), "dt_aviso_cirurgia", ["tp_situacao"], where=dated, weight=COUNT)
    return counted.orderBy(F.asc_nulls_last("mes"), F.asc_nulls_last("tp_situacao"))


def _surgery_types(read: Read, names: Tables, as_of: datetime) -> DataFrame:
    dated = F.col("dt_realizacao").isNotNull()
    counted = counting.monthly_count(read("procedures", None), "dt_realizacao", ["cd_cirurgia"], where=dated, weight=COUNT)
    kinds = names["cirurgia"].select("cd_cirurgia", F.col("ds_cirurgia").alias("tipo_cirurgia"))
    named = counting.counts_by_name(counted, kinds, "cd_cirurgia", "tipo_cirurgia", ["mes"])
    return named.orderBy(F.asc_nulls_last("mes"), F.desc_nulls_first("qtde"))


def _surgery_sizes(read: Read, names: Tables, as_of: datetime) -> DataFrame:
    since = shift_months(month_start(as_of), -12)
    counted = counting.monthly_count(
        read("procedures", since), "dt_realizacao", ["cd_cirurgia"], where=F.col("cd_multi_empresa") == 1, since=since, fmt="MM/yyyy",
        month="mesano", weight=COUNT,
    )
    sized = counting.counts_by_name(counted, names["cirurgia"], "cd_cirurgia", "tp_cirurgia", ["mesano"])
    labelled = sized.select("mesano", label_of(F.col("tp_cirurgia"), fixed.SURGERY_SIZES).alias("porte"), "qtde")
    return labelled.orderBy(F.substring("mesano", 4, 4), F.substring("mesano", 1, 2), F.asc_nulls_last("porte"))


def _surgeons(read: Read, names: Tables, as_of: datetime) -> DataFrame:
    counted = counting.monthly_count(
        read("leads", None), "dt_realizacao", ["cd_prestador"], where=F.col("cd_multi_empresa") == 1, weight=COUNT)
    doctors = names["prestador"].select("cd_prestador", F.col("nm_prestador").alias("medico"))
    named = counting.counts_by_name(counted, doctors, "cd_prestador", "medico", ["mes"])
    return named.orderBy(F.asc_nulls_last("mes"), F.desc_nulls_first("qtde"))


def _products(read: Read, names: Tables, as_of: datetime) -> DataFrame:
    since = shift_months(month_start(as_of), -11)
    counted = counting.monthly_count(read("products", since), "dt_pre_med", ["cd_produto"], since=since, weight=COUNT)
    named = counting.counts_by_name(counted, names["produto"], "cd_produto", "ds_produto", ["mes"])
    return named.orderBy(F.asc_nulls_last("mes"), F.desc_nulls_first("qtde"))


def _classes(read: Read, names: Tables, as_of: datetime) -> DataFrame:
    since = shift_months(day_start(as_of), -12)
    return pharmacy.keyword_class_monthly(
        read("products", since), "dt_pre_med", "cd_produto", names["produto"], "ds_produto", fixed.DRUG_CLASSES, fixed.OTHER_DRUGS, since,
        weight=COUNT,
    )


def _prescribers(read: Read, names: Tables, as_of: datetime) -> DataFrame:
    since = shift_months(day_start(as_of), -12)
    counted = counting.count_by_entity(
        read("prescribers", since), "cd_prestador", "dt_pre_med", since, count="qtde_medicamentos", weight=COUNT)
    doctors = names["prestador"].select("cd_prestador", F.col("nm_prestador").alias("medico"))
    return counting.counts_by_name(counted, doctors, "cd_prestador", "medico", count="qtde_medicamentos")


# Catalog key: rollup and answer.
ANSWERS = {
    "evolucao_atendimentos_internacao": ("encounters", _evolution("I", 1)),
    "evolucao_atendimentos_externos": ("encounters", _evolution("E", 1)),
    "evolucao_atendimentos_ambulatorio": ("encounters", _evolution("A", 1)),
    "evolucao_atendimentos_urgencia": ("encounters", _evolution("U", 2)),
    "obitos_mes": ("discharges", _deaths),
    "cirurgias_status_mes": ("notices", _status),
    "cirurgias_realizadas_por_tipo": ("procedures", _surgery_types),
    "cirurgias_realizadas_por_porte_12m": ("procedures", _surgery_sizes),
    "cirurgias_realizadas_por_medico": ("leads", _surgeons),
    "medicamentos_alto_risco": ("products", _products),
    "antibioticos_vs_analgesicos": ("products", _classes),
    "medicamentos_prescritos_por_medico": ("prescribers", _prescribers),
}


def answer(spark: SparkSession, out: str, key: str, names: Tables, as_of: datetime) -> DataFrame:
    """A catalog query from the stored rollups and the name tables; the same rows as ``catalog.find(key)``."""
    return ANSWERS[key][1](lambda name, since: read_rollup(spark, out, name, since), names, as_of)

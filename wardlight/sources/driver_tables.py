"""Test tables, as they are and as hospital tables.

``hospital_tables`` derives all 21 source tables from the test tables with
projections (and one aggregate), so the catalog queries can run on any size of
them: orders act as encounters, triage visits, prescriptions and surgery
notices, lines as prescribed items, steps and procedures, customers as patients
and beds, suppliers as doctors, nations as wards, events as readings and work
orders.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Columns of the tables the queries read, so that opening one costs no Spark job.
DDL = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}

# Reference moments inside the test data.
ORDERS_AS_OF = datetime(2001, 8, 1)
EVENTS_AS_OF = datetime(2024, 1, 30, 23, 59, 59)
HOSPITAL_AS_OF = datetime(2001, 7, 31, 18)

# Product nouns of the test tables read as drug names.
DRUG_NAMES = {
    "anvil": "dipirona", "bolt": "cefalexina", "gear": "paracetamol", "gizmo": "soro",
    "plate": "amoxicilina", "ring": "morfina", "rod": "cefalexina dipirona", "widget": "omeprazol",
}


def driver_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read.schema(DDL[name]) if name in DDL else spark.read
    return reader.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def driver_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: driver_table(spark, folder, name) for name in TABLES}


class _Lazy(Mapping):
    """Tables made on first use."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def _arrival():
    """A day of orders becomes two hours of arrivals, spread by price, up to the last order day."""
    return F.expr(
        "timestampadd(SECOND, floor(o_totalprice / 100) - datediff(date'2001-08-01', to_date(o_orderdate)) * 7200, "
        "timestamp_ntz'2001-08-01')"
    )


def _drug():
    text = "p_name"
    for noun, name in DRUG_NAMES.items():
        text = f"replace({text}, '{noun}', '{name}')"
    return F.expr(text)


def _later(ts, seconds):
    return F.timestamp_add("SECOND", seconds.cast("bigint"), ts)


def hospital_tables(spark: SparkSession, folder: str) -> Mapping[str, DataFrame]:
    raw = _Lazy({n: partial(driver_table, spark, folder, n) for n in DDL})
    orders, lines, events = (partial(raw.__getitem__, n) for n in ("orders", "lineitem", "events"))
    customers, parts = (partial(raw.__getitem__, n) for n in ("customer", "part"))
    price, day = F.col("o_totalprice"), F.col("o_orderdate")
    company = F.expr("case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end")
    doctor = F.floor(F.col("o_custkey") / 15)
    severity = F.substring("o_orderpriority", 1, 1)
    left = F.when(price >= 50000, _later(_arrival(), F.floor(price)))
    shift = int((EVENTS_AS_OF - HOSPITAL_AS_OF).total_seconds())
    return _Lazy({
        "atendime": lambda: orders().select(
            F.col("o_orderkey").alias("cd_atendimento"),
            F.expr("case when o_totalprice < 20000 then o_custkey end").alias("cd_atendimento_pai"),
            F.col("o_custkey").alias("cd_paciente"),
            doctor.alias("cd_prestador"),
            severity.alias("cd_cid"),
            F.col("o_custkey").alias("cd_leito"),
            company.alias("cd_multi_empresa"),
            F.expr(
                "case o_orderpriority when '1-URGENT' then 'U' when '2-HIGH' then 'I' when '3-MEDIUM' then 'A' "
                "when '4-NOT SPECIFIED' then 'E' else 'H' end"
            ).alias("tp_atendimento"),
            _arrival().alias("dt_atendimento"),
            _arrival().alias("hr_atendimento"),
            left.alias("dt_alta"),
            _later(left, F.lit(-7200)).alias("dt_alta_medica"),
            _later(_arrival(), F.floor(price / 4)).alias("dt_prevista_alta"),
            F.when(price > 400000, "S").otherwise("N").alias("sn_obito"),
        ),
        "paciente": lambda: customers().select(
            F.col("c_custkey").alias("cd_paciente"),
            F.col("c_name").alias("nm_paciente"),
            F.expr(
                "case when c_mktsegment <> 'FURNITURE' then "
                "timestampadd(DAY, -cast(floor(c_acctbal * 3) as int), timestamp_ntz'2001-01-01') end"
            ).alias("dt_nascimento"),
        ),
        "triagem_atendimento": lambda: orders().select(
            F.col("o_orderkey").alias("cd_triagem_atendimento"),
            F.col("o_orderkey").alias("cd_atendimento"),
            _arrival().alias("dh_pre_atendimento"),
            company.alias("cd_multi_empresa"),
            F.expr(
                "case o_orderpriority when '1-URGENT' then 7 when '2-HIGH' then 20 when '3-MEDIUM' then 21 "
                "when '4-NOT SPECIFIED' then 99 else 26 end"
            ).alias("cd_fila_senha"),
            F.col("o_orderpriority").alias("ds_senha"),
            F.when(price <= 400000, severity.cast("int")).alias("cd_cor_referencia"),
            F.col("o_orderpriority").alias("ds_queixa_principal"),
        ),
        "sacr_tempo_processo": lambda: lines().select(
            F.col("l_orderkey").alias("cd_triagem_atendimento"),
            F.expr(
                "case l_linenumber when 1 then 1 when 2 then 11 when 3 then 12 when 4 then 21 when 5 then 22 "
                "when 6 then 31 else if(l_quantity > 40, 90, 32) end"
            ).alias("cd_tipo_tempo_processo"),
            _later(
                F.expr("timestamp_ntz'2001-07-31'"), F.col("l_linenumber") * 1800 + F.floor(F.col("l_extendedprice") / 10)
            ).alias("dh_processo"),
        ),
        "sacr_tipo_tempo_processo": lambda: raw["nation"].select((F.col("n_nationkey") + 8).alias("cd_tipo_tempo_processo")),
        "sacr_pendencia_sala": lambda: lines().select(
            F.col("l_orderkey").alias("cd_triagem_atendimento"),
            F.when(F.col("l_returnflag") == "R", "INI").otherwise("FIM").alias("tp_situacao"),
            F.when(F.col("l_linestatus") == "O", "MED").otherwise("LAB").alias("tp_pedido"),
        ),
        "coleta_sinal_vital": lambda: events().select(
            F.col("event_id").alias("cd_coleta_sinal_vital"),
            F.floor(F.col("event_id") / 5).alias("cd_atendimento"),
            F.col("ts").alias("data_coleta"),
        ),
        "itcoleta_sinal_vital": lambda: events().select(
            F.col("event_id").alias("cd_coleta_sinal_vital"),
            F.expr(
                "case event_type when 'signup' then 1 when 'view' then 2 when 'click' then 4 when 'purchase' then 5 "
                "else 11 end"
            ).alias("cd_sinal_vital"),
            F.col("value").alias("valor"),
        ),
        "pre_med": lambda: orders().select(
            F.col("o_orderkey").alias("cd_pre_med"),
            F.col("o_orderkey").alias("cd_atendimento"),
            doctor.alias("cd_prestador"),
            day.alias("dt_pre_med"),
        ),
        "itpre_med": lambda: lines().select(
            F.col("l_linenumber").cast("bigint").alias("cd_itpre_med"),
            F.col("l_orderkey").alias("cd_pre_med"),
            F.col("l_partkey").alias("cd_produto"),
            F.expr("case l_returnflag when 'R' then 'S' when 'N' then 'N' end").alias("sn_cancelado"),
            F.expr(
                "case when l_quantity < 5 then 'se dor' when l_quantity < 10 then 'Conforme prescrito' "
                "when l_quantity < 12 then 'EM CASO de dor' when l_quantity < 14 then 'infundir em 1h' "
                "when l_quantity < 30 then 'uso continuo' end"
            ).alias("ds_itpre_med"),
        ),
        "produto": lambda: parts().select(F.col("p_partkey").alias("cd_produto"), _drug().alias("ds_produto")),
        "prestador": lambda: raw["supplier"].select(
            F.col("s_suppkey").alias("cd_prestador"), F.col("s_name").alias("nm_prestador")
        ),
        "cid": lambda: raw["region"].select(
            F.col("r_regionkey").cast("string").alias("cd_cid"), F.col("r_name").alias("ds_cid")
        ),
        "diagnostico_atendime": lambda: orders().select(F.col("o_orderkey").alias("cd_atendimento"), severity.alias("cd_cid")),
        "leito": lambda: customers().select(
            F.col("c_custkey").alias("cd_leito"),
            F.col("c_nationkey").cast("bigint").alias("cd_unid_int"),
            F.expr("case when c_acctbal < 0 then timestamp_ntz'2001-01-01' end").alias("dt_desativacao"),
            F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "O").otherwise("L").alias("tp_ocupacao"),
        ),
        "unid_int": lambda: raw["nation"].select(
            F.col("n_nationkey").cast("bigint").alias("cd_unid_int"),
            F.concat(F.lit("Uti "), F.col("n_nationkey").cast("string")).alias("ds_unid_int"),
            F.when(F.col("n_regionkey") == 0, "N").otherwise("S").alias("sn_ativo"),
        ),
        "aviso_cirurgia": lambda: orders().select(
            F.col("o_orderkey").alias("cd_aviso_cirurgia"),
            F.when(severity <= "3", 1).otherwise(2).alias("cd_multi_empresa"),
            F.expr("case o_orderstatus when 'F' then 'R' when 'O' then 'A' else 'at' end").alias("tp_situacao"),
            day.alias("dt_aviso_cirurgia"),
            F.when(price >= 30000, _later(day, F.lit(86400))).alias("dt_realizacao"),
            _later(day, F.lit(28800)).alias("dt_inicio_cirurgia"),
            F.when(severity < "5", _later(day, 28800 + F.floor(price / 25))).alias("dt_fim_cirurgia"),
        ),
        "cirurgia_aviso": lambda: lines().select(
            F.col("l_linenumber").cast("bigint").alias("cd_cirurgia_aviso"),
            F.col("l_orderkey").alias("cd_aviso_cirurgia"),
            F.col("l_partkey").alias("cd_cirurgia"),
        ),
        "cirurgia": lambda: parts().select(
            F.col("p_partkey").alias("cd_cirurgia"),
            F.col("p_brand").alias("ds_cirurgia"),
            F.expr(
                "case when p_size <= 10 then 'P' when p_size <= 20 then 'M' when p_size <= 30 then 'G' "
                "when p_size <= 40 then 'E' when p_size <= 45 then 'X' else 'Y' end"
            ).alias("tp_cirurgia"),
        ),
        "prestador_aviso": lambda: lines().groupBy(
            F.col("l_orderkey").alias("cd_aviso_cirurgia"),
            F.col("l_linenumber").cast("bigint").alias("cd_cirurgia_aviso"),
        ).agg(F.min("l_suppkey").alias("cd_prestador")).withColumn("sn_principal", F.lit("S")),
        "solicitacao_os": lambda: events().select(
            F.col("event_id").alias("cd_os"),
            F.when(F.col("event_type").isin("error", "click"), 5).otherwise(4).alias("cd_oficina"),
            F.expr("case when value < 20 then 'A' when value < 50 then 'S' else 'F' end").alias("tp_situacao"),
            _later(F.col("ts"), F.lit(-shift)).alias("dt_pedido"),
            F.when(F.col("event_type") == "error", F.col("props")).alias("ds_servico_geral"),
            F.col("event_type").alias("ds_servico"),
            F.concat(F.lit("Requester "), F.col("user_id").cast("string")).alias("nm_solicitante"),
        ),
    })

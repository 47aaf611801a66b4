"""Per-encounter sheets: latest readings, ordered lists, the joined summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.fixed import COLOURS, NO_COLOUR, VITAL_SIGNS
from wardlight.functions.dates import shift_months
from wardlight.functions.text import joined, label_of
from wardlight.operators.counting import children_in_span, in_span, kept


def latest_pivot(
    df: DataFrame, keys: Sequence[str], code: str, value: str, order_ts: str, tie_break: str, codes: Mapping
) -> DataFrame:
    """Per key one column per code with the value of its latest row.

    A row without a timestamp counts as latest, as in a descending sort with
    NULLs first; equal timestamps go to the larger ``tie_break``.  ``max_by``
    keeps one candidate per key and code on the map side, so no key's rows are
    ever gathered or sorted.
    """
    recency = F.struct(F.col(order_ts).isNull(), F.col(order_ts), F.col(tie_break))
    picks = [
        F.max_by(F.when(F.col(code) == c, F.col(value)), F.when(F.col(code) == c, recency)).alias(name)
        for c, name in codes.items()
    ]
    return df.groupBy(*keys).agg(*picks)


def ordered_list(df: DataFrame, key: str, text: str, sep: str = " | ", name: str = "lista") -> DataFrame:
    """Per key all texts in order, repeats included, joined by ``sep``.

    Equal texts of a key are counted before they are gathered, so the gathered
    group holds each text once; missing texts are skipped.
    """
    runs = df.filter(F.col(text).isNotNull()).groupBy(key, text).agg(F.count(F.lit(1)).alias("n"))
    run = F.concat(F.expr(f"repeat(concat({text}, '{sep}'), cast(n - 1 as int))"), F.col(text))
    gathered = runs.withColumn("run", run).groupBy(key).agg(
        F.expr(f"listagg(run, '{sep}') within group (order by {text})").alias(name)
    )
    return gathered.withColumn(name, F.rtrim(F.col(name), F.lit(sep)))


def encounter_summary(
    tables: Mapping[str, DataFrame], month_start: datetime | str, where: Column | None = None, months: int = 1
) -> DataFrame:
    """One row per encounter (and triage visit) of a month: patient, doctor, diagnosis, vitals, drugs.

    Triage visits, vital signs and prescriptions are cut to the chosen encounters
    by semi joins, so the history of other encounters is neither aggregated nor,
    if the chosen ones are few, shuffled.  Those of them that are stored by their
    encounter's months (``ingest_table`` with the encounters as parent) are read for
    the asked months only.
    """
    end = shift_months(month_start, months)
    own = {
        name: children_in_span(tables[name], "hr_atendimento", month_start, end)
        for name in ("coleta_sinal_vital", "itcoleta_sinal_vital", "pre_med", "itpre_med", "triagem_atendimento")
    }
    chosen = kept(in_span(tables["atendime"], "hr_atendimento", month_start, end), where).select(
        "cd_atendimento", "cd_paciente", "cd_prestador", "cd_cid", "hr_atendimento"
    )
    ids = chosen.select("cd_atendimento")
    readings = (
        own["coleta_sinal_vital"].join(ids, "cd_atendimento", "left_semi")
        .join(own["itcoleta_sinal_vital"], "cd_coleta_sinal_vital")
        .filter(F.col("cd_sinal_vital").isin(*VITAL_SIGNS))
    )
    vitals = latest_pivot(
        readings, ["cd_atendimento"], "cd_sinal_vital", "valor", "data_coleta", "cd_coleta_sinal_vital", VITAL_SIGNS
    )
    prescribed = (
        own["pre_med"].select("cd_pre_med", "cd_atendimento").join(ids, "cd_atendimento", "left_semi")
        .join(
            own["itpre_med"].filter("coalesce(sn_cancelado, 'N') = 'N'").select("cd_pre_med", "cd_produto"),
            "cd_pre_med",
        )
        .join(tables["produto"].select("cd_produto", "ds_produto"), "cd_produto")
    )
    drugs = ordered_list(prescribed, "cd_atendimento", "ds_produto", name="medicamentos")
    triage = (
        own["triagem_atendimento"].select("cd_atendimento", "cd_cor_referencia", "ds_queixa_principal")
        .join(ids, "cd_atendimento", "left_semi")
    )
    sheet = (
        chosen.join(tables["paciente"].select("cd_paciente", "nm_paciente"), "cd_paciente")
        .join(triage, "cd_atendimento", "left")
        .join(tables["prestador"].select("cd_prestador", F.col("nm_prestador").alias("medico")), "cd_prestador", "left")
        .join(tables["cid"].select("cd_cid", "ds_cid", F.col("cd_cid").alias("known_cid")), "cd_cid", "left")
        .join(vitals, "cd_atendimento", "left")
        .join(drugs, "cd_atendimento", "left")
    )
    return sheet.orderBy(F.asc_nulls_last("nm_paciente"), F.asc_nulls_last("hr_atendimento")).select(
        "cd_atendimento",
        "cd_paciente",
        "nm_paciente",
        F.date_format("hr_atendimento", "dd/MM/yyyy HH:mm").alias("dt_atendimento"),
        "medico",
        joined(F.col("known_cid"), " - ", F.col("ds_cid")).alias("cid"),
        label_of(F.col("cd_cor_referencia"), COLOURS, NO_COLOUR).alias("classificacao"),
        F.col("ds_queixa_principal").alias("anamnese"),
        *VITAL_SIGNS.values(),
        "medicamentos",
    )

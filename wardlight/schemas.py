"""Columns of the source tables and of the derived tables.

Only columns that some operator reads are declared.  Dates carry a time of day
and no zone.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

_TS = "timestamp_ntz"

# Table and column names of the source system.
SOURCE_DDL = {
    "atendime": f"cd_atendimento bigint, cd_atendimento_pai bigint, cd_paciente bigint, cd_prestador bigint, "
    f"cd_cid string, cd_leito bigint, cd_multi_empresa int, tp_atendimento string, dt_atendimento {_TS}, "
    f"hr_atendimento {_TS}, dt_alta {_TS}, dt_alta_medica {_TS}, dt_prevista_alta {_TS}, sn_obito string",
    "paciente": f"cd_paciente bigint, nm_paciente string, dt_nascimento {_TS}",
    "triagem_atendimento": f"cd_triagem_atendimento bigint, cd_atendimento bigint, dh_pre_atendimento {_TS}, "
    "cd_multi_empresa int, cd_fila_senha int, ds_senha string, cd_cor_referencia int, ds_queixa_principal string",
    "sacr_tempo_processo": f"cd_triagem_atendimento bigint, cd_tipo_tempo_processo int, dh_processo {_TS}",
    "sacr_tipo_tempo_processo": "cd_tipo_tempo_processo int",
    "sacr_pendencia_sala": "cd_triagem_atendimento bigint, tp_situacao string, tp_pedido string",
    "coleta_sinal_vital": f"cd_coleta_sinal_vital bigint, cd_atendimento bigint, data_coleta {_TS}",
    "itcoleta_sinal_vital": "cd_coleta_sinal_vital bigint, cd_sinal_vital int, valor double",
    "pre_med": f"cd_pre_med bigint, cd_atendimento bigint, cd_prestador bigint, dt_pre_med {_TS}",
    "itpre_med": "cd_itpre_med bigint, cd_pre_med bigint, cd_produto bigint, sn_cancelado string, ds_itpre_med string",
    "produto": "cd_produto bigint, ds_produto string",
    "prestador": "cd_prestador bigint, nm_prestador string",
    "cid": "cd_cid string, ds_cid string",
    "diagnostico_atendime": "cd_atendimento bigint, cd_cid string",
    "leito": f"cd_leito bigint, cd_unid_int bigint, dt_desativacao {_TS}, tp_ocupacao string",
    "unid_int": "cd_unid_int bigint, ds_unid_int string, sn_ativo string",
    "aviso_cirurgia": f"cd_aviso_cirurgia bigint, cd_multi_empresa int, tp_situacao string, dt_aviso_cirurgia {_TS}, "
    f"dt_realizacao {_TS}, dt_inicio_cirurgia {_TS}, dt_fim_cirurgia {_TS}",
    "cirurgia_aviso": "cd_cirurgia_aviso bigint, cd_aviso_cirurgia bigint, cd_cirurgia bigint",
    "cirurgia": "cd_cirurgia bigint, ds_cirurgia string, tp_cirurgia string",
    "prestador_aviso": "cd_aviso_cirurgia bigint, cd_cirurgia_aviso bigint, cd_prestador bigint, sn_principal string",
    "solicitacao_os": f"cd_os bigint, cd_oficina int, tp_situacao string, dt_pedido {_TS}, ds_servico_geral string, "
    "ds_servico string, nm_solicitante string",
}

DERIVED_DDL = {
    "metrics": f"as_of {_TS}, unit_id bigint, area string, metric string, value double",
    "metric_catalog": "metric string, label string, unit string, warn double, critical double",
    "run_log": "area string, query_key string, query_label string, row_count bigint, columns array<string>, "
    "sample array<string>, truncated boolean, error string",
    "alerts": f"as_of {_TS}, unit_id bigint, area string, prioridade string, titulo string, descricao string, "
    f"timestamp {_TS}",
    "alert_notes": "area string, titulo string, prioridade string, descricao_contextual string",
    "alert_additions": "seq bigint, area string, prioridade string, titulo string, descricao string",
    "run_notes": "seq bigint, query_key string, classification string, summary string",
}


def schema(table: str) -> StructType:
    """Schema of a source or derived table."""
    return StructType.fromDDL(SOURCE_DDL.get(table) or DERIVED_DDL[table])

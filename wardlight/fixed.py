"""Labels, limits, word lists and message texts.

All of them are data that results depend on; the logic that uses them is in
``operators``.
"""

# Areas in display order.
AREAS = [
    "Diretoria",
    "Enfermagem",
    "UTI",
    "Centro Cirúrgico",
    "Farmácia",
    "Operações Integradas",
]

# Encounter type codes.
ENCOUNTER_TYPES = {
    "I": "Internação",
    "U": "Urgência",
    "E": "Externo",
    "A": "Ambulatório",
    "H": "Home Care",
    "B": "Busca Ativa",
}

# Names of the five admission and discharge indicators, in row order.
INDICATORS = [
    "Internados Hoje",
    "Altas Hospitalar",
    "Altas Médicas",
    "Previsão de Altas",
    "Previsão de Altas com Atraso",
]

# Steps of an emergency visit.
STEP_TICKET = 1
STEP_CLASSIFICATION_IN = 11
STEP_CLASSIFICATION_OUT = 12
STEP_REGISTRATION_START = 21
STEP_REGISTRATION_END = 22
STEP_INTAKE_START = 31
STEP_CARE_END = 32
STEP_AFTER_MEDICATION = 71

# Ticket queues of the triage line.
TRIAGE_QUEUES = [7, 20, 21, 23, 24, 26]

# Triage colours.
COLOURS = {1: "BRANCO", 2: "VERMELHO", 3: "AMARELO", 4: "VERDE", 5: "AZUL"}
NO_COLOUR = "NÃO CLASSIFICADO"

# Vital sign codes.
VITAL_SIGNS = {
    1: "temperatura",
    2: "frequencia_cardiaca",
    4: "pressao_sistolica",
    5: "pressao_diastolica",
    11: "spo2",
    13: "glicemia",
}

# Age bands: label and first age above the band.
AGE_BANDS = [("0–17", 18), ("18–59", 60)]
LAST_AGE_BAND = "60+"

# Surgery size codes.
SURGERY_SIZES = {
    "P": "Pequeno Porte",
    "M": "Médio Porte",
    "G": "Grande Porte",
    "E": "Especial",
}

# Order texts that mark a conditional order.
CONDITIONAL_PREFIXES = ["SE ", "CONFORME", "EM CASO", "INFUNDIR"]

# Drug classes by name keyword, first match wins.
DRUG_CLASSES = [
    ("ANTIBIOTICO", ["CEF", "AMOX", "AZITRO", "CIPRO", "CLINDA", "PIPER", "METRONIDAZOL"]),
    (
        "ANALGESICO",
        ["DIPIRONA", "PARACETAMOL", "MORFINA", "TRAMADOL", "CETOPROFENO", "DICLOFENACO"],
    ),
]
OTHER_DRUGS = "OUTROS"

# Surgery states that count as late.
LATE_STATES = ["A", "AT", "ATRASADA"]

# Metric catalog: metric, label, unit, warning limit, critical limit.
METRIC_CATALOG = [
    ("ocupacao_percent", "Ocupação geral", "%", 85.0, 95.0),
    ("obitos_mes_atual", "Óbitos no mês", "", 15.0, 20.0),
    ("fila_total", "Fila total", "pacientes", 30.0, 40.0),
    ("tempo_medio_espera_min", "Tempo médio de espera", "min", 30.0, 45.0),
    ("ocupacao_uti_percent", "Ocupação da UTI", "%", 85.0, 90.0),
    ("pacientes_criticos", "Pacientes críticos", "pacientes", 12.0, 15.0),
    ("cirurgias_atrasadas", "Cirurgias atrasadas", "cirurgias", 5.0, 8.0),
    ("taxa_cancelamento_percent", "Taxa de cancelamento", "%", 8.0, 12.0),
    ("itens_ruptura", "Itens em ruptura", "itens", 0.0, 1.0),
    ("itens_alto_risco_baixo", "Itens de alto risco (baixo estoque)", "itens", 2.0, 3.0),
]

# Metric arithmetic.
ICU_BEDS = 30
CRITICAL_SHARE = 0.55
LONG_QUEUE = 30
LONG_QUEUE_WAIT = 50
SHORT_QUEUE_WAIT = 25
LOW_STOCK = 10

# Metric status names.
STATUS_CRITICAL = "crítico"
STATUS_WARNING = "atenção"
STATUS_NORMAL = "controlado"
STATUS_UNKNOWN = "informativo"
LIMITS_TEXT = ("Atenção > ", " | Crítico > ")
NO_LIMITS = "Sem limite configurado"

# Alert priorities, least to most urgent, with their labels.
PRIORITY_LABELS = {
    "baixa": "Baixa prioridade",
    "media": "Prioridade média",
    "alta": "Alta prioridade",
}
NO_PRIORITY_LABEL = "Informativo"

# Length limits of an alert.
TITLE_LENGTH = (3, 120)
DESCRIPTION_LENGTH = (5, 600)

# Threshold alerts: area, metric, limit, priority, title, text before and
# after the value, decimals of the value.
THRESHOLD_RULES = [
    ("Diretoria", "ocupacao_percent", 95.0, "alta", "Capacidade crítica", "Ocupação em ", "%", 1),
    ("Diretoria", "obitos_mes_atual", 20.0, "media", "Óbitos acima do esperado", "Óbitos no mês: ", "", 0),
    ("Enfermagem", "fila_total", 40.0, "alta", "Sobrecarga operacional", "Fila atual com ", " pacientes", 0),
    ("Enfermagem", "tempo_medio_espera_min", 45.0, "media", "Espera elevada", "Tempo médio de espera: ", " min", 0),
    ("UTI", "ocupacao_uti_percent", 90.0, "alta", "UTI em lotação", "Ocupação UTI em ", "%", 1),
    ("UTI", "pacientes_criticos", 15.0, "alta", "Alta criticidade clínica", "Pacientes críticos: ", "", 0),
    ("Centro Cirúrgico", "cirurgias_atrasadas", 8.0, "media", "Atrasos cirúrgicos", "", " cirurgias com atraso", 0),
    ("Centro Cirúrgico", "taxa_cancelamento_percent", 12.0, "alta", "Cancelamentos elevados", "Taxa de cancelamento em ", "%", 1),
    ("Farmácia", "itens_ruptura", 0.0, "alta", "Risco de falta", "", " itens em ruptura", 0),
    ("Farmácia", "itens_alto_risco_baixo", 3.0, "alta", "Estoque crítico de alto risco", "", " itens de alto risco com baixo estoque", 0),
]

# Cross-area alerts: area, priority, title, text, limits that must all be passed.
CROSS_RULES = [
    (
        "Diretoria",
        "alta",
        "Pressão assistencial sistêmica",
        "Alta ocupação hospitalar associada à fila elevada na Enfermagem",
        [("ocupacao_percent", 95.0), ("fila_total", 40.0)],
    ),
    (
        "UTI",
        "alta",
        "Gargalo entre UTI e Centro Cirúrgico",
        "Lotação da UTI combinada com atrasos cirúrgicos sugere bloqueio de fluxo assistencial",
        [("ocupacao_uti_percent", 90.0), ("cirurgias_atrasadas", 8.0)],
    ),
    (
        "Farmácia",
        "alta",
        "Risco operacional por insumos",
        "Ruptura de itens e aumento de cancelamentos indicam possível impacto de abastecimento",
        [("itens_ruptura", 0.0), ("taxa_cancelamento_percent", 8.0)],
    ),
]

# Alert for areas with failed queries.
COLLECTION_FAILURE = (
    "media",
    "Falha de coleta de dados",
    " queries com erro podem comprometer a análise da área",
)

# Which metric an alert is about: metric, keywords per lower-cased field, and
# the area the rule is limited to or excludes.  First match wins.
ALERT_METRIC_RULES = [
    ("ocupacao_uti_percent", {"titulo": "ocupação", "descricao": "ocupação"}, "UTI"),
    ("ocupacao_percent", {"titulo": "ocupação", "descricao": "ocupação"}, None),
    ("obitos_mes_atual", {"titulo": "óbito", "descricao": "óbito"}, None),
    ("fila_total", {"descricao": "fila", "titulo": "sobrecarga"}, None),
    ("tempo_medio_espera_min", {"descricao": "espera"}, None),
    ("pacientes_criticos", {"titulo": "crític"}, "UTI"),
    ("cirurgias_atrasadas", {"titulo": "atras"}, None),
    ("taxa_cancelamento_percent", {"titulo": "cancel"}, None),
    ("itens_ruptura", {"descricao": "ruptura"}, None),
    ("itens_alto_risco_baixo", {"titulo": "alto risco"}, None),
]
NO_METRIC_LABEL = "Contexto geral"
NO_METRIC_VALUE = "Nenhuma métrica associada"  # worded anew

# Text put before an added context note.
CONTEXT_MARK = " | Contexto IA: "

# Query health classes.
HEALTHY = "saudável"
WATCH = "atenção"
CRITICAL = "crítica"

# Query health rules: class, text, condition on the run (kind, word in the
# query key, row count that must be passed).  First match wins.
RUN_RULES = [
    (CRITICAL, "Falha de execução da query: revisar conectividade, SQL ou permissões.", "error", "", 0),
    (WATCH, "Sem dados retornados; validar se é comportamento esperado para o período.", "empty", "", 0),
    (WATCH, "Volume elevado de dados; monitorar impacto operacional e performance.", "rows", "", 1000),
    (CRITICAL, "Existem OS de manutenção acima de 24h em aberto.", "rows", "os_manutencao_aberta_mais_24h", 0),
    (WATCH, "Volume alto de medicação administrada; monitorar frequência por paciente.", "rows", "medicacao", 300),
    (WATCH, "Grande dispersão de tempos cirúrgicos; revisar gargalos por especialidade.", "rows", "tempo_medio_por_tipo_cirurgia", 200),
]
RUN_DEFAULT = (HEALTHY, "Consulta dentro do esperado.")

# Marks of the cross-area findings.
MANY_MEDICATION_ROWS = 400
QUIET_QUEUE = 12
QUIET_STOCK = 1
BUSY_QUEUE = 35
BUSY_STOCK = 3

# Titles and texts of the cross-area findings.
FINDINGS = {
    "recurrence": (
        "Risco de vício/uso recorrente em medicação",
        "Há volume relevante de administração medicamentosa. "
        "Cruzar frequência por paciente + classe terapêutica para identificar possível uso recorrente indevido.",
    ),
    "audit": (
        "Conferência de prescrição",
        "Prescrições por médico disponíveis para auditoria de conformidade. "
        "Recomendado validar protocolos e divergências por especialidade.",
    ),
    "aged_orders": (
        "Manutenção com fila envelhecida",
        " OS acima de 24h em aberto: indício de capacidade insuficiente ou priorização inadequada.",
    ),
    "idle_shop": (
        "Possível ociosidade da manutenção",
        "Sem OS abertas nas últimas janelas; validar escala para evitar subutilização da equipe.",
    ),
    "idle_wards": (
        "Ociosidade potencial: Enfermagem e Farmácia",
        "Baixo volume assistencial com baixo estresse de estoque. Avaliar remanejamento de equipe por turno.",
    ),
    "pressed_wards": (
        "Pressão simultânea: Enfermagem e Farmácia",
        "Fila elevada combinada com itens de alto risco em baixa disponibilidade.",
    ),
}

# Rows of a query result kept in the run log.
SAMPLE_ROWS = 20

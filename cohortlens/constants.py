"""Domain constants.

FIXED VALUES -- these must equal the behaviour being reproduced, so they are
stated here plainly, in their natural order, in one place.
"""

# The four ordinal level names, lowest to highest, with codes 0..3.
LEVEL_NAMES = ["Quartzo", "Ágata", "Ametista", "Topázio"]
LEVEL_CODES = {"Quartzo": 0, "Ágata": 1, "Ametista": 2, "Topázio": 3}

# The eight indicators shared by every yearly table.
COMMON_FEATURES = ["INDE", "IAN", "IDA", "IEG", "IAA", "IPS", "IPP", "IPV"]

# Default entity / period column names.
ID_COL = "RA"
TIME_COL = "ano"

# Generic and per-year column renames (keys are upper-case,
# i.e. after column-name cleaning).
COLUMN_MAP = {"NOME ANONIMIZADO": "NOME"}
COLUMN_MAP_PER_YEAR = {
    2022: {"INDE 22": "INDE", "PEDRA 22": "PEDRA"},
    2023: {"INDE 2023": "INDE", "PEDRA 2023": "PEDRA"},
    2024: {"INDE 2024": "INDE", "PEDRA 2024": "PEDRA"},
}

# Names coerced from text to numbers during harmonisation.
NUMERIC_CANDIDATES = ["INDE", "IEG", "IDA", "IPS", "IAA", "IPP", "IPV", "IAN",
                      "INDE 22", "INDE 23", "INDE 2023", "INDE 2024"]

# Accented capitals removed by column-name cleaning and their
# plain replacements (other accents are kept).
COLUMN_ACCENTS_FROM = "ÁÃÉÍÓÕÚÇ"
COLUMN_ACCENTS_TO = "AAEIOOUC"

# Text used to fill missing categorical cells.
UNKNOWN_TEXT = "Desconhecido"

# Population medians used for cold-start imputation.
FEATURE_MEDIANS = {"INDE": 6.354, "IEG": 6.472, "IDA": 6.751, "IPS": 5.893, "IAA": 6.123}

# Risk tiers.
RISK_THRESHOLD_HIGH = 0.7
RISK_THRESHOLD_MEDIUM = 0.4
RISK_LABELS = ("ALTO", "MEDIO", "BAIXO")

# Trend labels and their threshold.
TREND_THRESHOLD = 0.1
TREND_LABELS = ("crescendo", "decrescendo", "estável")

# Cluster profile names, from lowest to highest composite score,
# and the composite weights (index mean, engagement mean).
CLUSTER_PROFILE_NAMES = ["Desmotivados Crônicos", "Em Risco",
                         "Engajados com Dificuldade", "Alto Desempenho"]
CLUSTER_SCORE_WEIGHTS = (0.6, 0.4)

# Model feature lists.
RISK_FEATURES = ["INDE", "IEG", "IDA", "IPS", "IAA", "delta_INDE", "delta_IEG",
                 "delta_IDA", "anos_no_programa", "tendencia_INDE",
                 "pedras_mudadas_total"]
CLUSTER_FEATURES = ["INDE", "IEG", "IDA", "IPS", "IAA"]
DRIFT_FEATURES = ["INDE", "IEG", "IDA", "IPS", "IAA"]
QUALITY_FEATURES = ["INDE", "IEG", "IDA", "IPS", "IAA", "IAN", "IPV", "IPP"]

# Target column and the drift share above which a dataset drifts.
TARGET_COL = "target_queda_prox_ano"
DATASET_DRIFT_SHARE = 0.5

# Listing projection (source column -> output name), in order.
LISTING_COLUMNS = {
    "RA": "ra", "NOME": "nome", "ano": "ano",
    "INDE": "inde", "IEG": "ieg", "IDA": "ida",
    "IPS": "ips", "IAA": "iaa", "IAN": "ian",
    "IPV": "ipv", "IPP": "ipp",
    "PEDRA": "pedra", "FASE": "fase", "TURMA": "turma",
    "INSTITUICAO DE ENSINO": "instituicao",
    "ANO INGRESSO": "ano_ingresso",
    "tendencia_INDE": "tendencia_inde",
    "pedras_mudadas_total": "pedras_mudadas_total",
    "anos_no_programa": "anos_no_programa",
    "delta_INDE": "delta_inde",
    "delta_IEG": "delta_ieg",
    "delta_IDA": "delta_ida",
    "cluster": "cluster",
}

"""Texts, codes and bounds that results must carry unchanged."""

from __future__ import annotations

# --- Fixed values: source column names of the monthly files ----------------
SOURCE_COLUMNS = {
    "carrier": "ICAO Empresa Aérea",
    "origin": "ICAO Aeródromo Origem",
    "dest": "ICAO Aeródromo Destino",
    "status": "Situação Voo",
    "sched_dep": "Partida Prevista",
    "actual_dep": "Partida Real",
    "sched_arr": "Chegada Prevista",
    "actual_arr": "Chegada Real",
}
TIMESTAMP_COLUMNS = ("sched_dep", "actual_dep", "sched_arr", "actual_arr")
DROPPED_SOURCE_COLUMN = "Código Justificativa"
REF_MONTH_SOURCE_NAME = "ano_mes_referencia"

# --- Fixed values: names of the derived columns in the SQL views -----------
DERIVED_VIEW_COLUMNS = {
    "dep_delay_min": "atraso_partida_min",
    "arr_delay_min": "atraso_chegada_min",
    "dep_category": "categoria_atraso_partida",
    "arr_category": "categoria_atraso_chegada",
    "next_day": "operado_dia_seguinte",
}
FLIGHTS_VIEW = "voos"
ANALYTIC_VIEW = "vw_voos_analitico"
OPERATIONAL_VIEW = "vw_voos_operacionais"

# --- Fixed values: monthly file names ---------------------------------------
MONTHLY_FILE_GLOB = "VRA_*.csv"
MONTHLY_FILE_PATTERN = r"VRA_(\d{4})(\d{1,2})\.csv$"

# --- Fixed values: texts read as missing when a monthly file is loaded ------
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# --- Fixed values: flight status and delay categories -----------------------
STATUS_CANCELLED = "CANCELADO"
CATEGORY_NO_ACTUAL = "Cancelado"
CATEGORY_NO_SCHEDULE = "Sem horário previsto"
# Delay bands as (exclusive upper bound in minutes, category).
DELAY_BANDS = (
    (0, "Antecipado"),
    (30, "Pontual"),
    (60, "Atraso 30-60"),
    (120, "Atraso 60-120"),
    (240, "Atraso 120-240"),
)
CATEGORY_BEYOND_BANDS = "Atraso > 240"
ON_TIME_BELOW_MIN = 30
NEXT_DAY_ABOVE_MIN = 1440

# --- Fixed values: thresholds of the reports ---------------------------------
MIN_FLIGHTS = 5000
PHANTOM_PCT = 85
PHANTOM_PCT_AUDIT = 95
MIN_COMPLETENESS = 0.5
# A month below this share of its origin's typical month counts as one of low volume.
LOW_VOLUME_PCT = 50
FOCUS_MONTH = 12
FOCUS_WEEKDAY = 5
EXCLUDED_HEATMAP_ORIGINS = ("SBPA",)
HIGHLIGHTED_ORIGINS = ("SBJR",)
HIGHLIGHTED_CARRIERS = ("GLO", "TAM", "AZU")
YEARS = ("2024", "2025")

# --- Fixed values: labels ----------------------------------------------------
WEEKDAY_NAMES = {
    0: "Domingo", 1: "Segunda", 2: "Terca", 3: "Quarta",
    4: "Quinta", 5: "Sexta", 6: "Sabado",
}
WEEKDAY_LABELS = {
    0: "Dom", 1: "Seg", 2: "Ter", 3: "Qua", 4: "Qui", 5: "Sex", 6: "Sáb",
}
MONTH_LABELS = {
    1: "Jan", 2: "Fev", 3: "Mar", 4: "Abr", 5: "Mai", 6: "Jun",
    7: "Jul", 8: "Ago", 9: "Set", 10: "Out", 11: "Nov", 12: "Dez",
}
AIRPORT_LABELS = {
    "SBSP": "SBSP (Congonhas)",
    "SBGR": "SBGR (Guarulhos)",
    "SBKP": "SBKP (Viracopos)",
    "SBGL": "SBGL (Galeão)",
    "SBBR": "SBBR (Brasília)",
    "SBCF": "SBCF (Confins)",
    "SBSV": "SBSV (Salvador)",
    "SBRF": "SBRF (Recife)",
    "SBFZ": "SBFZ (Fortaleza)",
    "SBCT": "SBCT (Curitiba)",
    "SBRJ": "SBRJ (S. Dumont)",
    "SBFL": "SBFL (Florianópolis)",
    "SBBE": "SBBE (Belém)",
    "SBEG": "SBEG (Manaus)",
}

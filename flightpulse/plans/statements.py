"""Reports as SQL text over the registered views, in the dialect that ``dialect_sql`` reads.

They give the rows of the reports of the same names and show what statements
of users may contain: double-quoted names, the two time functions, aliases in
GROUP BY and ORDER BY, subqueries, and bound parameters.
"""

from __future__ import annotations

from ..vocabulary import (
    CATEGORY_BEYOND_BANDS,
    CATEGORY_NO_ACTUAL,
    CATEGORY_NO_SCHEDULE,
    DELAY_BANDS,
    ON_TIME_BELOW_MIN,
    STATUS_CANCELLED,
    WEEKDAY_NAMES,
)

_COMPARED = f"categoria_atraso_partida NOT IN ('{CATEGORY_NO_ACTUAL}', '{CATEGORY_NO_SCHEDULE}')"
_PUNCTUAL = f"{_COMPARED} AND atraso_partida_min < {ON_TIME_BELOW_MIN}"


def _share(part: str, whole: str) -> str:
    """A percentage of rows with two decimals; null without any."""
    return f"ROUND(SUM(CASE WHEN {part} THEN 1 ELSE 0 END) * 100.0 / NULLIF(SUM(CASE WHEN {whole} THEN 1 ELSE 0 END), 0), 2)"


_FIGURES = f"""COUNT(*) AS total_voos,
       {_share(_PUNCTUAL, _COMPARED)} AS taxa_pontualidade_pct,
       {_share(f'"Situação Voo" = {STATUS_CANCELLED!r}', 'TRUE')} AS taxa_cancelamento_pct,
       ROUND(AVG(atraso_partida_min), 1) AS atraso_medio_min"""
_WEEKDAY_NAME = " ".join(f"WHEN {number} THEN '{name}'" for number, name in WEEKDAY_NAMES.items())
_MINUTES = 'ROUND((julianday("Partida Real") - julianday("Partida Prevista")) * 1440)'
_BANDS = " ".join(f"WHEN {_MINUTES} < {upper} THEN '{category}'" for upper, category in DELAY_BANDS)

STATEMENTS = {
    # Weekdays from a time format; the name is worked out from the number after grouping.
    "by_weekday": f"""
        SELECT dia_semana_num, CASE dia_semana_num {_WEEKDAY_NAME} END AS dia_semana,
               total_voos, taxa_pontualidade_pct, taxa_cancelamento_pct, atraso_medio_min
        FROM (SELECT CAST(strftime('%w', "Partida Prevista") AS INTEGER) AS dia_semana_num, {_FIGURES}
              FROM vw_voos_analitico WHERE "Partida Prevista" IS NOT NULL GROUP BY dia_semana_num)
        ORDER BY dia_semana_num""",
    # Delays and categories from day numbers of the flights themselves, not from the derived view.
    "delay_category_share": f"""
        WITH categorias AS (
          SELECT CASE WHEN "Partida Real" IS NULL THEN '{CATEGORY_NO_ACTUAL}'
                      WHEN "Partida Prevista" IS NULL THEN '{CATEGORY_NO_SCHEDULE}'
                      {_BANDS} ELSE '{CATEGORY_BEYOND_BANDS}' END AS categoria_atraso_partida
          FROM voos)
        SELECT categoria_atraso_partida, COUNT(*) AS total,
               ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM categorias), 2) AS pct_do_total
        FROM categorias GROUP BY categoria_atraso_partida ORDER BY total DESC, categoria_atraso_partida""",
    "year_compare": f"""
        SELECT SUBSTR(ano_mes_referencia, 1, 4) AS ano, {_FIGURES}
        FROM vw_voos_analitico GROUP BY ano ORDER BY ano""",
    "cancel_by_ref_month": f"""
        SELECT ano_mes_referencia, COUNT(*) AS total_voos,
               SUM(CASE WHEN "Situação Voo" = '{STATUS_CANCELLED}' THEN 1 ELSE 0 END) AS cancelados,
               {_share(f'"Situação Voo" = {STATUS_CANCELLED!r}', 'TRUE')} AS taxa_cancelamento_pct
        FROM vw_voos_analitico GROUP BY ano_mes_referencia ORDER BY ano_mes_referencia""",
    # Bound parameters: flights at least, share of flights with a delay at least, rows.
    "carrier_best_on_time": f"""
        SELECT "ICAO Empresa Aérea" AS empresa, COUNT(*) AS total_voos,
               {_share(_PUNCTUAL, _COMPARED)} AS taxa_pontualidade_pct,
               ROUND(AVG(atraso_partida_min), 1) AS atraso_medio_min
        FROM vw_voos_operacionais GROUP BY empresa
        HAVING COUNT(*) >= ? AND COUNT(atraso_partida_min) >= ? * COUNT(*)
        ORDER BY taxa_pontualidade_pct DESC, empresa LIMIT 10""",
}

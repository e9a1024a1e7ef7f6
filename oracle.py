"""DuckDB SQL that answers every registered query on the same Parquet tables.

Written apart from the Spark code: it works on flight rows only, excludes
pairs with a row-by-row test and joins where the Spark plans aggregate.
Rates are exact (whole-number arithmetic), nulls are ordered explicitly and
ties are broken by the key, so both sides can be compared value by value.
"""

from __future__ import annotations

from flightpulse.vocabulary import MONTH_LABELS, WEEKDAY_LABELS, WEEKDAY_NAMES

FLIGHTS = """
terms AS (
  SELECT l_orderkey, l_linenumber,
         least(l_partkey % 20, l_partkey % 31) AS o,
         l_suppkey % 17 AS dst,
         l_orderkey % 12 AS c,
         (l_orderkey * 13 + l_partkey * 7 + l_linenumber * 101) % 100 AS d,
         (l_orderkey * 31 + l_partkey * 3 + l_linenumber * 17) % 100 AS x,
         (l_orderkey * 11 + l_suppkey * 5 + l_linenumber * 29) % 100 AS u,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(
           (date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) % 731) * 1440
           + (l_partkey * 37 + l_linenumber * 61) % 1440 AS BIGINT)) AS sched
  FROM lineitem
),
timed AS (
  SELECT *,
         CASE WHEN o = 3 AND c = 5 THEN x < 97 WHEN o = 4 AND c = 6 THEN x < 90 ELSE x < 4 END AS cx,
         CASE WHEN c = 9 THEN u < 60 ELSE u < 5 END AS ns,
         CASE WHEN d < 30 THEN -(d % 13) WHEN d < 86 THEN d % 30
              WHEN d < 92 THEN 30 + (d * 7) % 30 WHEN d < 96 THEN 60 + (d * 11) % 60
              WHEN d < 98 THEN 120 + (d * 13) % 120 WHEN d < 99 THEN 240 ELSE 1441 END
         + CASE WHEN month(sched) = 12 AND d >= 60 THEN o ELSE 0 END AS dl
  FROM terms
),
flights AS (
  SELECT CASE WHEN l_linenumber = 7 AND l_orderkey % 50 = 0 THEN NULL
              ELSE 'C' || lpad(CAST(c AS VARCHAR), 2, '0') END AS carrier,
         'P' || lpad(CAST(o AS VARCHAR), 2, '0') AS origin,
         'P' || lpad(CAST(dst AS VARCHAR), 2, '0') AS dest,
         CASE WHEN cx THEN 'CANCELADO' WHEN x >= 98 THEN 'NÃO INFORMADO' ELSE 'REALIZADO' END AS status,
         CASE WHEN NOT ns THEN sched END AS sched_dep,
         CASE WHEN NOT (cx OR x = 99) THEN sched + to_minutes(CAST(dl AS BIGINT)) END AS actual_dep,
         CASE WHEN NOT ns THEN sched + to_minutes(60) END AS sched_arr,
         CASE WHEN NOT (cx OR x = 99) THEN sched + to_minutes(CAST(55 + dl AS BIGINT)) END AS actual_arr,
         strftime(sched, '%Y-%m') AS ref_month
  FROM timed
)"""


def _minutes(scheduled: str, actual: str) -> str:
    seconds = f"date_diff('second', {scheduled}, {actual})"
    return f"CAST(sign({seconds}) * ((abs({seconds}) + 30) // 60) AS BIGINT)"


def _category(scheduled: str, actual: str, delay: str) -> str:
    return f"""CASE WHEN {actual} IS NULL THEN 'Cancelado'
              WHEN {scheduled} IS NULL THEN 'Sem horário previsto'
              WHEN {delay} >= 240 THEN 'Atraso > 240'
              WHEN {delay} >= 120 THEN 'Atraso 120-240'
              WHEN {delay} >= 60 THEN 'Atraso 60-120'
              WHEN {delay} >= 30 THEN 'Atraso 30-60'
              WHEN {delay} >= 0 THEN 'Pontual'
              ELSE 'Antecipado' END"""


ANALYTIC = f"""{FLIGHTS},
delayed AS (
  SELECT *, {_minutes('sched_dep', 'actual_dep')} AS dep_delay_min,
         {_minutes('sched_arr', 'actual_arr')} AS arr_delay_min
  FROM flights
),
analytic AS (
  SELECT *, {_category('sched_dep', 'actual_dep', 'dep_delay_min')} AS dep_category,
         {_category('sched_arr', 'actual_arr', 'arr_delay_min')} AS arr_category,
         coalesce(dep_delay_min > 1440, FALSE) AS next_day,
         dayofweek(sched_dep) AS weekday,
         CAST(ref_month[6:7] AS INTEGER) AS mes,
         ref_month[1:4] AS ano
  FROM delayed
)"""


def excluded(threshold: int) -> str:
    """The analytic rows and ``kept``: those outside the phantom pairs."""
    return f"""{ANALYTIC},
pairs AS (
  SELECT origin, carrier FROM analytic GROUP BY origin, carrier
  HAVING 100 * count(*) FILTER (WHERE status = 'CANCELADO') >= {threshold} * count(*)
),
kept AS (
  SELECT * FROM analytic f
  WHERE NOT EXISTS (
    SELECT 1 FROM pairs p
    WHERE (p.origin = f.origin OR p.origin IS NULL OR f.origin IS NULL)
      AND (p.carrier = f.carrier OR p.carrier IS NULL OR f.carrier IS NULL))
)"""


def ratio(num: str, den: str, scale: int) -> str:
    """round(num / den * scale), half away from zero, null for a zero denominator."""
    return (
        f"(CASE WHEN ({den}) > 0 THEN CAST(sign({num}) * "
        f"((2 * {scale} * CAST(abs({num}) AS HUGEINT) + ({den})) // (2 * ({den}))) AS BIGINT) END)"
    )


def as_double(scaled: str, scale: int) -> str:
    return f"(CAST({scaled} AS DOUBLE) / CAST({scale} AS DOUBLE))"


def count_if(test: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {test}) AS BIGINT)"


ON_TIME = "dep_category IN ('Pontual', 'Antecipado')"
COMPARABLE = "dep_category NOT IN ('Cancelado', 'Sem horário previsto')"
CANCELLED = "status = 'CANCELADO'"

N = "count(*)"
PCT_H = ratio(count_if(ON_TIME), count_if(COMPARABLE), 10000)
PCT = as_double(PCT_H, 100)
CANC = as_double(ratio(count_if(CANCELLED), N, 10000), 100)
AVG_T = ratio("sum(dep_delay_min)", "count(dep_delay_min)", 10)
AVG = as_double(AVG_T, 10)
ARR_PCT = as_double(
    ratio(
        count_if("arr_category IN ('Pontual', 'Antecipado')"),
        count_if("arr_category NOT IN ('Cancelado', 'Sem horário previsto')"),
        10000,
    ),
    100,
)
ARR_AVG = as_double(ratio("sum(arr_delay_min)", "count(arr_delay_min)", 10), 10)
COMPLETE = "2 * count(dep_delay_min) >= count(*)"

FIGURES = f"""{N} AS total_voos, {PCT} AS taxa_pontualidade_pct,
       {CANC} AS taxa_cancelamento_pct, {AVG} AS atraso_medio_min"""
CANCELLATIONS = f"""{N} AS total_voos, {count_if(CANCELLED)} AS cancelados,
       {CANC} AS taxa_cancelamento_pct"""

WEEKDAY_NAME = "CASE weekday " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in WEEKDAY_NAMES.items()) + " END"
MONTH_LABEL = f"{list(MONTH_LABELS.values())}[mes]"
WEEKDAY_LABEL = f"{list(WEEKDAY_LABELS.values())}[weekday + 1]"


def on_rows(body: str) -> str:
    return f"WITH {ANALYTIC} {body}"


def on_kept(body: str, threshold: int = 85) -> str:
    return f"WITH {excluded(threshold)} {body}"


def _years(years: tuple[str, ...]) -> str:
    return "ano IN (" + ", ".join(f"'{year}'" for year in years) + ")"


def _largest(k: int, min_flights: int, where: str = "TRUE") -> str:
    return f"""largest AS (
  SELECT origin, count(*) AS flights FROM kept WHERE {where} GROUP BY origin
  HAVING count(*) >= {min_flights}
  ORDER BY flights DESC, origin ASC NULLS FIRST LIMIT {k}
)"""


def origin_months(k: int, min_flights: int) -> str:
    return f"""WITH {excluded(85)}, {_largest(k, min_flights)},
months AS (
  SELECT kept.origin AS aeroporto, ref_month AS ano_mes_referencia, {N} AS total_voos,
         {PCT} AS taxa_pontualidade_pct, {AVG} AS atraso_medio_min
  FROM kept JOIN largest ON kept.origin = largest.origin
  GROUP BY kept.origin, ref_month
)"""


def origin_profiles(k: int, min_flights: int, where: str = "TRUE") -> str:
    return f"""WITH {excluded(85)}, {_largest(k, min_flights, where)},
per_month AS (
  SELECT kept.origin AS aeroporto, mes, {PCT_H} AS p, {AVG_T} AS d
  FROM kept JOIN largest ON kept.origin = largest.origin
  GROUP BY kept.origin, mes
),
profile AS (
  SELECT aeroporto,
         max(p) FILTER (WHERE mes = 12) AS p_dez, max(d) FILTER (WHERE mes = 12) AS d_dez,
         CAST(sum(p) FILTER (WHERE mes <> 12) AS BIGINT) AS p_sum,
         count(p) FILTER (WHERE mes <> 12) AS p_n,
         CAST(sum(d) FILTER (WHERE mes <> 12) AS BIGINT) AS d_sum,
         count(d) FILTER (WHERE mes <> 12) AS d_n
  FROM per_month GROUP BY aeroporto
)"""


P_REST = as_double(ratio("p_sum", "p_n", 1), 100)
P_DELTA = as_double(ratio("(p_dez * p_n - p_sum)", "p_n", 1), 100)
D_REST = as_double(ratio("d_sum", "d_n", 1), 10)
D_DELTA = as_double(ratio("(d_dez * d_n - d_sum)", "d_n", 1), 10)
PROFILE_COLUMNS = f"""aeroporto, {P_REST} AS pontualidade_media_sem_dez,
       {as_double('p_dez', 100)} AS pontualidade_dezembro, {P_DELTA} AS variacao_dez_pp,
       {D_REST} AS atraso_medio_sem_dez, {as_double('d_dez', 10)} AS atraso_dez_min"""


def _pct_where(test: str) -> str:
    return ratio(count_if(f"{ON_TIME} AND {test}"), count_if(f"{COMPARABLE} AND {test}"), 10000)


def report_sql(
    min_flights: int,
    min_flights_of_year: int,
    excluded_origin: str,
    labels: dict[str, str],
    flagged: dict[str, tuple[str, ...]],
) -> dict[str, str]:
    """SQL of every report, with the thresholds the registered queries use."""
    both, n = ("2024", "2025"), min_flights
    having = f"HAVING count(*) >= {n}"
    having_of_year = f"HAVING count(*) >= {min_flights_of_year}"
    complete = f"{having} AND {COMPLETE}"
    label_case = "CASE aeroporto " + " ".join(
        f"WHEN '{code}' THEN '{text}'" for code, text in labels.items()
    ) + " ELSE aeroporto END"
    flagged_origins = ", ".join(f"'{code}'" for code in flagged["origins"])
    flagged_carriers = ", ".join(f"'{code}'" for code in flagged["carriers"])

    def origins(columns: str, source: str, tail: str) -> str:
        return f"SELECT origin AS aeroporto, {columns} FROM {source} GROUP BY origin {tail}"

    def carriers(columns: str, tail: str) -> str:
        return f"SELECT carrier AS empresa, {columns} FROM kept GROUP BY carrier {tail}"

    on_time_asc = "ORDER BY taxa_pontualidade_pct ASC NULLS FIRST"
    heat_rows = f"""{origin_profiles(14, n, f"origin <> '{excluded_origin}'")},
heat AS (
  SELECT aeroporto, mes, {as_double('p', 100)} AS pontualidade, {P_DELTA} AS variacao_dez_pp,
         {label_case} AS nome_aeroporto, {MONTH_LABEL} AS nome_mes
  FROM per_month JOIN profile USING (aeroporto)
)"""
    grid = ", ".join(
        f"max(pontualidade) FILTER (WHERE mes = {number}) AS \"{name}\""
        for number, name in MONTH_LABELS.items()
    )

    def kpis(years):
        return on_rows(f"SELECT {FIGURES} FROM analytic WHERE {_years(years)}")

    def dash_month(years):
        return on_rows(f"""SELECT mes, {PCT} AS taxa_pontualidade_pct, {MONTH_LABEL} AS nome_mes,
       mes = 12 AS destaque FROM analytic WHERE {_years(years)} GROUP BY mes ORDER BY mes""")

    def dash_weekday(years):
        return on_rows(f"""SELECT CAST(weekday AS INTEGER) AS dia_semana_num,
       {PCT} AS taxa_pontualidade_pct, {WEEKDAY_LABEL} AS nome_dia,
       CAST((weekday + 6) % 7 AS INTEGER) AS ordem, weekday = 5 AS destaque
       FROM analytic WHERE sched_dep IS NOT NULL AND {_years(years)} GROUP BY weekday ORDER BY ordem""")

    def dash_origins(years, having=having):
        return on_kept(f"""SELECT *, format('{{:.1f}}%', taxa_pontualidade_pct) AS texto FROM (
       SELECT origin AS aeroporto, {N} AS total_voos, {PCT} AS taxa_pontualidade_pct
       FROM kept WHERE {_years(years)} GROUP BY origin {having}
       ORDER BY taxa_pontualidade_pct ASC NULLS FIRST, aeroporto ASC NULLS FIRST LIMIT 10)""")

    def dash_cancelled(years, having=having):
        return on_kept(f"""SELECT *, format('{{:.1f}}%', taxa_cancelamento_pct) AS texto,
       coalesce(aeroporto IN ({flagged_origins}), FALSE) AS destaque FROM (
       SELECT origin AS aeroporto, {CANCELLATIONS}
       FROM kept WHERE {_years(years)} GROUP BY origin {having}
       ORDER BY taxa_cancelamento_pct DESC NULLS LAST, aeroporto ASC NULLS FIRST LIMIT 5)""")

    def dash_carriers(years, having=having):
        return on_kept(f"""SELECT carrier AS empresa, {N} AS total_voos, {PCT} AS taxa_pontualidade_pct,
       {AVG} AS atraso_medio_min, coalesce(carrier IN ({flagged_carriers}), FALSE) AS destaque
       FROM kept WHERE {_years(years)} GROUP BY carrier {having} AND {COMPLETE}""")

    sql = {
        "on_time_overall": on_rows(f"""SELECT {N} AS total_voos_comparaveis,
       {count_if(ON_TIME)} AS pontuais, {as_double(ratio(count_if(ON_TIME), N, 10000), 100)} AS taxa_pontualidade_pct
       FROM analytic WHERE {COMPARABLE}"""),
        "cancel_overall": on_rows(f"SELECT {CANCELLATIONS} FROM analytic"),
        "delay_mean_median": on_rows(f"""SELECT {N} AS total_voos, {AVG} AS atraso_medio_min,
       (SELECT dep_delay_min FROM (
          SELECT dep_delay_min, row_number() OVER (ORDER BY dep_delay_min) - 1 AS position,
                 count(*) OVER () // 2 AS middle
          FROM analytic WHERE dep_delay_min IS NOT NULL) WHERE position = middle) AS atraso_mediano_min
       FROM analytic WHERE dep_delay_min IS NOT NULL"""),
        "delay_category_share": on_rows(f"""SELECT dep_category AS categoria_atraso_partida, {N} AS total,
       {as_double(ratio(N, '(SELECT count(*) FROM analytic)', 10000), 100)} AS pct_do_total
       FROM analytic GROUP BY dep_category"""),
        "year_compare": on_rows(f"SELECT ano, {FIGURES} FROM analytic GROUP BY ano"),
        "by_calendar_month": on_rows(f"SELECT mes, {FIGURES} FROM analytic GROUP BY mes"),
        "by_ref_month": on_rows(
            f"SELECT ref_month AS ano_mes_referencia, {FIGURES} FROM analytic GROUP BY ref_month"
        ),
        "by_weekday": on_rows(f"""SELECT CAST(weekday AS INTEGER) AS dia_semana_num,
       {WEEKDAY_NAME} AS dia_semana, {FIGURES}
       FROM analytic WHERE sched_dep IS NOT NULL GROUP BY weekday"""),
        "worst_ref_month": on_rows(f"""SELECT ref_month AS ano_mes_referencia, {AVG} AS atraso_medio_min
       FROM analytic GROUP BY ref_month
       ORDER BY atraso_medio_min DESC NULLS LAST, ano_mes_referencia LIMIT 1"""),
        "worst_weekday": on_rows(f"""SELECT {WEEKDAY_NAME} AS dia_semana, {AVG} AS atraso_medio_min
       FROM analytic WHERE sched_dep IS NOT NULL GROUP BY weekday
       ORDER BY atraso_medio_min DESC NULLS LAST, dia_semana LIMIT 1"""),
        "cancel_by_ref_month": on_rows(
            f"SELECT ref_month AS ano_mes_referencia, {CANCELLATIONS} FROM analytic GROUP BY ref_month"
        ),
        "origin_top_volume": on_rows(
            origins(FIGURES, "analytic", "ORDER BY total_voos DESC, aeroporto ASC NULLS FIRST LIMIT 15")
        ),
        "origin_worst_on_time": on_rows(
            origins(FIGURES, "analytic", f"{having} {on_time_asc}, aeroporto ASC NULLS FIRST LIMIT 10")
        ),
        "origin_most_cancelled": on_rows(
            origins(
                CANCELLATIONS,
                "analytic",
                f"{having} ORDER BY taxa_cancelamento_pct DESC NULLS LAST, aeroporto ASC NULLS FIRST LIMIT 10",
            )
        ),
        "origin_most_delayed": on_rows(
            origins(
                f"{N} AS total_voos, {AVG} AS atraso_medio_min, {PCT} AS taxa_pontualidade_pct",
                "analytic",
                f"{having} ORDER BY atraso_medio_min DESC NULLS LAST, aeroporto ASC NULLS FIRST LIMIT 10",
            )
        ),
        "dest_worst_arrival": on_rows(f"""SELECT dest AS aeroporto, {N} AS total_voos,
       {ARR_PCT} AS taxa_pontualidade_chegada_pct, {CANC} AS taxa_cancelamento_pct,
       {ARR_AVG} AS atraso_medio_chegada_min
       FROM analytic GROUP BY dest {having}
       ORDER BY taxa_pontualidade_chegada_pct ASC NULLS FIRST, aeroporto ASC NULLS FIRST LIMIT 10"""),
        "origin_volume_vs_on_time": on_rows(f"""SELECT aeroporto, total_voos,
       rank() OVER (ORDER BY total_voos DESC) AS rank_volume, taxa_pontualidade_pct,
       rank() OVER (ORDER BY share ASC NULLS FIRST) AS rank_pontualidade, atraso_medio_min
       FROM (SELECT origin AS aeroporto, {N} AS total_voos, {PCT} AS taxa_pontualidade_pct,
                    CAST({count_if(ON_TIME)} AS DOUBLE) / nullif({count_if(COMPARABLE)}, 0) AS share,
                    {AVG} AS atraso_medio_min
             FROM analytic GROUP BY origin {having})
       ORDER BY rank_pontualidade, aeroporto ASC NULLS FIRST LIMIT 15"""),
        "phantom_pairs_audit": on_rows(f"""SELECT * FROM (
       SELECT origin AS aeroporto, carrier AS empresa, {CANCELLATIONS}
       FROM analytic GROUP BY origin, carrier) WHERE taxa_cancelamento_pct >= 95"""),
        "phantom_pairs_audit_85": on_rows(f"""SELECT * FROM (
       SELECT origin AS aeroporto, carrier AS empresa, {CANCELLATIONS}
       FROM analytic GROUP BY origin, carrier) WHERE taxa_cancelamento_pct >= 85"""),
        "origin_worst_on_time_clean": on_kept(
            origins(FIGURES, "kept", f"{having} {on_time_asc}, aeroporto ASC NULLS FIRST LIMIT 10"), 95
        ),
        "origin_most_cancelled_clean": on_kept(
            origins(
                CANCELLATIONS,
                "kept",
                f"{having} ORDER BY taxa_cancelamento_pct DESC NULLS LAST, aeroporto ASC NULLS FIRST LIMIT 10",
            ),
            95,
        ),
        "carrier_top_volume": on_kept(
            carriers(FIGURES, "ORDER BY total_voos DESC, empresa ASC NULLS FIRST LIMIT 15")
        ),
        "carrier_best_on_time": on_kept(
            carriers(
                f"{N} AS total_voos, {PCT} AS taxa_pontualidade_pct, {AVG} AS atraso_medio_min",
                f"{complete} ORDER BY taxa_pontualidade_pct DESC NULLS LAST, empresa ASC NULLS FIRST LIMIT 10",
            )
        ),
        "carrier_worst_on_time": on_kept(
            carriers(
                f"{N} AS total_voos, {PCT} AS taxa_pontualidade_pct, {AVG} AS atraso_medio_min",
                f"{complete} {on_time_asc}, empresa ASC NULLS FIRST LIMIT 10",
            )
        ),
        "carrier_most_cancelled": on_kept(
            carriers(
                CANCELLATIONS,
                f"{complete} ORDER BY taxa_cancelamento_pct DESC NULLS LAST, empresa ASC NULLS FIRST LIMIT 10",
            )
        ),
        "carrier_most_delayed": on_kept(
            carriers(
                f"{N} AS total_voos, {AVG} AS atraso_medio_min, {PCT} AS taxa_pontualidade_pct",
                f"{complete} ORDER BY atraso_medio_min DESC NULLS LAST, empresa ASC NULLS FIRST LIMIT 10",
            )
        ),
        "carrier_december_delta": on_kept(f"""SELECT empresa, total_voos,
       {as_double('rest', 100)} AS pontualidade_media_anual, {as_double('dez', 100)} AS pontualidade_dezembro,
       {as_double('dez - rest', 100)} AS variacao_dez_pp
       FROM (SELECT carrier AS empresa, {N} AS total_voos, {_pct_where('mes <> 12')} AS rest,
                    {_pct_where('mes = 12')} AS dez
             FROM kept GROUP BY carrier {having})"""),
        "carrier_year_evolution": on_kept(
            carriers(
                ", ".join(
                    [f"{count_if(f"ano = '{y}'")} AS voos_{y}" for y in both]
                    + [f"{as_double(_pct_where(f"ano = '{y}'"), 100)} AS pontualidade_{y}" for y in both]
                    + [
                        as_double(
                            ratio(
                                count_if(f"{CANCELLED} AND ano = '{y}'"), count_if(f"ano = '{y}'"), 10000
                            ),
                            100,
                        )
                        + f" AS cancelamento_{y}"
                        for y in both
                    ]
                ),
                having,
            )
        ),
        "origin_month_matrix": origin_months(15, n) + " SELECT * FROM months",
        "worst_origin_months": origin_months(15, n)
        + f" SELECT * FROM months {on_time_asc}, aeroporto, ano_mes_referencia LIMIT 10",
        "origin_december_delta": origin_profiles(15, n)
        + f" SELECT {PROFILE_COLUMNS}, {D_DELTA} AS variacao_atraso_dez_min FROM profile",
        "stable_origins": origin_profiles(15, n) + f" SELECT {PROFILE_COLUMNS} FROM profile",
        "dash_origin_month_heatmap": heat_rows + " SELECT * FROM heat",
        "dash_origin_month_grid": heat_rows
        + f" SELECT nome_aeroporto, variacao_dez_pp, {grid} FROM heat GROUP BY nome_aeroporto, variacao_dez_pp",
        "dash_kpi_texts": on_rows(f"""SELECT replace(format('{{:,}}', total_voos), ',', '.') AS total_voos,
       format('{{:.1f}}%', taxa_pontualidade_pct) AS pontualidade,
       format('{{:.1f}}%', taxa_cancelamento_pct) AS cancelamento,
       format('{{:.1f}} min', atraso_medio_min) AS atraso_medio
       FROM (SELECT {FIGURES} FROM analytic WHERE {_years(both)})"""),
        "ingest_summary": on_rows("""SELECT count(*) AS total_registros, min(sched_dep) AS data_minima,
       max(sched_dep) AS data_maxima FROM flights WHERE sched_dep IS NOT NULL"""),
        "missing_schedule_by_month": on_rows(f"""SELECT ref_month AS ano_mes_referencia, {N} AS total_voos,
       {count_if('sched_dep IS NULL')} AS sem_horario_previsto,
       {as_double(ratio(count_if('sched_dep IS NULL'), N, 10000), 100)} AS pct_sem_horario
       FROM flights GROUP BY ref_month"""),
        "missing_schedule_by_carrier_month": on_rows(f"""SELECT carrier AS empresa,
       ref_month AS ano_mes_referencia, {N} AS total_voos,
       {count_if('sched_dep IS NULL')} AS sem_horario_previsto,
       {as_double(ratio(count_if('sched_dep IS NULL'), N, 10000), 100)} AS pct_sem_horario
       FROM flights GROUP BY carrier, ref_month"""),
        "unscheduled_flights": on_rows(f"""SELECT dep_category AS categoria_atraso_partida, {N} AS total,
       {as_double(ratio(N, '(SELECT count(*) FROM analytic)', 10000), 100)} AS pct_do_total
       FROM analytic WHERE dep_category = 'Sem horário previsto' GROUP BY dep_category"""),
        "origin_month_coverage": on_rows("""SELECT origin AS aeroporto,
       CAST(sum(n) AS BIGINT) AS total_voos, count(*) AS meses_com_voos,
       min(n) AS menor_volume_mes, max(n) AS maior_volume_mes,
       (SELECT count(DISTINCT ref_month) FROM flights) AS meses_no_periodo,
       count(*) < (SELECT count(DISTINCT ref_month) FROM flights) AS interrompido,
       list_sort(list(n))[len(list(n)) // 2 + 1] AS volume_tipico_mes,
       len(list_filter(list(n), lambda v: 2 * v < list_sort(list(n))[len(list(n)) // 2 + 1])) AS meses_baixo_volume
       FROM (SELECT origin, ref_month, count(*) AS n FROM flights GROUP BY origin, ref_month)
       GROUP BY origin"""),
    }
    for suffix, years, least in (
        ("", both, having),
        ("_2024", ("2024",), having_of_year),
        ("_2025", ("2025",), having_of_year),
    ):
        sql[f"dash_kpis{suffix}"] = kpis(years)
        sql[f"dash_by_month{suffix}"] = dash_month(years)
        sql[f"dash_by_weekday{suffix}"] = dash_weekday(years)
        sql[f"dash_origin_worst_on_time{suffix}"] = dash_origins(years, least)
        sql[f"dash_origin_most_cancelled{suffix}"] = dash_cancelled(years, least)
        sql[f"dash_carrier_on_time{suffix}"] = dash_carriers(years, least)
    return sql


FLIGHT_COLUMNS = "carrier, origin, dest, status, sched_dep, actual_dep, sched_arr, actual_arr, ref_month"
DERIVED_COLUMNS = "dep_delay_min, arr_delay_min, dep_category, arr_category, next_day"


def operator_sql() -> dict[str, str]:
    """SQL of the row-level operators and of the rollup tables."""
    measures = f"""{N} AS n, {count_if(CANCELLED)} AS n_cancelled, {count_if(ON_TIME)} AS n_dep_on_time,
       count(dep_delay_min) AS n_dep_delay, CAST(sum(dep_delay_min) AS BIGINT) AS sum_dep_delay,
       {count_if("arr_category IN ('Pontual', 'Antecipado')")} AS n_arr_on_time,
       count(arr_delay_min) AS n_arr_delay, CAST(sum(arr_delay_min) AS BIGINT) AS sum_arr_delay,
       {count_if("dep_category = 'Cancelado'")} AS n_no_actual,
       {count_if("dep_category = 'Sem horário previsto'")} AS n_no_schedule,
       {count_if("dep_category = 'Antecipado'")} AS n_early,
       {count_if("dep_category = 'Pontual'")} AS n_punctual,
       {count_if("dep_category = 'Atraso 30-60'")} AS n_late_30_60,
       {count_if("dep_category = 'Atraso 60-120'")} AS n_late_60_120,
       {count_if("dep_category = 'Atraso 120-240'")} AS n_late_120_240,
       {count_if("dep_category = 'Atraso > 240'")} AS n_late_240,
       min(sched_dep) AS first_sched_dep, max(sched_dep) AS last_sched_dep"""
    weekday = "CAST(weekday AS INTEGER) AS weekday"

    def cells(shown: str, keys: str) -> str:
        return on_rows(f"SELECT {shown}, {measures} FROM analytic GROUP BY {keys}")

    return {
        "flights": on_rows(f"SELECT {FLIGHT_COLUMNS} FROM flights"),
        "analytic_view": on_rows(f"SELECT {FLIGHT_COLUMNS}, {DERIVED_COLUMNS} FROM analytic"),
        "operational_view": on_kept(f"SELECT {FLIGHT_COLUMNS}, {DERIVED_COLUMNS} FROM kept"),
        "operational_view_95": on_kept(f"SELECT {FLIGHT_COLUMNS}, {DERIVED_COLUMNS} FROM kept", 95),
        "phantom_pairs": on_kept("SELECT origin, carrier FROM pairs"),
        "ingest_text_rows": on_rows(f"SELECT {FLIGHT_COLUMNS} FROM flights"),
        "rollup_cells": cells(
            f"ref_month, {weekday}, origin, dest, carrier", "ref_month, weekday, origin, dest, carrier"
        ),
        "rollup_origin_cells": cells(
            f"ref_month, {weekday}, origin, carrier", "ref_month, weekday, origin, carrier"
        ),
        "rollup_arrivals": cells("ref_month, dest", "ref_month, dest"),
        "rollup_pairs": on_rows(f"""SELECT ref_month, origin, carrier, {N} AS n,
       {count_if(CANCELLED)} AS n_cancelled FROM analytic GROUP BY ref_month, origin, carrier"""),
        "rollup_delay_histogram": on_rows("""SELECT ref_month, dep_delay_min, count(*) AS n
       FROM analytic WHERE dep_delay_min IS NOT NULL GROUP BY ref_month, dep_delay_min"""),
        "sql_view_by_carrier": on_kept(f"""SELECT carrier AS empresa, dep_category AS categoria_atraso_partida,
       {N} AS total_voos, {AVG} AS atraso_medio_min
       FROM kept WHERE ano = '2025' GROUP BY carrier, dep_category"""),
    }

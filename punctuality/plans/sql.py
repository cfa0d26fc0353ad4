"""Building blocks of the SQL that the registered queries are checked against."""

from __future__ import annotations

from punctuality.params import DEFAULT, DEPARTED, PERIODS, SCOPES, Params
from punctuality.sources.adapters import FLIGHTS_SQL

PERIOD_SQL = "CASE " + " ".join(f"WHEN hour_local < {b} THEN '{label}'" for label, _, b in PERIODS) + " END"
AIRLINE_SQL = "coalesce(nullif(airline_iata, ''), nullif(airline_icao, ''), nullif(airline_name, ''))"

FACTS_SQL = f"""facts AS (
  SELECT *, origin_iata || '-' || destination_iata AS route, {AIRLINE_SQL} AS airline_key, is_cancelled OR is_diverted OR status IN {DEPARTED} AS completed,
    is_diverted AND NOT is_cancelled AS diverted, NOT is_cancelled AND delay_minutes IS NULL AS unknown,
    CASE WHEN NOT is_cancelled AND delay_minutes IS NOT NULL THEN greatest(delay_minutes, 0) END AS lateness, CASE WHEN NOT is_cancelled THEN delay_minutes END AS raw_delay,
    {PERIOD_SQL} AS period, strftime(flight_date_local, '%Y-%m') AS month
  FROM flights WHERE NOT is_mock AND data_quality <> 'UNRELIABLE')"""

SCOPE_SQL = {
    "OVERALL": "'ALL'", "ROUTE": "route", "AIRLINE": "airline_key", "FLIGHT": "flight_number", "PERIOD": "period", "DOW": "CAST(dow_local AS VARCHAR)", "MONTH": "month",
    "ROUTE_PERIOD": "route || '|' || period", "ROUTE_AIRLINE": "route || '|' || airline_key",
}


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def facts(*parts: str) -> str:
    return with_(FLIGHTS_SQL, FACTS_SQL, *parts)


def aggregates(p: Params = DEFAULT) -> str:
    over = ", ".join(f"count(*) FILTER (lateness > {b}) AS delayed_gt_{b}" for b in p.buckets)
    return f"""count(*) AS total_flights, count(*) FILTER (completed) AS completed_flights, count(*) FILTER (is_cancelled) AS cancelled_flights, count(*) FILTER (diverted) AS diverted_flights,
  count(*) FILTER (lateness >= {p.delay_threshold}) AS delayed_flights, count(*) FILTER (lateness < {p.delay_threshold}) AS on_time_flights, count(*) FILTER (unknown) AS unknown_flights, {over},
  count(lateness) AS measurable_flights, CAST(sum(lateness) AS BIGINT) AS late_, quantile_cont(lateness, 0.5) AS p50_, quantile_cont(lateness, 0.9) AS p90_, max(raw_delay) AS max_delay_minutes"""


def half_even(total: str, n: str) -> str:
    return f"(CASE WHEN {n} > 0 THEN (100 * {total} // {n} + CASE WHEN 2 * (100 * {total} % {n}) > {n} OR (2 * (100 * {total} % {n}) = {n} AND (100 * {total} // {n}) % 2 = 1) THEN 1 ELSE 0 END) / 100.0 END)"


def block(name: str, source: str, keys: str, least: str, p: Params = DEFAULT) -> str:
    """CTEs that end in `name`: the metric block of source by keys, with its score."""
    part = lambda x: f"CASE WHEN {x} IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, {x})) END"
    inverse = lambda c, worst: f"CASE WHEN {c} IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0 - {c} / CAST({worst} AS DOUBLE))) END"
    score = f"{100 * p.weight_on_time} * {part('on_time_rate')} + {100 * p.weight_cancellation} * {inverse('cancellation_rate', p.worst_cancellation)} + {100 * p.weight_avg_delay} * {inverse('avg_delay_minutes', p.worst_avg_delay)} + {100 * p.weight_severe} * {inverse('severe_delay_rate', p.worst_severe)}"
    known = "total_flights > 0 AND completed_flights > 0 AND (measurable_flights > 0 OR cancelled_flights > 0)"
    comma = keys + ", " if keys else ""
    return f"""{name}_a AS (SELECT {comma}{aggregates(p)} FROM {source}{" GROUP BY ALL" if keys else ""}),
{name}_r AS (SELECT * EXCLUDE (late_, p50_, p90_), {half_even("late_", "measurable_flights")} AS avg_delay_minutes, round(p50_, 2) AS median_delay_minutes, round(p90_, 2) AS p90_delay_minutes,
  cancelled_flights / nullif(total_flights, 0) AS cancellation_rate, delayed_flights / nullif(measurable_flights, 0) AS delay_rate, on_time_flights / nullif(measurable_flights, 0) AS on_time_rate,
  delayed_gt_60 / nullif(measurable_flights, 0) AS severe_delay_rate FROM {name}_a),
{name} AS (SELECT *, CASE WHEN {known} THEN greatest(0.0, least(100.0, round(CAST({score} AS DOUBLE), 1))) END AS reliability_score,
  {known} AND total_flights >= {least} AND measurable_flights > 0 AS is_ranked FROM {name}_r)"""


def least_sample(p: Params = DEFAULT) -> str:
    return "CASE " + " ".join(f"WHEN scope = '{s}' THEN {p.least_sample(s)}" for s in SCOPES) + " END"


def keyed(scopes: tuple[str, ...] = SCOPES) -> str:
    """A CTE `keyed`: the facts once a scope, with scope and key."""
    return "keyed AS (" + " UNION ALL ".join(f"SELECT *, '{s}' AS scope, {SCOPE_SQL[s]} AS key FROM facts WHERE {SCOPE_SQL[s]} IS NOT NULL" for s in scopes) + ")"


def one_scope(scope: str, p: Params = DEFAULT) -> str:
    return facts(keyed((scope,)), block("b", "keyed", "scope, key", str(p.least_sample(scope)), p)) + "SELECT * FROM b"

"""Queries over the latest state of flights: filters, statistics, rankings, alerts and
report tables. Each is a Spark job and, beside it, the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctuality.operators import alerts, insights, metrics, population
from punctuality.params import AS_OF, DEFAULT, PERIODS, SCOPES, TODAY
from punctuality.plans import sql
from punctuality.sources import adapters

P = DEFAULT
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, text: str | None, job: Callable[[DataFrame], DataFrame]) -> None:
    """A query over flights; job is given the adapter's DataFrame."""
    QUERIES[name] = lambda spark, sf_dir: job(adapters.flights(spark, sf_dir))
    if text is not None:
        ORACLE[name] = text


def _d(x: date) -> str:
    return f"DATE '{x}'"


FACT = ("flight_id", "flight_number", "airline_iata", "airline_icao", "airline_name", "origin_iata", "destination_iata", "scheduled_departure_utc", "flight_date_local", "hour_local", "dow_local", "status", "delay_minutes", "is_cancelled", "is_diverted")
FACT_SQL = ", ".join(FACT)
POPULATION = "FROM flights WHERE NOT is_mock AND data_quality <> 'UNRELIABLE'"
MONTH_START, WEEK_START = TODAY.replace(day=1), TODAY - timedelta(days=P.history_days - 1)

# --- filters ---

register("base_facts", sql.with_(adapters.FLIGHTS_SQL) + f"SELECT {FACT_SQL} {POPULATION}", lambda f: metrics.base_facts(f).select(*FACT))
register(
    "facts_by_dates",
    sql.facts() + f"SELECT {FACT_SQL} FROM facts WHERE flight_date_local BETWEEN DATE '1999-01-01' AND DATE '1999-06-30' AND completed",
    lambda f: population.by_dates(f, date(1999, 1, 1), date(1999, 6, 30), completed=True).select(*FACT),
)
register(
    "facts_by_window",
    sql.facts() + f"SELECT {FACT_SQL} FROM facts WHERE scheduled_departure_utc >= TIMESTAMP '1999-01-01 00:00:00' AND scheduled_departure_utc < TIMESTAMP '1999-03-01 00:00:00'",
    lambda f: population.by_window(f, "1999-01-01 00:00:00", "1999-03-01 00:00:00").select(*FACT),
)
register(
    "day_board",
    sql.with_(adapters.FLIGHTS_SQL) + f"SELECT {FACT_SQL} {POPULATION} AND scheduled_departure_utc >= timezone('UTC', timezone('Europe/Istanbul', TIMESTAMP '{TODAY} 00:00:00')) AND scheduled_departure_utc < timezone('UTC', timezone('Europe/Istanbul', TIMESTAMP '{TODAY + timedelta(days=1)} 00:00:00')) ORDER BY scheduled_departure_utc, flight_id",
    lambda f: population.day_board(f, TODAY).select(*FACT),
)
register("facts_rolling", sql.facts() + f"SELECT {FACT_SQL} FROM facts WHERE flight_date_local BETWEEN {_d(WEEK_START)} AND {_d(TODAY)}", lambda f: population.rolling(f, P.history_days, TODAY).select(*FACT))
register(
    "window_mtd",
    sql.facts(sql.block("b", f"(SELECT * FROM facts WHERE flight_date_local BETWEEN {_d(MONTH_START)} AND {_d(TODAY)})", "", "10")) + "SELECT * FROM b",
    lambda f: metrics.block(population.by_dates(f, *population.resolve_window("mtd", TODAY)), least=P.min_flight),
)
register(
    "facts_filtered",
    sql.facts() + f"SELECT {FACT_SQL} FROM facts WHERE origin_iata = 'IST' AND destination_iata = 'IKA' AND airline_iata = 'A4'",
    lambda f: population.filtered(metrics.facts(f), route="IST-IKA", airline="A4").select(*FACT),
)
register(
    "list_flights",
    sql.with_(adapters.FLIGHTS_SQL) + f"SELECT {FACT_SQL}, total FROM (SELECT *, count(*) OVER () AS total FROM flights WHERE NOT is_mock AND status = 'DEPARTED' AND origin_iata = 'IST' AND destination_iata = 'MHD') ORDER BY scheduled_departure_utc DESC, flight_id DESC LIMIT 50 OFFSET 50",
    lambda f: population.listing(population.filtered(f, route="IST-MHD"), status="DEPARTED", page=2, size=50).select(*FACT, "total"),
)
QUERIES["monitored_only"] = lambda spark, d: population.monitored(adapters.flights(spark, d), adapters.routes(spark)).groupBy("origin_iata").agg(F.count("*").alias("n"), F.countDistinct("destination_iata").alias("destinations"))
ORACLE["monitored_only"] = sql.with_(adapters.FLIGHTS_SQL, adapters.ROUTES_SQL) + "SELECT origin_iata, count(*) AS n, count(DISTINCT destination_iata) AS destinations FROM flights SEMI JOIN routes USING (origin_iata, destination_iata) GROUP BY origin_iata"

# --- statistics ---

register("metrics_overall", sql.facts(sql.block("b", "facts", "", "1")) + "SELECT * FROM b", lambda f: metrics.block(metrics.facts(f)))
register(
    "delay_buckets",
    sql.facts(sql.block("b", "facts", "route", "1")) + " UNION ALL ".join(f"SELECT route, {b} AS bucket, round(delayed_gt_{b} / nullif(measurable_flights, 0), 4) AS share FROM b" for b in P.buckets),
    lambda f: insights.buckets(metrics.block(metrics.facts(f), "route"), "route"),
)
_RAW = ", ".join(f"{{'name': '{n}', 'raw': {n}}}" for n in ("on_time_rate", "cancellation_rate", "avg_delay_minutes", "severe_delay_rate"))
_SHARE = {"on_time_rate": ("greatest(0.0, least(1.0, raw))", 0.35), "cancellation_rate": ("greatest(0.0, least(1.0, 1.0 - raw / 0.25))", 0.3), "avg_delay_minutes": ("greatest(0.0, least(1.0, 1.0 - raw / 90.0))", 0.2), "severe_delay_rate": ("greatest(0.0, least(1.0, 1.0 - raw / 0.35))", 0.15)}
_NORM = "CASE WHEN raw IS NULL THEN 0.0 " + " ".join(f"WHEN name = '{n}' THEN {e}" for n, (e, _) in _SHARE.items()) + " END"
_WEIGHT = "CASE " + " ".join(f"WHEN name = '{n}' THEN CAST({w} AS DOUBLE)" for n, (_, w) in _SHARE.items()) + " END"
register(
    "reliability_components",
    sql.facts(sql.keyed(("AIRLINE",)), sql.block("b", "keyed", "scope, key", "20"), f"u AS (SELECT key, reliability_score, unnest([{_RAW}]) AS c FROM b)", "v AS (SELECT key, reliability_score, c.name AS name, c.raw AS raw FROM u)")
    + f"SELECT key, reliability_score, name, round(raw, 4) AS raw_value, round(CAST({_NORM} AS DOUBLE), 4) AS normalised, {_WEIGHT} AS weight, round(100 * {_WEIGHT} * {_NORM}, 2) AS contribution FROM v",
    lambda f: insights.score_parts(metrics.by_scope(metrics.facts(f), "AIRLINE")),
)
for _scope in SCOPES:
    register(f"by_{_scope.lower()}", sql.one_scope(_scope), lambda f, s=_scope: metrics.by_scope(metrics.facts(f), s))
register("all_scopes", sql.facts(sql.keyed(), sql.block("b", "keyed", "scope, key", sql.least_sample())) + "SELECT * FROM b", lambda f: metrics.by_scopes(metrics.facts(f)))
_ROUTE_OF = "CASE WHEN scope = 'ROUTE' THEN key WHEN scope IN ('ROUTE_PERIOD', 'ROUTE_AIRLINE') THEN split_part(key, '|', 1) END AS route"
register("daily_statistics", sql.facts(sql.keyed(), sql.block("b", "keyed", "flight_date_local, scope, key", sql.least_sample())) + f"SELECT *, {_ROUTE_OF} FROM b", lambda f: insights.daily(metrics.facts(f)))
_HOURLY = ("OVERALL", "ROUTE", "AIRLINE")
register("hourly_statistics", sql.facts(sql.keyed(_HOURLY), sql.block("b", "keyed", "flight_date_local, hour_local, scope, key", sql.least_sample())) + f"SELECT *, {_ROUTE_OF} FROM b", lambda f: insights.hourly(metrics.facts(f)))
register(
    "rebuild_counts",
    sql.facts(sql.keyed()) + "SELECT flight_date_local, count(DISTINCT scope || '/' || key) AS daily_rows, count(DISTINCT CASE WHEN scope IN ('OVERALL', 'ROUTE', 'AIRLINE') THEN scope || '/' || key || '/' || hour_local END) AS hourly_rows FROM keyed GROUP BY flight_date_local",
    lambda f: insights.rebuild_counts(metrics.facts(f)),
)
register(
    "aggregate_recent",
    sql.facts("recent AS (SELECT * FROM facts WHERE flight_date_local BETWEEN DATE '2001-07-31' AND DATE '2001-08-01')", sql.keyed().replace("FROM facts", "FROM recent"), sql.block("b", "keyed", "flight_date_local, scope, key", sql.least_sample())) + f"SELECT *, {_ROUTE_OF} FROM b",
    lambda f: insights.daily(population.rolling(f, 2, TODAY)),
)
register(
    "fold_hourly",
    sql.facts(sql.keyed(_HOURLY), sql.block("b", "keyed", "flight_date_local, hour_local, scope, key", "1"))
    + """SELECT key, hour_local, CAST(sum(total_flights) AS BIGINT) AS total_flights, CAST(sum(cancelled_flights) AS BIGINT) AS cancelled_flights, CAST(sum(delayed_flights) AS BIGINT) AS delayed_flights, CAST(sum(measurable_flights) AS BIGINT) AS measurable_flights,
  round(sum(CASE WHEN measurable_flights > 0 THEN avg_delay_minutes * measurable_flights END) / nullif(sum(measurable_flights), 0), 2) AS avg_delay_minutes, nullif(greatest(max(coalesce(max_delay_minutes, 0)), 0), 0) AS max_delay_minutes,
  sum(cancelled_flights) / sum(total_flights) AS cancellation_rate, sum(delayed_flights) / nullif(sum(measurable_flights), 0) AS delay_rate FROM b GROUP BY key, hour_local""",
    lambda f: insights.fold_hourly(insights.hourly(metrics.facts(f))),
)
register(
    "hour_profile",
    sql.facts(sql.block("b", "facts", "hour_local", "1"))
    + "SELECT CAST(h AS INTEGER) AS hour_local, coalesce(total_flights, 0) AS total_flights, coalesce(cancelled_flights, 0) AS cancelled_flights, coalesce(delayed_flights, 0) AS delayed_flights, avg_delay_minutes, cancellation_rate, delay_rate FROM range(24) t(h) LEFT JOIN b ON h = hour_local",
    lambda f: insights.hour_profile(metrics.facts(f)),
)
register("daily_series", sql.facts(sql.block("b", "facts", "flight_date_local", "1")) + "SELECT * FROM b", lambda f: metrics.block(metrics.facts(f), "flight_date_local"))
register(
    "summary",
    sql.facts(sql.block("b", "facts", "", "10")) + "SELECT *, " + ", ".join(f"round(delayed_gt_{b} / nullif(measurable_flights, 0), 4) AS share_gt_{b}" for b in P.buckets) + " FROM b",
    lambda f: insights.summary(metrics.facts(f)),
)
register(
    "rolling_summary",
    sql.facts(sql.block("b", f"(SELECT * FROM facts WHERE flight_date_local BETWEEN {_d(WEEK_START)} AND {_d(TODAY)})", "", "1")) + "SELECT * FROM b",
    lambda f: metrics.block(population.rolling(f, P.history_days, TODAY)),
)
_DAYS = 90
_TREND_PARTS = sql.block("b", f"(SELECT *, CASE WHEN flight_date_local > {_d(TODAY - timedelta(days=_DAYS))} THEN 'now' ELSE 'before' END AS part FROM facts WHERE flight_date_local BETWEEN {_d(TODAY - timedelta(days=2 * _DAYS - 1))} AND {_d(TODAY)})", "route, part", "1")
register(
    "trend_by_route",
    sql.facts(_TREND_PARTS, "n AS (SELECT * FROM b WHERE part = 'now')", "o AS (SELECT * FROM b WHERE part = 'before')")
    + """SELECT route, coalesce(n.total_flights, 0) AS total_now, coalesce(o.total_flights, 0) AS total_before, coalesce(n.total_flights, 0) - coalesce(o.total_flights, 0) AS total_delta,
  round(n.cancellation_rate - o.cancellation_rate, 4) AS cancellation_rate_delta, round(n.delay_rate - o.delay_rate, 4) AS delay_rate_delta, round(n.on_time_rate - o.on_time_rate, 4) AS on_time_rate_delta,
  round(n.avg_delay_minutes - o.avg_delay_minutes, 4) AS avg_delay_minutes_delta, coalesce(n.total_flights, 0) >= 10 AND coalesce(o.total_flights, 0) >= 10 AS sufficient_data FROM n FULL JOIN o USING (route)""",
    lambda f: insights.trend(metrics.facts(f), _DAYS, TODAY),
)
register(
    "repeat_cancellations",
    sql.facts()
    + """SELECT flight_number, arg_min(coalesce(airline_name, airline_key), (scheduled_departure_utc, flight_id)) FILTER (is_cancelled) AS airline, arg_min(route, (scheduled_departure_utc, flight_id)) FILTER (is_cancelled) AS route,
  printf('%02d:00', arg_min(hour_local, (scheduled_departure_utc, flight_id)) FILTER (is_cancelled)) AS scheduled_local_time, count(*) FILTER (is_cancelled) AS cancellations, count(*) AS scheduled_occasions,
  array_to_string(list_sort(list_distinct(list(CAST(flight_date_local AS VARCHAR)) FILTER (is_cancelled))), ',') AS dates, round(count(*) FILTER (is_cancelled) / count(*), 3) AS cancellation_rate
FROM facts GROUP BY flight_number HAVING count(*) FILTER (is_cancelled) >= 2""",
    lambda f: insights.repeat_cancellations(metrics.facts(f)).withColumn("dates", F.array_join(F.transform("dates", lambda x: x.cast("string")), ",")),
)

# --- rankings ---

_POSITION = "CAST(row_number() OVER (ORDER BY is_ranked DESC, coalesce(reliability_score, -1) DESC, total_flights DESC, key) AS INTEGER) AS position"
register("rank_scope", sql.facts(sql.keyed(("ROUTE_AIRLINE",)), sql.block("b", "keyed", "scope, key", "20")) + f"SELECT *, {_POSITION} FROM b", lambda f: insights.ranked(metrics.by_scope(metrics.facts(f), "ROUTE_AIRLINE")))
register(
    "rank_airlines",
    sql.facts(sql.keyed(("AIRLINE",)), sql.block("b", "keyed", "scope, key", "20"), "l AS (SELECT airline_key AS key, arg_max_null(coalesce(nullif(airline_name, ''), airline_key), (scheduled_departure_utc, flight_id)) AS label FROM facts WHERE airline_key IS NOT NULL GROUP BY airline_key)")
    + f"SELECT b.*, label, {_POSITION.replace('key)', 'b.key)')} FROM b JOIN l USING (key)",
    lambda f: insights.rank_airlines(metrics.facts(f)),
)
register(
    "rank_flights",
    sql.facts(sql.keyed(("FLIGHT",)), sql.block("b", "keyed", "scope, key", "10")) + f"SELECT * FROM (SELECT *, {_POSITION} FROM b) WHERE is_ranked",
    lambda f: insights.ranked(metrics.by_scope(metrics.facts(f), "FLIGHT")).where("is_ranked"),
)
_ORDER = "CASE period " + " ".join(f"WHEN '{label}' THEN {i}" for i, (label, _, _) in enumerate(PERIODS)) + " END"
_VERDICT_PARTS = (
    sql.block("tod", "facts", "route, period", "10"),
    f"p AS (SELECT *, {_ORDER} AS o FROM tod)",
    """v AS (SELECT route, count(*) FILTER (is_ranked) AS ranked, arg_max(period, (coalesce(reliability_score, 0), total_flights, -o)) FILTER (is_ranked) AS best,
    arg_max(period, (delay_rate, coalesce(reliability_score, 0), total_flights, -o)) FILTER (is_ranked AND delay_rate IS NOT NULL) AS late,
    arg_max(period, (cancellation_rate, coalesce(reliability_score, 0), total_flights, -o)) FILTER (is_ranked) AS gone FROM p GROUP BY route)""",
)
_VERDICT = """SELECT route, coalesce(ranked, 0) AS ranked_periods, CASE WHEN ranked >= 2 THEN best END AS best_period, CASE WHEN ranked >= 2 THEN late END AS worst_delay_period,
  CASE WHEN ranked >= 2 THEN gone END AS worst_cancellation_period,
  CASE WHEN ranked IS NULL THEN 'no_flights' WHEN ranked = 0 THEN 'none_ranked' WHEN ranked = 1 THEN 'one_ranked' WHEN best = late AND late = gone THEN 'all_alike' END AS note FROM """
QUERIES["time_of_day"] = lambda spark, d: insights.time_of_day(metrics.facts(adapters.flights(spark, d)), routes=adapters.routes(spark))
ORACLE["time_of_day"] = sql.facts(adapters.ROUTES_SQL, *_VERDICT_PARTS) + _VERDICT + "(SELECT DISTINCT origin_iata || '-' || destination_iata AS route FROM routes) FULL JOIN v USING (route)"
register(
    "best_worst_flight",
    sql.facts(sql.keyed(("FLIGHT",)), sql.block("b", "keyed", "scope, key", "10"), f"r AS (SELECT *, {_POSITION} FROM b)") + "SELECT CASE WHEN position = 1 THEN 'best' ELSE 'worst' END AS which, key, reliability_score, total_flights FROM r WHERE is_ranked AND position IN (1, (SELECT max(position) FROM r WHERE is_ranked))",
    lambda f: insights.best_and_worst(insights.ranked(metrics.by_scope(metrics.facts(f), "FLIGHT"))),
)

# --- alerts ---

_POP = f"pop AS (SELECT *, origin_iata || '-' || destination_iata AS route FROM flights WHERE NOT is_mock AND scheduled_departure_utc >= timezone('UTC', timezone('Europe/Istanbul', TIMESTAMP '{TODAY} 00:00:00')) AND scheduled_departure_utc <= TIMESTAMP '{AS_OF}' + INTERVAL 24 HOUR)"
_CANCEL = "SELECT 'CANCELLATION' AS alert_type, 'CANCELLATION:' || flight_number || ':' || flight_date_local AS dedup_key, flight_id, route FROM pop WHERE is_cancelled"
_DELAY = "SELECT 'DELAY_THRESHOLD' AS alert_type, 'DELAY_THRESHOLD:' || flight_number || ':' || flight_date_local || ':' || t AS dedup_key, flight_id, route FROM (SELECT *, unnest([60, 120]) AS t FROM pop) WHERE NOT is_cancelled AND status <> 'ARRIVED' AND delay_minutes >= t"
_BROKEN = "SELECT 'ROUTE_DISRUPTION' AS alert_type, 'ROUTE_DISRUPTION:' || route || ':' || flight_date_local || ':' || CAST(floor(count(*) FILTER (is_cancelled) / count(*) * 10) AS INTEGER) AS dedup_key, CAST(NULL AS BIGINT) AS flight_id, route FROM pop GROUP BY route, flight_date_local HAVING count(*) >= 4 AND count(*) FILTER (is_cancelled) / count(*) >= 0.2"
_ALL = f"built AS ({_CANCEL} UNION ALL {_DELAY} UNION ALL {_BROKEN})"
_LEDGER = "ledger AS (SELECT DISTINCT 'CANCELLATION:' || flight_number || ':' || flight_date_local AS dedup_key FROM flights WHERE is_cancelled AND flight_id % 3 = 0)"
register("alert_population", sql.with_(adapters.FLIGHTS_SQL, _POP) + f"SELECT {FACT_SQL}, data_quality FROM pop", lambda f: alerts.population(f, AS_OF).select(*FACT, "data_quality"))
register("alerts_cancellation", sql.with_(adapters.FLIGHTS_SQL, _POP) + _CANCEL, lambda f: alerts.cancellations(alerts.population(f, AS_OF)))
register("alerts_delay", sql.with_(adapters.FLIGHTS_SQL, _POP) + _DELAY, lambda f: alerts.delays(alerts.population(f, AS_OF)))
register("alerts_disruption", sql.with_(adapters.FLIGHTS_SQL, _POP.replace(f"AND scheduled_departure_utc >= timezone('UTC', timezone('Europe/Istanbul', TIMESTAMP '{TODAY} 00:00:00')) AND scheduled_departure_utc <= TIMESTAMP '{AS_OF}' + INTERVAL 24 HOUR", "")) + _BROKEN, lambda f: alerts.disruptions(f.where(~F.col("is_mock")).withColumn("route", F.concat_ws("-", "origin_iata", "destination_iata"))))


def _ledger(f: DataFrame) -> DataFrame:
    return f.where(F.col("is_cancelled") & (F.col("flight_id") % 3 == 0)).select(alerts.cancellation_key().alias("dedup_key")).distinct()


register("alerts_new", sql.with_(adapters.FLIGHTS_SQL, _POP, _ALL, _LEDGER) + "SELECT DISTINCT alert_type, dedup_key FROM built ANTI JOIN ledger USING (dedup_key)", lambda f: alerts.unsent(alerts.all_alerts(alerts.population(f, AS_OF)), _ledger(f)).select("alert_type", "dedup_key"))
register(
    "ledger_release",
    sql.with_(adapters.FLIGHTS_SQL) + "SELECT flight_id AS alert_id, CASE WHEN failed THEN key || '#failed:' || flight_id ELSE key END AS dedup_key, failed FROM (SELECT flight_id, 'CANCELLATION:' || flight_number || ':' || flight_date_local AS key, flight_id % 5 = 0 AS failed FROM flights WHERE is_cancelled)",
    lambda f: alerts.released(f.where("is_cancelled").select(F.col("flight_id").alias("alert_id"), alerts.cancellation_key().alias("dedup_key"), (F.col("flight_id") % 5 == 0).alias("failed"))),
)
register(
    "alert_tally",
    sql.with_(adapters.FLIGHTS_SQL, _POP, _ALL, _LEDGER, "n AS (SELECT alert_type, dedup_key, count(*) AS n FROM built GROUP BY ALL)")
    + "SELECT alert_type, CAST(sum(n) AS BIGINT) AS built, count(*) FILTER (sent IS NULL) AS new, CAST(sum(n) - count(*) FILTER (sent IS NULL) AS BIGINT) AS duplicate FROM (SELECT n.*, ledger.dedup_key AS sent FROM n LEFT JOIN ledger USING (dedup_key)) GROUP BY alert_type",
    lambda f: alerts.tally(alerts.all_alerts(alerts.population(f, AS_OF)), _ledger(f)),
)

# --- reports ---


def _today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.report_today(population.day_board(adapters.flights(spark, sf_dir), TODAY), adapters.routes(spark), adapters.airports(spark))


QUERIES["report_today"] = _today
ORACLE["report_today"] = (
    sql.facts(adapters.ROUTES_SQL, adapters.AIRPORTS_SQL, f"today AS (SELECT * FROM facts WHERE flight_date_local = {_d(TODAY)})", sql.block("b", "today", "route", "1"), "c AS (SELECT route, count(*) FILTER (status IN ('DEPARTED', 'ARRIVED', 'DIVERTED')) AS departed, count(*) FILTER (status IN ('SCHEDULED', 'BOARDING', 'DELAYED')) AS still_scheduled FROM today GROUP BY route)")
    + """SELECT r.origin_iata || '-' || r.destination_iata AS route, upper(coalesce(o.city, o.name, r.origin_iata)) || ' -> ' || upper(coalesce(d.city, d.name, r.destination_iata)) AS label, coalesce(total_flights, 0) AS total_flights, coalesce(cancelled_flights, 0) AS cancelled_flights, coalesce(delayed_flights, 0) AS delayed_flights,
  coalesce(departed, 0) AS departed, coalesce(still_scheduled, 0) AS still_scheduled, avg_delay_minutes, cancellation_rate FROM routes r LEFT JOIN b ON b.route = r.origin_iata || '-' || r.destination_iata LEFT JOIN c ON c.route = b.route LEFT JOIN airports o ON o.iata = r.origin_iata LEFT JOIN airports d ON d.iata = r.destination_iata"""
)
_ISSUE = """flight_id, flight_number, coalesce(airline_name, airline_iata, 'Unknown') AS airline, strftime(timezone('Europe/Istanbul', timezone('UTC', scheduled_departure_utc)), '%H:%M') AS scheduled_local,
  destination_iata, status, delay_minutes"""
register(
    "report_issues",
    sql.facts(f"today AS (SELECT * FROM facts WHERE flight_date_local = {_d(TODAY)})")
    + f"SELECT 'cancelled' AS issue, {_ISSUE} FROM today WHERE is_cancelled UNION ALL SELECT 'delayed' AS issue, {_ISSUE} FROM today WHERE NOT is_cancelled AND delay_minutes >= 15 AND status NOT IN ('DEPARTED', 'ARRIVED', 'DIVERTED')",
    lambda f: insights.issues(population.day_board(f, TODAY)),
)
_NAMED = "(SELECT DISTINCT origin_iata || '-' || destination_iata AS route FROM routes)"
_COUNTS = ", ".join(f"coalesce({c}, 0) AS {c}" for c in insights.COUNTS)
_FIGURES = ", ".join(insights.FIGURES)
_VERDICTS = ", ".join(insights.VERDICT)
QUERIES["report_history_routes"] = lambda spark, d: insights.history_routes(metrics.facts(adapters.flights(spark, d)), adapters.routes(spark))
ORACLE["report_history_routes"] = (
    sql.facts(adapters.ROUTES_SQL, sql.block("h", "facts", "route", "1"), *_VERDICT_PARTS, f"verdict AS ({_VERDICT}{_NAMED} FULL JOIN v USING (route))")
    + f"SELECT route, {_COUNTS}, {_FIGURES}, coalesce(is_ranked, false) AS is_ranked, {_VERDICTS} FROM {_NAMED} FULL JOIN h USING (route) LEFT JOIN verdict USING (route)"
)
_WINDOW = f"(SELECT * FROM facts WHERE flight_date_local BETWEEN {_d(TODAY - timedelta(days=_DAYS - 1))} AND {_d(TODAY)})"
_COMPARED = ", ".join(insights.COMPARED)
_TYPES = {"string": "VARCHAR", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
_NONE = lambda of: ", ".join(f"CAST(NULL AS {_TYPES[t]}) AS {c}" for c, t in of.items())
_WORDS = dict.fromkeys(("label", *insights.VERDICT), "string")
QUERIES["report_history"] = lambda spark, d: insights.history(metrics.facts(adapters.flights(spark, d)), _DAYS, TODAY, adapters.routes(spark), adapters.airports(spark))
ORACLE["report_history"] = (
    sql.facts(
        adapters.ROUTES_SQL,
        adapters.AIRPORTS_SQL,
        f"win AS {_WINDOW}",
        sql.block("every", "win", "", "1"),
        sql.block("route_", "win", "route", "1"),
        sql.block("air", "(SELECT *, airline_key AS key FROM win WHERE airline_key IS NOT NULL)", "key", "20"),
        *[part.replace(" FROM facts ", " FROM win ") for part in _VERDICT_PARTS],
        f"verdict AS ({_VERDICT}{_NAMED} FULL JOIN v USING (route))",
        "trend AS (TREND)",
    )
    + f"""SELECT 'overall' AS section, 'ALL' AS key, {_COUNTS}, {_FIGURES}, {_NONE(_WORDS | insights.COMPARED | {"position": "int"})} FROM every
UNION ALL SELECT 'route', r.route, {_COUNTS}, {_FIGURES}, label, {_VERDICTS}, {_COMPARED}, NULL
  FROM (SELECT DISTINCT origin_iata || '-' || destination_iata AS route,
      upper(coalesce(o.city, o.name, origin_iata)) || ' -> ' || upper(coalesce(d.city, d.name, destination_iata)) AS label
    FROM routes LEFT JOIN airports o ON o.iata = origin_iata LEFT JOIN airports d ON d.iata = destination_iata) r
  LEFT JOIN route_ ON route_.route = r.route LEFT JOIN verdict ON verdict.route = r.route LEFT JOIN trend ON trend.route = r.route
UNION ALL SELECT 'airline', key, {_COUNTS}, {_FIGURES}, {_NONE(_WORDS | insights.COMPARED)}, {_POSITION} FROM air"""
).replace("TREND", "SELECT * FROM (" + ORACLE["trend_by_route"] + ")")
register(
    "route_comparison",
    sql.facts(sql.block("b", "facts", "route", "1")) + "SELECT route, total_flights, cancellation_rate, delay_rate, avg_delay_minutes, reliability_score FROM b",
    lambda f: metrics.by_scope(metrics.facts(f), "ROUTE").select(F.col("key").alias("route"), "total_flights", "cancellation_rate", "delay_rate", "avg_delay_minutes", "reliability_score"),
)
register(
    "airline_key",
    sql.facts() + "SELECT airline_key, count(*) AS n FROM facts GROUP BY airline_key",
    lambda f: metrics.facts(f).groupBy("airline_key").agg(F.count("*").alias("n")),
)
register(
    "score_caveats",
    sql.facts(sql.keyed(("FLIGHT",)), sql.block("b", "keyed", "scope, key", "10"))
    + """SELECT key, CASE WHEN total_flights = 0 THEN 'no_flights' WHEN completed_flights = 0 THEN 'none_completed' WHEN reliability_score IS NULL THEN 'no_timing'
  WHEN NOT is_ranked AND total_flights < 10 THEN 'small_sample' WHEN NOT is_ranked THEN 'nothing_measured' END AS caveat FROM b""",
    lambda f: metrics.by_scope(metrics.facts(f), "FLIGHT").select("key", metrics.caveat(F.lit(P.min_flight)).alias("caveat")),
)

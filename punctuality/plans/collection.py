"""Queries over observations and provider calls: duplicates, merges, latest state, events,
staleness, health; and over scalar functions. Each beside the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctuality.functions import scalars
from punctuality.operators import alerts, history, providers
from punctuality.params import DEFAULT
from punctuality.plans import sql
from punctuality.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW = datetime(2024, 1, 30, 12, 0)


def over(name: str, table: Callable[[SparkSession, str], DataFrame], text: str, job: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: job(table(spark, sf_dir))
    ORACLE[name] = text


def observed(name: str, text: str, job: Callable[[DataFrame], DataFrame]) -> None:
    over(name, adapters.observations, sql.with_(adapters.OBSERVATIONS_SQL, _LEGS) + text, job)


FLIGHT = ", ".join(history.FLIGHT)
LEG = ", ".join(history.LEG)
_LEGS = """o AS (SELECT *, CAST(scheduled_departure_utc AS DATE) AS utc_day, CAST(actual_departure_utc IS NOT NULL AS INT) + CAST(estimated_departure_utc IS NOT NULL AS INT) + CAST(scheduled_arrival_utc IS NOT NULL AS INT) + CAST(terminal IS NOT NULL AS INT)
  + CAST(gate IS NOT NULL AS INT) + CAST(airline_iata IS NOT NULL AS INT) + CAST(actual_arrival_utc IS NOT NULL AS INT) + CAST(aircraft_type IS NOT NULL AS INT) + CASE WHEN status <> 'UNKNOWN' THEN 2 ELSE 0 END + CASE WHEN data_quality = 'OK' THEN 1 ELSE 0 END AS rich,
  CASE status WHEN 'UNKNOWN' THEN 0 WHEN 'SCHEDULED' THEN 1 WHEN 'BOARDING' THEN 2 WHEN 'DELAYED' THEN 3 WHEN 'DEPARTED' THEN 4 WHEN 'DIVERTED' THEN 5 WHEN 'CANCELLED' THEN 6 ELSE 7 END AS settled FROM observations)"""
_SHOWN = (*history.LEG, "observation_id", "status", "data_source")


def _first_row(keys: str, order: str) -> str:
    return f"SELECT {', '.join(_SHOWN)} FROM o QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1"


observed("dedup_richest", _first_row(LEG, "rich DESC, observed_at, observation_id"), lambda o: history.dedup_richest(history.legs(o)).select(*_SHOWN))
observed("dedup_first", _first_row(LEG, "observed_at, observation_id"), lambda o: history.dedup_first(history.legs(o)).select(*_SHOWN))
observed("dedup_settled", _first_row(LEG, "settled DESC, observed_at, observation_id"), lambda o: history.dedup_settled(history.legs(o)).select(*_SHOWN))
observed("best_per_source", _first_row(LEG + ", data_source", "rich DESC, observed_at, observation_id"), lambda o: history.best_per_source(history.legs(o)).select(*_SHOWN))

# --- merges ---

_FIELDS = history.FIELDS
_RANK = "CASE data_source WHEN 'primary' THEN 0 WHEN 'second' THEN 1 ELSE 2 END"


def _merge_sql(keys: str) -> str:
    """CTEs up to m: the records of each group as a list in the order of trust, each field
    the first in it that is known; a lone record as it is."""
    first = lambda c: f"list_filter(rs, lambda r: r.{c} IS NOT NULL)[1]"
    picks = ",\n  ".join(f"{first(c)}.{c} AS {c}, {first(c)}.data_source AS {c}_src" for c in _FIELDS)
    differs = lambda c: f"len(list_distinct(list_transform(list_filter(rs, lambda r: r.{c} IS NOT NULL), lambda r: date_trunc('minute', r.{c})))) > 1"
    split = lambda c: f"len(list_distinct(list_transform(rs, lambda r: r.{c}))) > 1"
    minutes = lambda a, b: f"CAST(date_diff('minute', {b}, {a}) AS INTEGER)"

    def delay(side: str, told: str) -> str:
        sched, est, act = f"scheduled_{side}_utc", f"estimated_{side}_utc", f"actual_{side}_utc"
        return f"CASE WHEN {sched} IS NOT NULL AND {act} IS NOT NULL THEN {minutes(act, sched)} WHEN {sched} IS NOT NULL AND {est} IS NOT NULL THEN {minutes(est, sched)} ELSE {told} END"

    return f"""grouped AS (SELECT {keys}, count(*) AS records, bool_or(NOT is_mock) AS any_real,
  list(o ORDER BY {_RANK}, observed_at, observation_id) AS every FROM o GROUP BY {keys}),
usable AS (SELECT {keys}, records, list_filter(every, lambda r: NOT r.is_mock OR NOT any_real) AS rs FROM grouped),
g AS (SELECT *, rs[1] AS base, len(rs) = 1 AS alone,
  {picks},
  {differs("actual_departure_utc")} AS c1, {differs("actual_arrival_utc")} AS c2, {split("is_cancelled")} AS c3, {split("is_diverted")} AS c4,
  list_filter(list_transform(rs, lambda r: r.delay_minutes), lambda x: x IS NOT NULL)[1] AS told,
  list_filter(list_transform(rs, lambda r: r.arrival_delay_minutes), lambda x: x IS NOT NULL)[1] AS told_arrival FROM usable),
d AS (SELECT *, {delay("departure", "told")} AS late, {delay("arrival", "told_arrival")} AS landed FROM g),
s AS (SELECT *, CASE WHEN alone THEN base.status WHEN base.is_cancelled THEN 'CANCELLED' WHEN base.is_diverted THEN 'DIVERTED' WHEN base.raw_status = 'cancelled' THEN 'CANCELLED'
  WHEN actual_arrival_utc IS NOT NULL THEN 'ARRIVED' WHEN actual_departure_utc IS NOT NULL THEN 'DEPARTED'
  WHEN base.raw_status IN ('scheduled', 'unknown') AND late >= 15 THEN 'DELAYED' ELSE upper(base.raw_status) END AS status FROM d),
t AS (SELECT *, CASE WHEN alone THEN base.delay_minutes WHEN status NOT IN ('CANCELLED', 'DIVERTED') THEN late END AS delay_minutes,
  CASE WHEN alone THEN base.arrival_delay_minutes WHEN status NOT IN ('CANCELLED', 'DIVERTED') THEN landed END AS arrival_delay_minutes FROM s),
m AS (SELECT *, CASE WHEN alone THEN base.is_cancelled ELSE base.is_cancelled OR status = 'CANCELLED' END AS is_cancelled,
  CASE WHEN alone THEN base.is_diverted ELSE base.is_diverted OR status = 'DIVERTED' END AS is_diverted, base.is_codeshare AS is_codeshare,
  array_to_string(list_transform(rs, lambda r: r.data_source), '+') AS data_source,
  CASE WHEN alone THEN base.data_quality WHEN delay_minutes NOT BETWEEN -180 AND 1440 THEN 'UNRELIABLE' WHEN status = 'UNKNOWN' THEN 'PARTIAL'
    WHEN status IN ('DEPARTED', 'ARRIVED', 'DIVERTED') AND delay_minutes IS NULL THEN 'PARTIAL' WHEN scheduled_arrival_utc IS NULL THEN 'PARTIAL' ELSE 'OK' END AS data_quality,
  CASE WHEN alone THEN [] ELSE list_filter([CASE WHEN c1 THEN 'actual_departure_utc' END, CASE WHEN c2 THEN 'actual_arrival_utc' END, CASE WHEN c3 THEN 'is_cancelled' END,
    CASE WHEN c4 THEN 'is_diverted' END], lambda x: x IS NOT NULL) END AS conflicts FROM t) """


_MERGED = _merge_sql(LEG)


def _merged(o: DataFrame) -> DataFrame:
    return history.merge(history.legs(o))


_OUT = (*history.LEG, *_FIELDS, "status", "delay_minutes", "arrival_delay_minutes", "is_cancelled", "is_diverted", "is_codeshare", "data_quality", "data_source")


def _with_more(text: str, select: str) -> str:
    return sql.with_(adapters.OBSERVATIONS_SQL, _LEGS, text) + select


over("merge_records", adapters.observations, _with_more(_MERGED, f"SELECT {', '.join(_OUT)} FROM m"), lambda o: _merged(o).select(*_OUT))
_DERIVED = ("is_cancelled", "is_diverted", "status", "delay_minutes")
over(
    "merge_provenance",
    adapters.observations,
    _with_more(
        _MERGED,
        f"""SELECT {LEG}, field, source FROM (SELECT {LEG}, unnest({[*_FIELDS, *_DERIVED]}) AS field,
  unnest([{', '.join(f"CASE WHEN alone THEN base.data_source ELSE {c}_src END" for c in _FIELDS)},
    {', '.join(f"CASE WHEN NOT alone THEN base.data_source END" for _ in _DERIVED[:2])}, {', '.join("CASE WHEN NOT alone THEN 'derived' END" for _ in _DERIVED[2:])}]) AS source FROM m)
WHERE source IS NOT NULL""",
    ),
    lambda o: _merged(o).select(*history.LEG, F.explode("field_sources").alias("field", "source")),
)
over(
    "merge_conflicts",
    adapters.observations,
    _with_more(_MERGED, f"SELECT {LEG}, unnest(conflicts) AS conflict FROM m"),
    lambda o: _merged(o).select(*history.LEG, F.explode("conflicts").alias("conflict")),
)
over(
    "merge_summary",
    adapters.observations,
    _with_more(
        _MERGED, "SELECT (SELECT count(*) FROM o) AS input_records, count(*) AS merged_flights, count(*) FILTER (records > 1) AS enriched, CAST(sum(len(conflicts)) AS BIGINT) AS conflicts FROM m"
    ),
    lambda o: history.merge_summary(o, _merged(o)),
)

# --- state and events ---

_T = "(observed_at, observation_id)"
_KNOWN = lambda c: f"{c} IS NOT NULL AND CAST({c} AS VARCHAR) <> ''"


def _state_sql(name: str, source: str) -> str:
    """The rule in order: what the last record says, what the last that knows says."""
    last = ", ".join(f"arg_max_null({c}, {_T}) AS {c}" for c in history.OVERWRITTEN)
    known = ", ".join(f"arg_max({c}, {_T}) FILTER ({_KNOWN(c)}) AS {c}" for c in history.STICKY)
    at = "timezone('Europe/Istanbul', timezone('UTC', scheduled_departure_utc))"
    return f"""{name} AS (SELECT *, CAST(hour({at}) AS INTEGER) AS scheduled_hour_local, CAST(isodow({at}) AS INTEGER) AS scheduled_dow_local FROM (
  SELECT {FLIGHT}, {last}, {known}, arg_min(scheduled_departure_utc, {_T}) AS first_scheduled_departure_utc, min(observed_at) AS first_seen_at, max(observed_at) AS last_seen_at,
    bool_and(is_mock) AS is_mock, count(*) AS observation_count FROM {source} GROUP BY {FLIGHT}))"""


_STATE = _state_sql("state", "observations")
over("latest_state", adapters.observations, sql.with_(adapters.OBSERVATIONS_SQL, _STATE) + "SELECT * FROM state", history.latest_state)
over(
    "append_observations", adapters.observations,
    sql.with_(adapters.OBSERVATIONS_SQL) + f"SELECT observation_id, {FLIGHT}, run_id, data_source FROM (SELECT * FROM observations WHERE observed_at >= TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY {FLIGHT}, run_id, data_source ORDER BY observed_at, observation_id) = 1) n ANTI JOIN (SELECT * FROM observations WHERE observed_at < TIMESTAMP '2024-01-20' OR event_time_odd(observation_id)) h USING ({FLIGHT}, run_id, data_source)".replace("event_time_odd(observation_id)", "observation_id % 4 = 1"),
    lambda o: history.append_observations(o.where("observed_at >= timestamp_ntz'2024-01-20 00:00:00'"), o.where("observed_at < timestamp_ntz'2024-01-20 00:00:00' or observation_id % 4 = 1")).select("observation_id", *history.FLIGHT, "run_id", "data_source"),
)
over(
    "backfill_first_schedule", adapters.observations,
    sql.with_(adapters.OBSERVATIONS_SQL, _STATE) + f"SELECT {FLIGHT}, coalesce(least_, s.scheduled_departure_utc) AS first_scheduled_departure_utc FROM state s LEFT JOIN (SELECT {FLIGHT}, min(scheduled_departure_utc) AS least_ FROM observations GROUP BY {FLIGHT}) USING ({FLIGHT})",
    lambda o: history.first_schedule(history.latest_state(o), o).select(*history.FLIGHT, "first_scheduled_departure_utc"),
)
_AIRLINES = f"""a AS (SELECT airline_iata AS iata, airline_icao AS icao, airline_name AS name, {_T} AS told FROM observations WHERE airline_iata IS NOT NULL OR airline_icao IS NOT NULL),
pair AS (SELECT icao, arg_min(iata, told) AS owner FROM a WHERE iata IS NOT NULL AND icao IS NOT NULL GROUP BY icao),
known AS (SELECT a.*, coalesce(iata, pair.owner, 'icao ' || a.icao) AS key FROM a LEFT JOIN pair ON a.icao = pair.icao),
air AS (SELECT arg_min(iata, told) FILTER (iata IS NOT NULL) AS iata, arg_min(icao, told) FILTER (icao IS NOT NULL) AS icao, arg_max(name, told) AS name FROM known GROUP BY key)"""
over("discover_airlines", adapters.observations, sql.with_(adapters.OBSERVATIONS_SQL, _AIRLINES) + "SELECT * FROM air", history.airlines)
over("list_airlines", adapters.observations, sql.with_(adapters.OBSERVATIONS_SQL, _AIRLINES) + "SELECT * FROM air ORDER BY name, iata", lambda o: history.airlines(o).orderBy("name", "iata"))
_W = f"OVER (PARTITION BY {FLIGHT} ORDER BY observed_at, observation_id)"
observed("prev_observation", f"SELECT observation_id, lag(observation_id) {_W} AS previous_id, lag(status) {_W} AS previous_status FROM observations", lambda o: history.with_previous(o).select("observation_id", F.col("prev.observation_id").alias("previous_id"), F.col("prev.status").alias("previous_status")))
_PREV = ", ".join(f"lag({c}) {_W} AS p_{c}" for c in ("observation_id", "status", "delay_minutes", "gate", "terminal", "scheduled_departure_utc"))
_EV = lambda when, kind, old, new: f"SELECT {FLIGHT}, observation_id, observed_at AS occurred_at, data_source, {kind} AS event_type, {old} AS previous_value, {new} AS new_value FROM w WHERE {when}"
_HAD, _ISO = "p_observation_id IS NOT NULL", "strftime({}, '%Y-%m-%dT%H:%M:%S')"
_EVENTS = " UNION ALL ".join(
    [
        _EV("p_observation_id IS NULL", "'FIRST_SEEN'", "NULL", "status"), _EV("p_observation_id IS NULL AND status = 'CANCELLED'", "'CANCELLED'", "NULL", "status"), _EV(f"{_HAD} AND p_status <> status", "'STATUS_CHANGED'", "p_status", "status"),
        _EV(f"{_HAD} AND p_status <> status AND status IN ('CANCELLED', 'DIVERTED', 'DEPARTED', 'ARRIVED')", "status", "p_status", "status"), _EV("delay_minutes - p_delay_minutes >= 5", "'DELAY_INCREASED'", "CAST(p_delay_minutes AS VARCHAR)", "CAST(delay_minutes AS VARCHAR)"),
        _EV("delay_minutes - p_delay_minutes <= -5", "'DELAY_DECREASED'", "CAST(p_delay_minutes AS VARCHAR)", "CAST(delay_minutes AS VARCHAR)"), _EV(f"{_HAD} AND p_delay_minutes IS NULL AND delay_minutes >= 15", "'DELAY_INCREASED'", "NULL", "CAST(delay_minutes AS VARCHAR)"),
        _EV(f"{_HAD} AND gate <> '' AND gate IS DISTINCT FROM p_gate", "'GATE_CHANGED'", "p_gate", "gate"), _EV(f"{_HAD} AND terminal <> '' AND terminal IS DISTINCT FROM p_terminal", "'TERMINAL_CHANGED'", "p_terminal", "terminal"),
        _EV(f"{_HAD} AND p_scheduled_departure_utc <> scheduled_departure_utc", "'SCHEDULE_CHANGED'", _ISO.format("p_scheduled_departure_utc"), _ISO.format("scheduled_departure_utc")),
    ]
)
over("derive_events", adapters.observations, sql.with_(adapters.OBSERVATIONS_SQL, f"w AS (SELECT *, {_PREV} FROM observations)") + _EVENTS, history.derive_events)


def _stale(o: DataFrame) -> DataFrame:
    seen = o.where("observed_at >= timestamp_ntz'2024-01-30 00:00:00'").select(*history.FLIGHT).distinct()
    return history.mark_stale(history.latest_state(o), seen, o.where("observed_at >= timestamp_ntz'2024-01-30 00:00:00'").select("origin_iata").distinct(), NOW).select(*history.FLIGHT, "status", "data_quality", "event_type")


over(
    "mark_stale", adapters.observations,
    sql.with_(adapters.OBSERVATIONS_SQL, _STATE) + f"SELECT {FLIGHT}, status, 'STALE' AS data_quality, 'WENT_STALE' AS event_type FROM state ANTI JOIN (SELECT * FROM observations WHERE observed_at >= TIMESTAMP '2024-01-30') USING ({FLIGHT}) WHERE last_seen_at < TIMESTAMP '{NOW}' - INTERVAL 180 MINUTE AND data_quality <> 'STALE' AND status NOT IN ('DEPARTED', 'ARRIVED', 'CANCELLED', 'DIVERTED') AND origin_iata IN (SELECT origin_iata FROM observations WHERE observed_at >= TIMESTAMP '2024-01-30')",
    _stale,
)
over(
    "history_counts",
    adapters.observations,
    sql.with_(adapters.OBSERVATIONS_SQL, _AIRLINES, f"w AS (SELECT *, {_PREV} FROM observations)")
    + f"""SELECT 'airlines' AS table_name, count(*) AS n FROM air UNION ALL SELECT 'flights', count(*) FROM (SELECT DISTINCT {FLIGHT} FROM observations)
UNION ALL SELECT 'observations', count(*) FROM observations UNION ALL SELECT 'events', count(*) FROM ({_EVENTS}) UNION ALL SELECT 'runs', count(DISTINCT run_id) FROM observations""",
    lambda o: history.count_rows(history.tables(o)),
)


def _imported(o: DataFrame) -> DataFrame:
    kept = history.importable(history.tables(o), o.limit(0))
    seen = kept["observations"].select(F.lit("observations").alias("table_name"), "observation_id", F.lit(None).cast("string").alias("event_type"))
    return seen.unionByName(kept["events"].select(F.lit("events").alias("table_name"), "observation_id", "event_type"))


over(
    "import_history",
    adapters.observations,
    sql.with_(adapters.OBSERVATIONS_SQL, f"w AS (SELECT *, {_PREV} FROM observations)", f"kept AS (SELECT {FLIGHT} FROM observations GROUP BY {FLIGHT} HAVING NOT bool_and(is_mock))")
    + f"""SELECT 'observations' AS table_name, observation_id, CAST(NULL AS VARCHAR) AS event_type FROM observations SEMI JOIN kept USING ({FLIGHT})
UNION ALL SELECT 'events', observation_id, event_type FROM ({_EVENTS}) SEMI JOIN kept USING ({FLIGHT})""",
    _imported,
)
over(
    "flight_displacement",
    adapters.observations,
    sql.with_(adapters.OBSERVATIONS_SQL, _STATE)
    + f"""SELECT {FLIGHT}, moved AS schedule_moved_minutes, CASE WHEN moved IS NOT NULL OR delay_minutes IS NOT NULL THEN coalesce(moved, 0) + coalesce(delay_minutes, 0) END AS total_displacement_minutes
FROM (SELECT *, CAST(floor((epoch(scheduled_departure_utc) - epoch(first_scheduled_departure_utc)) / 60) AS INTEGER) AS moved FROM state)""",
    lambda o: history.displacement(history.latest_state(o)).select(*history.FLIGHT, "schedule_moved_minutes", "total_displacement_minutes"),
)
over(
    "report_keys",
    adapters.observations,
    sql.with_(
        adapters.OBSERVATIONS_SQL,
        "due AS (SELECT DISTINCT timezone('Europe/Istanbul', timezone('UTC', observed_at)) AS t, observation_id FROM observations)",
        "built AS (SELECT DISTINCT 'HOURLY_REPORT' AS alert_type, strftime(t, 'HOURLY_REPORT:%Y-%m-%d %H') AS dedup_key FROM due UNION ALL SELECT DISTINCT 'DAILY_REPORT', strftime(t, 'DAILY_REPORT:%Y-%m-%d') FROM due)",
        "sent AS (SELECT DISTINCT strftime(t, 'HOURLY_REPORT:%Y-%m-%d %H') AS dedup_key FROM due WHERE observation_id % 9 = 0)",
    )
    + "SELECT * FROM built ANTI JOIN sent USING (dedup_key)",
    lambda o: alerts.unsent(alerts.report_keys(o, "observed_at"), alerts.report_keys(o.where("observation_id % 9 = 0"), "observed_at").where("alert_type = 'HOURLY_REPORT'").select("dedup_key")).select("alert_type", "dedup_key"),
)
_KEPT = f"""kept AS (SELECT * FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY {LEG}, run_id, data_source ORDER BY rich DESC, observed_at, observation_id) = 1)
  QUALIFY row_number() OVER (PARTITION BY {FLIGHT}, run_id, data_source ORDER BY observed_at, observation_id) = 1)"""
_ORIGINS = ("IST", "IKA")
over(
    "run_summary",
    adapters.observations,
    sql.with_(
        adapters.OBSERVATIONS_SQL,
        _LEGS,
        _merge_sql(f"run_id, {LEG}"),
        _KEPT,
        f"w AS (SELECT *, {_PREV} FROM kept)",
        f"e AS (SELECT run_id, count(*) AS n, count(*) FILTER (event_type = 'CANCELLED') AS gone, count(*) FILTER (event_type = 'DELAY_INCREASED') AS late FROM ({_EVENTS}) JOIN (SELECT observation_id, run_id FROM kept) USING (observation_id) GROUP BY run_id)",
        f"due AS (SELECT row_number() OVER () AS i, origin_iata, status, observed_at + INTERVAL 180 MINUTE AS due, lead(observed_at) {_W} AS next FROM observations)",
        "fin AS (SELECT origin_iata, run_id, max(observed_at) AS finished FROM observations GROUP BY ALL)",
        """gone_ AS (SELECT run_id, count(*) AS n FROM (SELECT i, next, min(finished) AS finished, arg_min(run_id, (finished, run_id)) AS run_id FROM due JOIN fin USING (origin_iata)
    WHERE finished > due AND status NOT IN ('DEPARTED', 'ARRIVED', 'CANCELLED', 'DIVERTED') GROUP BY i, next) WHERE next IS NULL OR next > finished GROUP BY run_id)""",
        f"made AS (SELECT run_id, count(*) AS n FROM (SELECT min(run_id) AS run_id FROM observations GROUP BY {FLIGHT}) GROUP BY run_id)",
        "k AS (SELECT run_id, count(*) AS n, count(DISTINCT data_source) AS providers FROM kept GROUP BY run_id)",
        "r AS (SELECT run_id, count(*) AS seen, CAST(sum(records) AS BIGINT) AS raw, count(*) FILTER (records > 1) AS enriched, CAST(sum(len(conflicts)) AS BIGINT) AS conflicts FROM m GROUP BY run_id)",
    )
    + """SELECT run_id, seen AS flights_seen, raw - seen AS duplicates_skipped, enriched AS enriched_flights, 'IKA' AS missing_origins, coalesce(made.n, 0) AS flights_created,
  k.n AS observations_written, providers, coalesce(e.n, 0) AS events_written, coalesce(gone, 0) AS cancellations_detected, coalesce(late, 0) AS delays_detected,
  conflicts AS merge_conflicts, seen - coalesce(made.n, 0) AS flights_updated, coalesce(gone_.n, 0) AS stale_marked
FROM r JOIN k USING (run_id) LEFT JOIN made USING (run_id) LEFT JOIN e USING (run_id) LEFT JOIN gone_ USING (run_id)""",
    lambda o: history.run_summary(o, _ORIGINS),
)
observed(
    "recent_runs", "SELECT run_id, max(observed_at) AS finished_at, count(*) AS n FROM observations GROUP BY run_id ORDER BY run_id DESC LIMIT 20",
    lambda o: o.groupBy("run_id").agg(F.max("observed_at").alias("finished_at"), F.count("*").alias("n")).orderBy(F.desc("run_id")).limit(20),
)
observed(
    "collection_status", f"SELECT max(run_id) AS last_run, max(observed_at) AS last_at, date_diff('minute', max(observed_at), TIMESTAMP '{NOW}') > 120 AS is_stale FROM observations",
    lambda o: o.agg(F.max("run_id").alias("last_run"), F.max("observed_at").alias("last_at")).withColumn("is_stale", scalars.minutes_between(F.lit(str(NOW)).cast("timestamp_ntz"), F.col("last_at")) > 120),
)
#: Failures in a row and rest that make a difference between hourly runs.
_RESTS = replace(DEFAULT, provider_failures=2, provider_recovery_s=7200)
# Of each run, origin and source the call that told of it, and by the rules of failover what the calls of the
# same source before say: the pause that the last rate-limited call since the last success asked for, and failures since.
_CALLED = f"""call AS (SELECT run_id, origin_iata, data_source, min(observation_id) AS call_id, min(observed_at) AS called_at, arg_min(status, (observed_at, observation_id)) <> 'CANCELLED' AS ok
    FROM observations GROUP BY ALL),
log AS (SELECT *, NOT ok AND call_id % 2 = 0 AS limited, CASE WHEN call_id % 4 = 0 THEN 10800 ELSE {_RESTS.provider_recovery_s} END AS pause FROM call),
before AS (SELECT a.call_id AS attempt, a.called_at AS asked_at, c.* FROM log a LEFT JOIN log c ON c.data_source = a.data_source AND c.called_at < a.called_at),
worked AS (SELECT attempt, max((called_at, call_id)) FILTER (ok) AS last_ok FROM before GROUP BY attempt),
since AS (SELECT * FROM before JOIN worked USING (attempt) WHERE call_id IS NOT NULL AND NOT ok AND (last_ok IS NULL OR (called_at, call_id) > last_ok)),
rest AS (SELECT attempt FROM since GROUP BY attempt, asked_at
    HAVING arg_max(called_at + to_seconds(pause), (called_at, call_id)) FILTER (limited) > asked_at
      OR (count(*) >= {_RESTS.provider_failures} AND asked_at <= max(called_at) + to_seconds({_RESTS.provider_recovery_s}))),
answer AS (SELECT *, call_id IN (SELECT attempt FROM rest) AS paused FROM log)"""
over(
    "provider_rests",
    adapters.observations,
    sql.with_(adapters.OBSERVATIONS_SQL, _CALLED) + "SELECT call_id, data_source, called_at, ok, paused FROM answer",
    lambda o: _answers(o).select(F.col("attempt").alias("call_id"), F.col("provider").alias("data_source"), F.col("at").alias("called_at"), "ok", "paused"),
)
over(
    "failover_select",
    adapters.observations,
    sql.with_(
        adapters.OBSERVATIONS_SQL,
        _CALLED,
        f"took AS (SELECT run_id, origin_iata, arg_min(data_source, {_RANK}) AS data_source FROM answer WHERE ok AND NOT paused GROUP BY ALL)",
    )
    + "SELECT observation_id FROM observations SEMI JOIN took USING (run_id, origin_iata, data_source)",
    lambda o: _failover(o).select("observation_id"),
)
observed(
    "flight_history",
    """SELECT flight_number, flight_date_local, status, scheduled_departure_utc, count(*) OVER (PARTITION BY flight_number) AS total FROM (SELECT flight_number, flight_date_local,
  arg_max_null(status, (observed_at, observation_id)) AS status, arg_max_null(scheduled_departure_utc, (observed_at, observation_id)) AS scheduled_departure_utc FROM observations GROUP BY ALL)
WHERE flight_number = 'U7' ORDER BY scheduled_departure_utc DESC""",
    lambda o: _flight_history(history.latest_state(o), " u7"),
)
over(
    "provider_health",
    adapters.calls,
    sql.with_(adapters.CALLS_SQL, "k AS (SELECT provider, max((called_at, call_id)) FILTER (ok) AS last_ok FROM calls GROUP BY provider)")
    + """SELECT *, consecutive_failures < 3 AS healthy, CASE WHEN consecutive_failures >= 3 THEN greatest(cooldown_until, last_failure_at + INTERVAL 900 SECOND) ELSE cooldown_until END AS open_at
FROM (SELECT provider, count(*) AS total_calls, count(*) FILTER (NOT ok) AS total_failures, count(*) FILTER (NOT ok AND (last_ok IS NULL OR (called_at, call_id) > last_ok)) AS consecutive_failures,
  max(called_at) FILTER (ok) AS last_success_at, max(called_at) FILTER (NOT ok) AS last_failure_at,
  arg_max(called_at + to_seconds(coalesce(retry_after_s, 900)), (called_at, call_id)) FILTER (rate_limited AND (last_ok IS NULL OR (called_at, call_id) > last_ok)) AS cooldown_until
  FROM calls JOIN k USING (provider) GROUP BY provider)""",
    history.provider_health,
)


def _answers(o: DataFrame) -> DataFrame:
    """The call that each run, origin and source stands for, and whether the source rested then. A
    board whose first row is a cancellation stands for a call that failed, one with an even
    number for one that was rate-limited."""
    first = F.min_by("status", F.struct("observed_at", "observation_id"))
    calls = o.groupBy("run_id", "origin_iata", F.col("data_source").alias("provider")).agg(
        F.min("observation_id").alias("call_id"), F.min("observed_at").alias("called_at"), (first != "CANCELLED").alias("ok")
    )
    limited = ~F.col("ok") & (F.col("call_id") % 2 == 0)
    log = calls.withColumns({"rate_limited": limited, "retry_after_s": F.when(F.col("call_id") % 4 == 0, 10800)})
    return providers.answers(calls.select(F.col("call_id").alias("attempt"), "provider", F.col("called_at").alias("at"), "run_id", "origin_iata", "ok"), log, _RESTS)


def _failover(o: DataFrame) -> DataFrame:
    """Rows of the source that each run and origin took."""
    took = history.failover(_answers(o).withColumnRenamed("provider", "data_source"))
    return o.join(took, ["run_id", "origin_iata", "data_source"], "left_semi")


def _flight_history(state: DataFrame, number: str) -> DataFrame:
    """The flights of one number, however it is written, newest first, with their total."""
    rows = state.where(F.col("flight_number") == scalars.flight_number(F.lit(number)))
    totals = rows.groupBy("flight_number").agg(F.count("*").alias("total"))
    return rows.join(totals, "flight_number").select("flight_number", "flight_date_local", "status", "scheduled_departure_utc", "total").orderBy(F.desc("scheduled_departure_utc"))


# --- scalars ---


def flown(name: str, text: str, job: Callable[[DataFrame], DataFrame]) -> None:
    over(name, adapters.flights, sql.with_(adapters.FLIGHTS_SQL) + text, job)


flown(
    "local_projection", "SELECT flight_id, CAST(timezone('Asia/Tehran', timezone('UTC', scheduled_departure_utc)) AS DATE) AS local_date, CAST(hour(timezone('Asia/Tehran', timezone('UTC', scheduled_departure_utc))) AS INTEGER) AS local_hour, CAST(isodow(timezone('Asia/Tehran', timezone('UTC', scheduled_departure_utc))) AS INTEGER) AS local_dow, strftime(timezone('Asia/Tehran', timezone('UTC', scheduled_departure_utc)), '%Y-%m-%d %H:%M') AS local_text FROM flights",
    lambda f: f.withColumn("l", scalars.local(F.col("scheduled_departure_utc"), "Asia/Tehran")).select("flight_id", F.to_date("l").alias("local_date"), F.hour("l").alias("local_hour"), (F.weekday("l") + 1).alias("local_dow"), F.date_format("l", "yyyy-MM-dd HH:mm").alias("local_text")),
)
flown(
    "day_bounds", "SELECT DISTINCT flight_date_local AS day, timezone('UTC', timezone('Europe/Istanbul', CAST(flight_date_local AS TIMESTAMP))) AS start_utc, timezone('UTC', timezone('Europe/Istanbul', CAST(flight_date_local + 1 AS TIMESTAMP))) AS end_utc FROM flights",
    lambda f: f.select(F.col("flight_date_local").alias("day")).distinct().select("day", scalars.assume_zone(F.col("day").cast("timestamp_ntz"), "Europe/Istanbul").alias("start_utc"), scalars.assume_zone(F.date_add("day", 1).cast("timestamp_ntz"), "Europe/Istanbul").alias("end_utc")),
)
flown(
    "scalar_assume_tz", "SELECT flight_id, timezone('UTC', timezone('Asia/Dubai', CASE WHEN flight_id % 5 > 0 THEN scheduled_departure_utc END)) AS utc FROM flights",
    lambda f: f.select("flight_id", scalars.assume_zone(F.when(F.col("flight_id") % 5 > 0, F.col("scheduled_departure_utc")), "Asia/Dubai").alias("utc")),
)
flown(
    "norm_flight_number", "SELECT flight_id, upper(regexp_replace(raw, '\\s+', '', 'g')) AS seen, CASE WHEN flight_id % 11 = 0 THEN NULL ELSE 'TK' || (flight_id % 900) || CASE WHEN flight_id % 7 = 0 THEN 'A' ELSE '' END END AS number FROM (SELECT *, CASE WHEN flight_id % 11 = 0 THEN ' ' ELSE ' tk 0' || (flight_id % 900) || CASE WHEN flight_id % 7 = 0 THEN 'a ' ELSE '' END END AS raw FROM flights)".replace("\\s", "[ ]"),
    lambda f: f.withColumn("raw", F.when(F.col("flight_id") % 11 == 0, " ").otherwise(F.concat(F.lit(" tk 0"), (F.col("flight_id") % 900).cast("string"), F.when(F.col("flight_id") % 7 == 0, "a ").otherwise("")))).select("flight_id", F.upper(F.regexp_replace("raw", "[ ]+", "")).alias("seen"), scalars.flight_number(F.col("raw")).alias("number")),
)
_RAWS = {
    "Planned": "SCHEDULED",
    "on-time": "SCHEDULED",
    "In Flight (climbing)": "DEPARTED",
    "CANCELED by carrier": "CANCELLED",
    "final call": "BOARDING",
    "Landed at stand 4": "ARRIVED",
    "no idea": "UNKNOWN",
    "will divert south": "DIVERTED",
    "not operational": "CANCELLED",
    "Filed 13:05": "SCHEDULED",
    "Rescheduled": "DELAYED",
}
flown(
    "norm_status", f"SELECT flight_id, {list(_RAWS)}[flight_id % {len(_RAWS)} + 1] AS raw, {list(_RAWS.values())}[flight_id % {len(_RAWS)} + 1] AS status FROM flights",
    lambda f: f.select("flight_id", F.element_at(F.array(*map(F.lit, _RAWS)), (F.col("flight_id") % len(_RAWS) + 1).cast("int")).alias("raw")).withColumn("status", scalars.status(F.col("raw"))),
)
_TIMES = "(SELECT flight_id, status, delay_minutes AS told, scheduled_departure_utc AS s, CASE WHEN flight_id % 3 = 0 THEN scheduled_departure_utc + to_seconds(flight_id % 9000 - 600) END AS e, CASE WHEN flight_id % 5 = 0 THEN scheduled_departure_utc + to_seconds(flight_id % 7000 - 900) END AS a FROM flights)"


def _times(f: DataFrame) -> DataFrame:
    plus = lambda m, back: F.timestamp_add("SECOND", (F.col("flight_id") % m - back).cast("int"), F.col("scheduled_departure_utc"))
    return f.select("flight_id", "status", F.col("delay_minutes").alias("told"), F.col("scheduled_departure_utc").alias("s"), F.when(F.col("flight_id") % 3 == 0, plus(9000, 600)).alias("e"), F.when(F.col("flight_id") % 5 == 0, plus(7000, 900)).alias("a"))


_MIN = "CAST(trunc((epoch({}) - epoch(s)) / 60) AS INTEGER)"
_LATE = f"CASE WHEN a IS NOT NULL THEN {_MIN.format('a')} WHEN e IS NOT NULL THEN {_MIN.format('e')} ELSE told END"
flown("scalar_minutes_between", f"SELECT flight_id, {_MIN.format('e')} AS minutes FROM {_TIMES}", lambda f: _times(f).select("flight_id", scalars.minutes_between(F.col("e"), F.col("s")).alias("minutes")))
flown(
    "compute_delay", f"SELECT flight_id, {_LATE} AS delay, CASE WHEN status NOT IN ('CANCELLED', 'DIVERTED') THEN {_LATE} END AS kept FROM {_TIMES}",
    lambda f: _times(f).withColumn("delay", scalars.delay(F.col("s"), F.col("e"), F.col("a"), F.col("told"))).select("flight_id", "delay", scalars.without_delay(F.col("status"), F.col("delay")).alias("kept")),
)
flown(
    "resolve_status",
    f"SELECT flight_id, CASE WHEN flight_id % 13 = 0 THEN 'CANCELLED' WHEN flight_id % 17 = 0 THEN 'DIVERTED' WHEN status IN ('CANCELLED', 'DIVERTED') THEN status WHEN e IS NOT NULL AND flight_id % 2 = 0 THEN 'ARRIVED' WHEN a IS NOT NULL THEN 'DEPARTED' WHEN status = 'SCHEDULED' AND {_LATE} >= 15 THEN 'DELAYED' ELSE status END AS final FROM {_TIMES}",
    lambda f: _times(f).select("flight_id", scalars.resolve(F.lower("status"), F.col("flight_id") % 13 == 0, F.col("flight_id") % 17 == 0, F.col("a"), F.when(F.col("flight_id") % 2 == 0, F.col("e")), scalars.delay(F.col("s"), F.col("e"), F.col("a"), F.col("told"))).alias("final")),
)
flown(
    "assess_quality",
    "SELECT flight_id, CASE WHEN flight_id % 19 = 0 THEN 'UNRELIABLE' WHEN delay_minutes NOT BETWEEN -180 AND 1440 THEN 'UNRELIABLE' WHEN status IN ('DEPARTED', 'ARRIVED', 'DIVERTED') AND delay_minutes IS NULL THEN 'PARTIAL' WHEN flight_id % 4 = 0 THEN 'PARTIAL' ELSE 'OK' END AS quality FROM flights",
    lambda f: f.select("flight_id", scalars.quality(F.col("status"), F.when(F.col("flight_id") % 19 != 0, F.col("scheduled_departure_utc")), F.col("delay_minutes"), F.col("flight_id") % 4 != 0).alias("quality")),
)
flown(
    "flight_board",
    f"SELECT flight_id, CASE WHEN e IS NOT NULL THEN greatest(s, e) WHEN told > 0 THEN s + to_minutes(told) ELSE s END AS expected, status NOT IN ('DEPARTED', 'ARRIVED', 'CANCELLED', 'DIVERTED') AND date_diff('second', CASE WHEN e IS NOT NULL THEN greatest(s, e) WHEN told > 0 THEN s + to_minutes(told) ELSE s END, TIMESTAMP '2001-08-01 12:00:00') >= 121 * 60 AS unresolved FROM {_TIMES}",
    lambda f: _times(f).withColumn("expected", scalars.expected_departure(F.col("s"), F.col("e"), F.col("told"))).select("flight_id", "expected", scalars.unresolved(F.col("status"), F.col("expected"), F.lit("2001-08-01 12:00:00").cast("timestamp_ntz")).alias("unresolved")),
)
_ISO_FORMS = ("%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d %H:%MZ", "%Y-%m-%dT%H:%M+03:00", "%Y-%m-%d %H:%M:%S+00:00", "%Y-%m-%d %H:%M")


def _iso(f: DataFrame) -> DataFrame:
    forms = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm'z'", "yyyy-MM-dd'T'HH:mm'+03:00'", "yyyy-MM-dd HH:mm:ss'+00:00'", "yyyy-MM-dd HH:mm"]
    text = F.coalesce(*[F.when(F.col("flight_id") % 6 == i, F.date_format("scheduled_departure_utc", x)) for i, x in enumerate(forms)], F.lit("no time"))
    return f.select("flight_id", scalars.parse_iso(text).alias("utc"))


flown("scalar_parse_iso", "SELECT flight_id, CASE WHEN flight_id % 6 IN (0, 1, 3) THEN scheduled_departure_utc WHEN flight_id % 6 = 2 THEN scheduled_departure_utc - INTERVAL 3 HOUR END AS utc FROM flights", _iso)

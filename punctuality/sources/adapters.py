"""Views of the given tables as flights: fixed integer arithmetic, the same in DataFrames
(for jobs) and in DuckDB's SQL (for their check). Times are UTC without a zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctuality.params import DEFAULT, Params

ROUTES = (("IST", "IKA"), ("IST", "MHD"), ("IKA", "IST"), ("MHD", "IST"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What flights are made of."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")


def flights(spark: SparkSession, sf_dir: str, p: Params = DEFAULT) -> DataFrame:
    """One row a line of an order: the latest state of a flight leg."""
    return flown(lines(spark, sf_dir), p)


def flown(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The same for lines, however they are dealt out."""
    h = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 17 + F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 1000
    c, r = F.col("l_suppkey") % 12, (F.col("l_suppkey") + F.col("l_partkey")) % 4
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in ROUTES]), (F.col("r") + 1).cast("int"))
    base = rows.withColumns({"h": h, "c": c, "r": r})
    late = F.expr("cast(cast(l_quantity as int) * cast(l_quantity as int) * l_linenumber div 60 as int)") - 20
    at = F.expr("timestampadd(MINUTE, cast(l_orderkey * 37 % 1440 as int), l_shipdate)")
    local = F.convert_timezone(F.lit("UTC"), F.lit(p.zone), F.col("scheduled_departure_utc"))
    code = lambda s: F.concat(F.lit(s), F.col("c").cast("string"))
    out = base.select(
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100003 + F.col("l_partkey")) * 1009 + F.col("l_suppkey")).alias("flight_id"),
        F.concat(code("F"), (100 + F.col("l_partkey") % 40).cast("string")).alias("flight_number"),
        F.when(F.col("c") < 8, code("A")).alias("airline_iata"), F.when(F.col("c").isin(8, 9), code("IC")).alias("airline_icao"), F.when(F.col("c") < 11, code("Airline ")).alias("airline_name"),
        pick(0).alias("origin_iata"), pick(1).alias("destination_iata"), at.alias("scheduled_departure_utc"), "h", late.alias("late"),
    )
    return out.select(
        "flight_id", "flight_number", "airline_iata", "airline_icao", "airline_name", "origin_iata", "destination_iata", "scheduled_departure_utc",
        F.to_date(local).alias("flight_date_local"), F.hour(local).alias("hour_local"), (F.weekday(local) + 1).alias("dow_local"),
        F.when(F.col("h") < 60, "CANCELLED").when(F.col("h") < 75, "DIVERTED").when(F.col("h") < 100, "SCHEDULED").when(F.col("h") < 600, "DEPARTED").otherwise("ARRIVED").alias("status"),
        F.when((F.col("h") >= 60) & ~F.col("h").between(100, 149), F.col("late")).alias("delay_minutes"),
        (F.col("h") < 60).alias("is_cancelled"), F.col("h").between(60, 74).alias("is_diverted"),
        F.when(F.col("h").between(600, 604), "UNRELIABLE").otherwise("OK").alias("data_quality"), F.col("h").between(605, 609).alias("is_mock"),
    )


FLIGHTS_SQL = """flights AS (
  SELECT ((l_orderkey * 8 + l_linenumber) * 100003 + l_partkey) * 1009 + l_suppkey AS flight_id,
    'F' || c || (100 + l_partkey % 40) AS flight_number, CASE WHEN c < 8 THEN 'A' || c END AS airline_iata,
    CASE WHEN c IN (8, 9) THEN 'IC' || c END AS airline_icao, CASE WHEN c < 11 THEN 'Airline ' || c END AS airline_name,
    ['IST', 'IST', 'IKA', 'MHD'][r + 1] AS origin_iata, ['IKA', 'MHD', 'IST', 'IST'][r + 1] AS destination_iata,
    dep AS scheduled_departure_utc, CAST(loc AS DATE) AS flight_date_local, CAST(hour(loc) AS INTEGER) AS hour_local, CAST(isodow(loc) AS INTEGER) AS dow_local,
    CASE WHEN h < 60 THEN 'CANCELLED' WHEN h < 75 THEN 'DIVERTED' WHEN h < 100 THEN 'SCHEDULED' WHEN h < 600 THEN 'DEPARTED' ELSE 'ARRIVED' END AS status,
    CASE WHEN h >= 60 AND h NOT BETWEEN 100 AND 149 THEN q * q * l_linenumber // 60 - 20 END AS delay_minutes,
    h < 60 AS is_cancelled, h BETWEEN 60 AND 74 AS is_diverted, CASE WHEN h BETWEEN 600 AND 604 THEN 'UNRELIABLE' ELSE 'OK' END AS data_quality, h BETWEEN 605 AND 609 AS is_mock
  FROM (SELECT *, timezone('Europe/Istanbul', timezone('UTC', dep)) AS loc FROM (
    SELECT *, (l_orderkey * 31 + l_partkey * 17 + l_suppkey * 7 + l_linenumber) % 1000 AS h, l_suppkey % 12 AS c, (l_suppkey + l_partkey) % 4 AS r,
      CAST(trunc(l_quantity) AS INTEGER) AS q, l_shipdate + to_minutes(l_orderkey * 37 % 1440) AS dep FROM lineitem)))"""

# The airports that the routes join (iata, icao, name, city, zone).
AIRPORTS = (
    ("IST", "LTFM", "Istanbul Airport", "Istanbul", "Europe/Istanbul"),
    ("IKA", "OIIE", "Imam Khomeini International Airport", "Tehran", "Asia/Tehran"),
    ("MHD", "OIMM", "Mashhad International Airport", "Mashhad", "Asia/Tehran"),
)


def airports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AIRPORTS, "iata string, icao string, name string, city string, timezone string")


AIRPORTS_SQL = "airports(iata, icao, name, city, timezone) AS (VALUES " + ", ".join(str(a) for a in AIRPORTS) + ")"


def routes(spark: SparkSession, p: Params = DEFAULT) -> DataFrame:
    """The monitored routes: a handful of rows, of a size that settings fix."""
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(p.routes)], "position int, origin_iata string, destination_iata string")


ROUTES_SQL = "routes(position, origin_iata, destination_iata) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(DEFAULT.routes)) + ")"


def observations(spark: SparkSession, sf_dir: str, p: Params = DEFAULT) -> DataFrame:
    """One row an event: what a source said of a leg at a time. A leg is a user's local
    day, a run an hour; every 20th row moves the schedule by five hours. Rows are dealt out as they are
    read: a file has few row groups, and what follows is wide."""
    return observed(spark.read.parquet(f"{sf_dir}/events.parquet").repartition("event_id"), p)


def observed(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The same for rows of events, a stream's too."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(p.zone), F.col("ts"))
    status = F.create_map(*[F.lit(x) for pair in STATUS_OF.items() for x in pair])
    k, user = F.col("event_id"), F.col("user_id")
    sched = F.expr("timestampadd(MINUTE, cast(480 + user_id % 600 + if(event_id % 20 = 0, 300, 0) as int), cast(date_trunc('DAY', ts) as timestamp_ntz))")
    delay = F.when((F.col("event_type") != "error") & (k % 10 != 0), F.floor("value").cast("int"))
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    base = rows.select("*", F.to_date(local).alias("day"), sched.alias("sched"), delay.alias("delay"))
    base = base.select("*", F.coalesce(status[F.col("event_type")], F.lit("UNKNOWN")).alias("status_"), F.timestamp_add("MINUTE", F.lit(200), F.col("sched")).alias("landing"))
    after = lambda minutes, at: F.timestamp_add("MINUTE", minutes, F.col(at))
    bought = F.col("event_type") == "purchase"
    return base.select(
        k.alias("observation_id"),
        text("U", user).alias("flight_number"),
        F.lit("IST").alias("origin_iata"),
        F.lit("IKA").alias("destination_iata"),
        F.col("day").alias("flight_date_local"),
        F.date_format("ts", "yyyyMMddHH").alias("run_id"),
        F.element_at(F.array(*map(F.lit, SOURCES)), (k % 3 + 1).cast("int")).alias("data_source"),
        F.col("ts").alias("observed_at"),
        F.col("sched").alias("scheduled_departure_utc"),
        F.when(k % 2 == 0, after(F.col("delay"), "sched")).alias("estimated_departure_utc"),
        F.when(bought, after(F.col("delay"), "sched")).alias("actual_departure_utc"),
        F.when(k % 3 != 1, F.col("landing")).alias("scheduled_arrival_utc"),
        F.when(k % 2 == 1, after(F.col("delay"), "landing")).alias("estimated_arrival_utc"),
        F.when(bought & (k % 4 == 0), after(F.col("delay") + 5, "landing")).alias("actual_arrival_utc"),
        F.col("status_").alias("status"),
        F.lower("status_").alias("raw_status"),
        F.col("delay").alias("delay_minutes"),
        F.when(k % 3 == 2, F.col("delay") + 7).alias("arrival_delay_minutes"),
        (F.col("event_type") == "error").alias("is_cancelled"),
        (k % 53 == 0).alias("is_diverted"),
        F.when((F.col("event_type") == "error") & (k % 2 == 0), "weather").alias("cancellation_reason"),
        text("G", F.get_json_object("props", "$.k").cast("bigint") % 5).alias("gate"),
        F.when(k % 14 == 3, "").when(k % 7 != 0, text("T", k % 2)).alias("terminal"),
        F.when(k % 3 == 0, text("A3", k % 9)).alias("aircraft_type"),
        F.when(k % 8 == 0, text("TC-", k % 26)).alias("aircraft_registration"),
        (k % 12 == 0).alias("is_codeshare"),
        F.when(k % 12 == 0, text("XX", k % 90)).alias("codeshare_of"),
        F.when(k % 50 == 0, "UNRELIABLE").when(k % 9 == 0, "PARTIAL").otherwise("OK").alias("data_quality"),
        (k % 41 == 0).alias("is_mock"),
        F.when(k % 4 != 1, text("TK", user)).alias("flight_iata"),
        F.when(k % 6 == 0, text("THY", user)).alias("flight_icao"),
        F.when(k % 4 != 3, text("A", user % 8)).alias("airline_iata"),
        F.when(k % 5 != 2, text("IC", user % 11)).alias("airline_icao"),
        F.concat(text("Carrier ", user % 8), text(" v", k % 3)).alias("airline_name"),
    )


# What an event of each type says, and the sources in the order of trust.
STATUS_OF = {"signup": "SCHEDULED", "view": "BOARDING", "click": "DELAYED", "purchase": "DEPARTED", "error": "CANCELLED"}
SOURCES = ("primary", "second", "third")

OBSERVATIONS_SQL = f"""observations AS (
  SELECT k AS observation_id, 'U' || user_id AS flight_number, 'IST' AS origin_iata, 'IKA' AS destination_iata,
    CAST(timezone('Europe/Istanbul', timezone('UTC', ts)) AS DATE) AS flight_date_local,
    strftime(ts, '%Y%m%d%H') AS run_id, {list(SOURCES)}[k % 3 + 1] AS data_source, ts AS observed_at,
    sched AS scheduled_departure_utc, CASE WHEN k % 2 = 0 THEN sched + to_minutes(delay) END AS estimated_departure_utc,
    CASE WHEN event_type = 'purchase' THEN sched + to_minutes(delay) END AS actual_departure_utc,
    CASE WHEN k % 3 <> 1 THEN landing END AS scheduled_arrival_utc,
    CASE WHEN k % 2 = 1 THEN landing + to_minutes(delay) END AS estimated_arrival_utc,
    CASE WHEN event_type = 'purchase' AND k % 4 = 0 THEN landing + to_minutes(delay + 5) END AS actual_arrival_utc,
    status, lower(status) AS raw_status, delay AS delay_minutes, CASE WHEN k % 3 = 2 THEN delay + 7 END AS arrival_delay_minutes,
    event_type = 'error' AS is_cancelled, k % 53 = 0 AS is_diverted, CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'weather' END AS cancellation_reason,
    'G' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 5) AS gate,
    CASE WHEN k % 14 = 3 THEN '' WHEN k % 7 <> 0 THEN 'T' || (k % 2) END AS terminal,
    CASE WHEN k % 3 = 0 THEN 'A3' || (k % 9) END AS aircraft_type, CASE WHEN k % 8 = 0 THEN 'TC-' || (k % 26) END AS aircraft_registration,
    k % 12 = 0 AS is_codeshare, CASE WHEN k % 12 = 0 THEN 'XX' || (k % 90) END AS codeshare_of,
    CASE WHEN k % 50 = 0 THEN 'UNRELIABLE' WHEN k % 9 = 0 THEN 'PARTIAL' ELSE 'OK' END AS data_quality, k % 41 = 0 AS is_mock,
    CASE WHEN k % 4 <> 1 THEN 'TK' || user_id END AS flight_iata, CASE WHEN k % 6 = 0 THEN 'THY' || user_id END AS flight_icao,
    CASE WHEN k % 4 <> 3 THEN 'A' || (user_id % 8) END AS airline_iata, CASE WHEN k % 5 <> 2 THEN 'IC' || (user_id % 11) END AS airline_icao,
    'Carrier ' || (user_id % 8) || ' v' || (k % 3) AS airline_name
  FROM (SELECT *, sched + INTERVAL 200 MINUTE AS landing, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_OF.items())} ELSE 'UNKNOWN' END AS status
    FROM (SELECT *, event_id AS k, date_trunc('day', ts) + to_minutes(CAST(480 + user_id % 600 + CASE WHEN event_id % 20 = 0 THEN 300 ELSE 0 END AS BIGINT)) AS sched,
      CASE WHEN event_type <> 'error' AND event_id % 10 <> 0 THEN CAST(floor(value) AS INTEGER) END AS delay FROM events)))"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order: a call of a provider that worked or didn't."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    limited = (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 7 == 0)
    return rows.select(F.col("o_orderkey").alias("call_id"), F.col("o_orderpriority").alias("provider"), F.expr("timestampadd(MINUTE, cast(o_orderkey % 1440 as int), o_orderdate)").alias("called_at"), (F.col("o_orderstatus") != "F").alias("ok"), limited.alias("rate_limited"), F.when(limited & (F.col("o_orderkey") % 2 == 0), (F.col("o_orderkey") % 50 * 60).cast("int")).alias("retry_after_s"))


CALLS_SQL = "calls AS (SELECT o_orderkey AS call_id, o_orderpriority AS provider, o_orderdate + to_minutes(o_orderkey % 1440) AS called_at, o_orderstatus <> 'F' AS ok, o_orderstatus = 'F' AND o_orderkey % 7 = 0 AS rate_limited, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 14 = 0 THEN o_orderkey % 50 * 60 END AS retry_after_s FROM orders)"

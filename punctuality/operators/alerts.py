"""Alerts as rows with a key that is sent once: building them, and the ledger."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctuality.operators.population import day_start
from punctuality.params import DEFAULT, Params

COLUMNS = ("alert_type", "dedup_key", "flight_id", "route")


def population(flights: DataFrame, as_of: datetime, p: Params = DEFAULT) -> DataFrame:
    """From the local day's start to a day ahead; mock flights never alert, unreliable
    ones do."""
    until = F.lit(str(as_of)).cast("timestamp_ntz") + F.expr("INTERVAL 24 HOURS")
    rows = flights.where(~F.col("is_mock") & (F.col("scheduled_departure_utc") >= day_start(as_of.date(), p)) & (F.col("scheduled_departure_utc") <= until))
    return rows.withColumn("route", F.concat_ws("-", "origin_iata", "destination_iata"))


def _key(kind: str, *parts: Column | str) -> Column:
    return F.concat_ws(":", F.lit(kind), *[(F.col(x) if isinstance(x, str) else x).cast("string") for x in parts])


def cancellation_key() -> Column:
    return _key("CANCELLATION", "flight_number", "flight_date_local")


def cancellations(rows: DataFrame) -> DataFrame:
    return rows.where("is_cancelled").select(F.lit("CANCELLATION").alias("alert_type"), cancellation_key().alias("dedup_key"), "flight_id", "route")


def delays(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One alert for each threshold that a flight has reached."""
    reached = rows.where(~F.col("is_cancelled") & (F.col("status") != "ARRIVED")).withColumn("t", F.explode(F.array(*map(F.lit, p.alert_delays)))).where(F.col("delay_minutes") >= F.col("t"))
    return reached.select(F.lit("DELAY_THRESHOLD").alias("alert_type"), _key("DELAY_THRESHOLD", "flight_number", "flight_date_local", "t").alias("dedup_key"), "flight_id", "route")


def disruptions(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Route days with many cancellations; the key holds the rate's tenth, so that a
    route alerts again only as it gets worse."""
    rate = F.col("gone") / F.col("n")
    days = rows.groupBy("route", "flight_date_local").agg(F.count("*").alias("n"), F.count_if("is_cancelled").alias("gone")).where((F.col("n") >= p.disruption_flights) & (rate >= p.disruption_rate))
    return days.select(F.lit("ROUTE_DISRUPTION").alias("alert_type"), _key("ROUTE_DISRUPTION", "route", "flight_date_local", F.floor(rate * 10)).alias("dedup_key"), F.lit(None).cast("long").alias("flight_id"), "route")


def all_alerts(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return cancellations(rows).unionByName(delays(rows, p)).unionByName(disruptions(rows, p))


def report_keys(times: DataFrame, at: str, p: Params = DEFAULT) -> DataFrame:
    """(alert_type, dedup_key) of the reports that fall due at times (UTC): one an hour and
    one a day, by the local clock."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(p.zone), F.col(at))
    each = lambda kind, form: F.struct(F.lit(kind).alias("alert_type"), F.concat(F.lit(f"{kind}:"), F.date_format(local, form)).alias("dedup_key"))
    return times.select(F.inline(F.array(each("HOURLY_REPORT", "yyyy-MM-dd HH"), each("DAILY_REPORT", "yyyy-MM-dd")))).distinct()


def unsent(built: DataFrame, ledger: DataFrame) -> DataFrame:
    """The first of each key that the ledger doesn't hold."""
    return built.dropDuplicates(["dedup_key"]).join(ledger, "dedup_key", "left_anti")


def released(ledger: DataFrame) -> DataFrame:
    """The ledger with the keys of failed deliveries free again; their rows stay."""
    free = F.concat("dedup_key", F.lit("#failed:"), F.col("alert_id").cast("string"))
    return ledger.withColumn("dedup_key", F.when(F.col("failed"), free).otherwise(F.col("dedup_key")))


def tally(built: DataFrame, ledger: DataFrame) -> DataFrame:
    """By type: alerts built, new ones, and duplicates (in the batch or sent before)."""
    keys = built.groupBy("alert_type", "dedup_key").agg(F.count("*").alias("n"))
    marked = keys.join(ledger.select("dedup_key", F.lit(True).alias("sent")), "dedup_key", "left")
    new = F.count_if(F.col("sent").isNull())
    return marked.groupBy("alert_type").agg(F.sum("n").alias("built"), new.alias("new"), (F.sum("n") - new).alias("duplicate"))

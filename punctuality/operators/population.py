"""Which flights a job looks at: by local dates, UTC windows, filters and pages."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctuality.operators import metrics
from punctuality.params import DEFAULT, Params


def day_start(day: date, p: Params = DEFAULT) -> Column:
    """The UTC instant at which a local day begins; the next day's is its end, so that
    days of 23 or 25 hours come out right."""
    return F.convert_timezone(F.lit(p.zone), F.lit("UTC"), F.lit(f"{day} 00:00:00").cast("timestamp_ntz"))


def by_dates(flights: DataFrame, start: date, end: date, completed: bool = False) -> DataFrame:
    """Facts of local days from start to end, both included."""
    rows = metrics.facts(flights.where(F.col("flight_date_local").between(F.lit(start), F.lit(end))))
    return rows.where("completed") if completed else rows


def by_window(flights: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """Facts scheduled in the half-open UTC window [start, end)."""
    a, b = (F.lit(x).cast("timestamp_ntz") if isinstance(x, str) else x for x in (start, end))
    return metrics.facts(flights.where((F.col("scheduled_departure_utc") >= a) & (F.col("scheduled_departure_utc") < b)))


def day_board(flights: DataFrame, day: date, p: Params = DEFAULT) -> DataFrame:
    """Facts of one local day in the order of departure."""
    return by_window(flights, day_start(day, p), day_start(day + timedelta(days=1), p)).orderBy("scheduled_departure_utc", "flight_id")


def rolling(flights: DataFrame, days: int, end: date) -> DataFrame:
    """Facts of the `days` local days that end with `end`."""
    return by_dates(flights, end - timedelta(days=days - 1), end)


def resolve_window(name: str, today: date, start: date | None = None, end: date | None = None) -> tuple[date, date]:
    """First and last day of a named window; an explicit range goes before the name."""
    if start or end:
        end = end or today
        start = start or end - timedelta(days=29)
        if start > end:
            raise ValueError("the window starts after its end")
        return start, end
    if name == "mtd":
        return today.replace(day=1), today
    if name == "all":
        return date(1970, 1, 1), today
    days = {"today": 1, "7d": 7, "30d": 30, "90d": 90}[name]
    return today - timedelta(days=days - 1), today


def filtered(rows: DataFrame, route: str | None = None, airline: str | None = None, flight_number: str | None = None) -> DataFrame:
    """Filters of a route (a full pair), an airline's IATA code and a flight number."""
    if route:
        parts = route.upper().split("-")
        if len(parts) != 2 or not all(len(x) == 3 for x in parts):
            raise ValueError(f"a route is a pair such as IST-IKA, not {route!r}")
        rows = rows.where((F.col("origin_iata") == parts[0]) & (F.col("destination_iata") == parts[1]))
    if airline:
        rows = rows.where(F.col("airline_iata") == airline.upper())
    return rows.where(F.col("flight_number") == flight_number.upper()) if flight_number else rows


def listing(flights: DataFrame, status: str | None = None, include_mock: bool = False, page: int = 1, size: int = 50) -> DataFrame:
    """A page of flights, newest first, with the number of all that match. The count is
    an aggregate of its own: no window over all rows."""
    rows = flights if include_mock else flights.where(~F.col("is_mock"))
    rows = rows.where(F.col("status") == status) if status else rows
    shown = rows.orderBy(F.desc("scheduled_departure_utc"), F.desc("flight_id")).offset((page - 1) * size).limit(size)
    return shown.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


def monitored(flights: DataFrame, routes: DataFrame) -> DataFrame:
    """Flights of the configured routes; their table is as small as the settings."""
    return flights.join(F.broadcast(routes), ["origin_iata", "destination_iata"], "left_semi")

"""Streaming jobs run over the events table as it stands, checked against the batch SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctuality.operators import history, insights, statistics
from punctuality.plans import collection, sql
from punctuality.session import shared_path
from punctuality.sources import adapters
from punctuality.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a pattern, as a stream's source may not be one file
    return adapters.observed(spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet"))


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last word on each hour (update mode tells of an hour again as it grows)."""
    out = jobs.run_now(jobs.hourly_counts(source(spark, sf_dir)), "update")
    return out.groupBy("hour", "origin_iata").agg(F.max_by("n", "batch").alias("n"), F.max_by("cancelled", "batch").alias("cancelled"))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "latest")
    query = jobs.upsert_latest(source(spark, sf_dir), folder).option("checkpointLocation", shared_path(spark, "latest-log"))
    query.trigger(availableNow=True).start().awaitTermination()
    return jobs.latest(spark, folder)


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily statistics of a state to which the flights of the first half of the time went, and then what
    the second half made of them."""
    rows = adapters.observations(spark, sf_dir)
    ends = rows.agg(F.min("observed_at"), F.max("observed_at")).first()
    half, every = (jobs.facts_of(history.latest_state(r)) for r in (rows.where(F.col("observed_at") < F.lit(ends[0] + (ends[1] - ends[0]) / 2)), rows))
    folder = shared_path(spark, "statistics")
    statistics.fold_in(statistics.state_of(half), folder, 0)
    statistics.fold_in(statistics.changes(half, every), folder, 1)
    return insights.daily_of(statistics.held(spark, folder))


QUERIES["folded_statistics"] = _folded
ORACLE["folded_statistics"] = (
    sql.with_(
        f"flights AS (SELECT *, scheduled_hour_local AS hour_local, scheduled_dow_local AS dow_local FROM ({collection.ORACLE['latest_state']}))",
        sql.FACTS_SQL,
        sql.keyed(),
        sql.block("b", "keyed", "flight_date_local, scope, key", sql.least_sample()),
    )
    + "SELECT *, CASE WHEN scope = 'ROUTE' THEN key WHEN scope IN ('ROUTE_PERIOD', 'ROUTE_AIRLINE') THEN split_part(key, '|', 1) END AS route FROM b"
)


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "told")
    query = jobs.tell(source(spark, sf_dir), folder).option("checkpointLocation", shared_path(spark, "told-log"))
    query.trigger(availableNow=True).start().awaitTermination()
    return jobs.last_word(jobs.told_now(spark, folder))


QUERIES["stream_events"] = _told
ORACLE["stream_events"] = collection.ORACLE["derive_events"]
QUERIES["stream_hourly_counts"] = _hours
ORACLE["stream_hourly_counts"] = sql.with_(adapters.OBSERVATIONS_SQL) + "SELECT date_trunc('hour', observed_at) AS hour, origin_iata, count(*) AS n, count(*) FILTER (is_cancelled) AS cancelled FROM observations GROUP BY ALL"
QUERIES["stream_alerts_once"] = lambda spark, d: jobs.run_now(jobs.alerts_once(source(spark, d)))
ORACLE["stream_alerts_once"] = sql.with_(adapters.OBSERVATIONS_SQL) + "SELECT DISTINCT 'CANCELLATION:' || flight_number || ':' || flight_date_local AS dedup_key FROM observations WHERE is_cancelled"
def boards(rows: DataFrame) -> DataFrame:
    """Boards as they were asked for, an hour and origin each: read if the primary source told of it."""
    hour = F.date_trunc("HOUR", "observed_at")
    asked = rows.groupBy("origin_iata", hour.alias("hour")).agg(F.bool_or(F.col("data_source") == "primary").alias("ok"))
    return asked.select("origin_iata", F.timestamp_add("HOUR", F.lit(1), F.col("hour")).cast("timestamp_ntz").alias("read_at"), "ok")


def _stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = boards(adapters.observations(spark, sf_dir))
    folder = shared_path(spark, "boards")
    held.write.parquet(folder)
    into = shared_path(spark, "watched-flights")
    query = jobs.watch(source(spark, sf_dir), spark.readStream.schema(held.schema).parquet(folder), into).option("checkpointLocation", shared_path(spark, "watch-log"))
    query.trigger(availableNow=True).start().awaitTermination()
    return jobs.gone_now(spark, into)


QUERIES["stream_stale"] = _stale
ORACLE["stream_stale"] = (
    sql.with_(
        adapters.OBSERVATIONS_SQL,
        f"s AS (SELECT {collection.FLIGHT}, arg_max(status, (observed_at, observation_id)) AS status, max(observed_at) AS last_at FROM observations GROUP BY {collection.FLIGHT})",
        "b AS (SELECT origin_iata, date_trunc('hour', observed_at) + INTERVAL 1 HOUR AS read_at, bool_or(data_source = 'primary') AS ok FROM observations GROUP BY ALL)",
        "w AS (SELECT greatest((SELECT max(observed_at) FROM observations), (SELECT max(read_at) FROM b WHERE ok)) - INTERVAL 2 DAY AS passed)",
    )
    + """SELECT flight_number, origin_iata, destination_iata, CAST(flight_date_local AS VARCHAR) AS flight_date_local, status, 'WENT_STALE' AS event_type
FROM s WHERE status NOT IN ('DEPARTED', 'ARRIVED', 'CANCELLED', 'DIVERTED')
  AND EXISTS (SELECT 1 FROM b, w WHERE b.ok AND b.origin_iata = s.origin_iata AND b.read_at > date_trunc('millisecond', s.last_at) + INTERVAL 180 MINUTE AND b.read_at <= w.passed)"""
)
QUERIES["stream_latest_state"] = _latest
ORACLE["stream_latest_state"] = collection.ORACLE["latest_state"]


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations through the stream into history and state; the flights of the published state,
    with how many snapshots the published history has of each."""
    folder, rows = shared_path(spark, "ingest"), source(spark, sf_dir)
    query = jobs.ingest(rows, folder).option("checkpointLocation", shared_path(spark, "ingest-log"))
    query.trigger(availableNow=True).start().awaitTermination()
    kept = jobs.history_now(spark, folder, rows.schema).groupBy(*history.FLIGHT).agg(F.count("*").alias("snapshots"))
    return jobs.latest_now(spark, folder).join(kept, list(history.FLIGHT))


_SNAPSHOTS = (
    adapters.OBSERVATIONS_SQL.replace("observations AS", "told AS", 1)
    + f", observations AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY {', '.join(history.SNAPSHOT)} ORDER BY observed_at, observation_id) = 1)"
)
QUERIES["stream_ingest"] = _ingested
ORACLE["stream_ingest"] = f"SELECT *, observation_count AS snapshots FROM ({collection.ORACLE['latest_state'].replace(adapters.OBSERVATIONS_SQL, _SNAPSHOTS)})"

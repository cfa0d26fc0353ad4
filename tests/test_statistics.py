"""The folding state of the statistics: parts in any order, corrections, hot days."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from punctuality.operators import insights, metrics, statistics

SCHEMA = (
    "flight_id long, flight_number string, airline_iata string, airline_icao string, airline_name string, origin_iata string, destination_iata string, "
    "scheduled_departure_utc timestamp_ntz, flight_date_local date, hour_local int, dow_local int, status string, delay_minutes int, is_cancelled boolean, "
    "is_diverted boolean, data_quality string, is_mock boolean"
)


def made(n, seed=1):
    """Rows of flights, a third of them of one day."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        day = date(2026, 9, 1) + timedelta(days=0 if rng.random() < 0.33 else rng.randrange(9))
        gone, hour = rng.random() < 0.1, rng.randrange(24)
        delay = None if gone or rng.random() < 0.1 else rng.choice([-12, 0, 14, 15, 16, 61, 121, 1440, rng.randrange(300)])
        code = rng.choice([None, "", "A1", "A2", "A3"])
        rows.append((
            i, f"F{rng.randrange(30)}", code, rng.choice([None, "ICA"]), rng.choice([None, "Name"]), "IST", rng.choice(["IKA", "MHD"]), datetime(day.year, day.month, day.day, hour),
            day, hour, day.isoweekday(), rng.choice(["DEPARTED", "SCHEDULED", "ARRIVED"]), delay, gone, rng.random() < 0.05, rng.choice(["OK"] * 9 + ["UNRELIABLE"]), rng.random() < 0.05,
        ))
    return rows


def same(one, other):
    return sorted(map(str, one.select(*sorted(one.columns)).collect())) == sorted(map(str, other.select(*sorted(one.columns)).collect()))


def plain(facts, *keep):
    """Each scope's block of each day by itself, from the facts."""
    out = []
    for scope in metrics.SCOPES:
        keyed = facts.withColumn("key", metrics.scope_key(scope)).where("key is not null")
        out.append(metrics.block(keyed, *keep, "key", least=metrics.DEFAULT.least_sample(scope)).withColumn("scope", F.lit(scope)))
    first, *rest = out
    for more in rest:
        first = first.unionByName(more)
    return first.withColumn("route", insights.route_of())


def test_rolled_up_is_each_scope_by_itself(spark):
    facts = metrics.facts(spark.createDataFrame(made(600), SCHEMA))
    assert same(insights.daily(facts), plain(facts, "flight_date_local"))


def test_parts_fold_in_any_order_and_flights_are_told_anew(spark, tmp_path):
    rows = made(400)
    later = [(*r[:11], "ARRIVED", *made(1, seed=r[0])[0][12:]) if r[0] % 3 == 0 else r for r in rows]
    frame = lambda part: metrics.facts(spark.createDataFrame(part, SCHEMA))
    want = insights.daily(frame(later))
    half, folder = [r for r in later if r[0] < 250], str(tmp_path / "state")
    statistics.fold_in(statistics.state_of(frame(rows[250:])), folder, 0)
    statistics.fold_in(statistics.changes(frame(rows[250:]), frame(later[250:])), folder, 1)
    statistics.fold_in(statistics.state_of(frame(half)), folder, 2)
    statistics.fold_in(statistics.state_of(frame(half)), folder, 2)  # run again
    held = statistics.held(spark, folder)
    assert same(insights.daily_of(held), want) and same(insights.hourly_of(held), insights.hourly(frame(later)))
    assert statistics.fold(held).where("weight < 0").count() == 0
    statistics.compacted(spark, folder, str(tmp_path / "new"), 1)
    packed = statistics.held(spark, str(tmp_path / "new"))
    assert same(insights.daily_of(packed), want) and sorted(r[0] for r in packed.select("batch").distinct().collect()) == [1, 2]
    day = date(2026, 9, 1)
    assert same(insights.daily_of(statistics.held(spark, folder, [day])), want.where(F.col("flight_date_local") == F.lit(day)))


def test_empty_state(spark, tmp_path):
    assert insights.daily_of(statistics.held(spark, str(tmp_path / "none"))).count() == 0


def test_no_exchange_by_day_alone(spark):
    facts = metrics.facts(spark.createDataFrame(made(50), SCHEMA))
    for stats in (insights.daily(facts), insights.hourly(facts)):
        plan = stats._jdf.queryExecution().toString()
        assert "hashpartitioning" in plan
        for line in plan.splitlines():
            if "Exchange hashpartitioning(" in line:
                assert line.split("Exchange hashpartitioning(")[1].split("), ")[0].count("#") >= 3, line


def test_a_hot_day_is_spread_over_tasks(spark):
    """Of a day with a third of all rows no task gets more than a few of the outcomes' counts."""
    facts = metrics.facts(spark.createDataFrame(made(3000), SCHEMA))
    states = statistics.state_of(facts).withColumns({"place": F.lit(0), "key": F.lit("ALL"), "outcome": statistics.outcome()})
    counts = states.groupBy("flight_date_local", "place", "key", "outcome").agg(F.sum("weight").alias("w"))
    parts = counts.repartition(16, "flight_date_local", "place", "key", "outcome").where("flight_date_local = date'2026-09-01'").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 16 and max(r["count"] for r in parts) * 5 < sum(r["count"] for r in parts)

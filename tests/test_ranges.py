"""Predecessors and places by ranges, with a key that lies in several."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from punctuality.operators import history, ranges
from punctuality.sources import adapters

SCHEMA = "k string, s string, t int, id int, v string"


@pytest.fixture(autouse=True)
def several_ranges(spark):
    """Small shuffles stay in all their partitions."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def made(n=4000):
    rng = random.Random(7)
    hot = [("hot", "a", rng.randrange(50), i, rng.choice([None, "x", "y"])) for i in range(n // 3)]
    rest = [(rng.choice([None, "", *"abcdefg"]), rng.choice("ab"), rng.randrange(50), i, f"v{i}") for i in range(n // 3, n)]
    rows = [*hot, *rest]
    rng.shuffle(rows)
    return rows


def shown(df):
    return sorted(map(str, df.collect()))


def test_row_before(spark):
    rows = spark.createDataFrame(made(), SCHEMA)
    got = ranges.with_before(rows, ("k", "s"), ("t", "id"), ("id", "v"))
    want = rows.withColumn("prev", F.lag(F.struct("id", "v")).over(Window.partitionBy("k", "s").orderBy("t", "id")))
    assert shown(got) == shown(want)
    parts = rows.repartitionByRange("k", "s", "t", "id").where("k = 'hot'").select(F.spark_partition_id()).distinct().count()
    assert parts > 1  # the hot key lies in several ranges


def test_few_rows_and_none(spark):
    rows = spark.createDataFrame(made()[:3], SCHEMA)
    want = rows.withColumn("prev", F.lag(F.struct("id")).over(Window.partitionBy("k").orderBy("t", "id")))
    assert shown(ranges.with_before(rows, ("k",), ("t", "id"), ("id",))) == shown(want)
    assert ranges.with_before(rows.limit(0), ("k",), ("t", "id"), ("id",)).count() == 0
    assert ranges.numbered(rows.limit(0), "id").count() == 0


def test_places(spark):
    rows = spark.createDataFrame(made(), SCHEMA)
    order = (F.desc("t"), F.desc(F.coalesce("v", F.lit(""))), F.col("id").asc())
    got = ranges.numbered(rows, *order)
    assert shown(got) == shown(rows.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long")))


def test_predecessors_of_observations(spark):
    rows = adapters.observations(spark, "/root/testdata/sf0.001")
    keys = ("observation_id", "status", "delay_minutes", "gate", "terminal", "scheduled_departure_utc")
    for per_source in (False, True):
        by = (*history.FLIGHT, "data_source") if per_source else history.FLIGHT
        want = rows.withColumn("prev", F.lag(F.struct(*keys)).over(Window.partitionBy(*by).orderBy("observed_at", "observation_id")))
        assert shown(history.with_previous(rows, per_source).select("observation_id", "prev")) == shown(want.select("observation_id", "prev"))

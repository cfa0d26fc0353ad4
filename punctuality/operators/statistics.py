"""Statistics by day and hour from a state that folds.

The state is a histogram: how many flights of the finest grain (day, hour, route, airline,
flight number) had which outcome, delays in whole minutes. Sums of it are the state of all
their flights, in whatever order and number of parts they come, and a flight that is told anew
goes in as its old outcome taken away and its new one added, so that nothing else of its
day is read again. Scopes are rolled up from it in two levels: counts by scope, key and
outcome, which are combined where they are read and dealt by all three, so that a day with a third of all
flights is spread over as many tasks as it has outcomes; then each key's figures from its
outcomes, of which there are some thousands at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punctuality.operators import metrics
from punctuality.params import DEFAULT, SCOPES, Params
from punctuality.session import exists

FLAGS = ("is_cancelled", "completed", "diverted", "unknown")
STATE = (*metrics.GRAIN, *FLAGS, "raw_delay")
#: Delays are whole minutes of less than so many in size.
_MINUTES = 1 << 30


def state_of(facts: DataFrame, sign: int = 1) -> DataFrame:
    """(grain, outcome, weight) of facts; sign -1: what takes them away."""
    return facts.groupBy(*STATE).agg((F.lit(sign) * F.sum("weight")).alias("weight"))


def fold(states: DataFrame) -> DataFrame:
    """State rows as one each; what was added and taken away is gone."""
    return states.groupBy(*STATE).agg(F.sum("weight").alias("weight")).where("weight <> 0")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What turns a state that has the facts before into one that has those after."""
    return fold(state_of(before, -1).unionByName(state_of(after)))


def outcome() -> Column:
    """Flags and delay in one number; null delays are 0 of its upper part."""
    flags = sum((F.col(c).cast("long") * (1 << i) for i, c in enumerate(FLAGS)), F.lit(0).cast("long"))
    return F.coalesce(F.col("raw_delay").cast("long") + _MINUTES, F.lit(0)) * (1 << len(FLAGS)) + flags


def told(packed: Column) -> dict[str, Column]:
    """The columns that outcome() packed, and lateness."""
    delay = F.shiftright(packed, len(FLAGS))
    raw = F.when(delay > 0, (delay - _MINUTES).cast("int"))
    flags = {c: F.shiftright(packed, i) % 2 == 1 for i, c in enumerate(FLAGS)}
    return flags | {"raw_delay": raw, "lateness": F.when(raw.isNotNull(), F.greatest(raw, F.lit(0)))}


def rolled_up(states: DataFrame, scopes: tuple[str, ...] = SCOPES, keep: tuple[str, ...] = ("flight_date_local",), p: Params = DEFAULT) -> DataFrame:
    """(keep, scope, key, block) of state rows, folded or not."""
    pairs = F.array(*[F.struct(F.lit(i).alias("place"), metrics.scope_key(s).alias("key")) for i, s in enumerate(scopes)])
    each = states.select(*keep, outcome().alias("outcome"), "weight", F.inline(pairs)).where("key is not null")
    counts = each.groupBy(*keep, "place", "key", "outcome").agg(F.sum("weight").alias("weight")).where("weight <> 0")
    named = F.element_at(F.array(*map(F.lit, scopes)), F.col("place") + 1)
    rows = counts.select(*keep, named.alias("scope"), "key", "weight", *[c.alias(n) for n, c in told(F.col("outcome")).items()])
    return metrics.block(rows, *keep, "scope", "key", least=metrics.least_sample(p), p=p, merge=False)


def keys(facts: DataFrame, daily: tuple[str, ...], hourly: tuple[str, ...]) -> DataFrame:
    """(flight_date_local, hour_local, scope, key) of the rows that statistics of the scopes have, each
    once; hour_local is null for daily ones. Only what keys are taken from is moved, not outcomes."""
    grain = facts.select(*metrics.GRAIN).distinct()
    one = lambda s, hour: F.struct(hour.alias("hour_local"), F.lit(s).alias("scope"), metrics.scope_key(s).alias("key"))
    each = [one(s, F.lit(None).cast("int")) for s in daily] + [one(s, F.col("hour_local")) for s in hourly]
    return grain.select("flight_date_local", F.inline(F.array(*each))).where("key is not null").distinct()


# --- the state as a table: a partition a local day and batch ---


def fold_in(delta: DataFrame, folder: str, batch: int) -> None:
    """Add state rows to the table. Only the batch's own partitions are written, so that a batch
    that is run again leaves the same; nothing is read."""
    rows = delta.select(*STATE, "weight", F.col("flight_date_local").cast("string").alias("day"), F.lit(batch).cast("long").alias("batch"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(folder)


def held(spark: SparkSession, folder: str, days: list | None = None) -> DataFrame:
    """State rows of the table, of some days only if these are given."""
    schema = f"{', '.join(f'{c} {_KINDS.get(c, 'string')}' for c in STATE)}, weight long, day string, batch long"
    rows = spark.read.schema(schema).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], schema)
    return rows if days is None else rows.where(F.col("day").isin([str(d) for d in days]))


_KINDS = {"flight_date_local": "date", "hour_local": "int", "dow_local": "int", "raw_delay": "int"} | dict.fromkeys(FLAGS, "boolean")


def compacted(spark: SparkSession, folder: str, into: str, last: int) -> None:
    """The table with all batches up to `last` as one, in a new folder."""
    rows = held(spark, folder)
    old = fold(rows.where(F.col("batch") <= last)).withColumn("batch", F.lit(last).cast("long"))
    new = rows.where(F.col("batch") > last).select(*STATE, "weight", "batch")
    out = old.unionByName(new).withColumn("day", F.col("flight_date_local").cast("string"))
    out.write.partitionBy("day", "batch").parquet(into)

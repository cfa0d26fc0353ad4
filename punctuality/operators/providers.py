"""When a provider may be asked: spans of rest from the log of calls, and attempts held against them.

A rate-limited call asks for a pause, of its own length or the usual one; so many failures in a
row for the usual one; a success ends both, and a later rate-limited call puts its own pause in place of one
before. Neighbours in the log are found in ranges (see ranges), as a provider may have a third
of all calls; spans meet attempts by provider and hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctuality.operators import ranges
from punctuality.params import DEFAULT, Params

_BY, _ORDER = ("provider",), ("called_at", "call_id")


def _with_next(calls: DataFrame) -> DataFrame:
    """Adds next_at: when the provider was called next (of the calls given)."""
    micros = F.unix_micros(F.col("called_at").cast("timestamp"))
    turned = calls.withColumns({"_late": -micros, "_last": -F.col("call_id")})
    out = ranges.with_before(turned, _BY, ("_late", "_last"), ("called_at",), "_next")
    return out.withColumn("next_at", F.col("_next.called_at")).drop("_late", "_last", "_next")


def _seconds(n: Column | int, at: Column) -> Column:
    return F.timestamp_add("SECOND", n if isinstance(n, Column) else F.lit(n), at)


def rests(calls: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(provider, since, last): spans in which a provider rests, after since and up to last. calls
    (provider, called_at, call_id, ok, rate_limited, retry_after_s)."""
    log = calls.select(*_BY, *_ORDER, "ok", (F.col("rate_limited") & ~F.col("ok")).alias("limited"), "retry_after_s", (~F.col("ok")).alias("failed"))
    until = _seconds(F.coalesce("retry_after_s", F.lit(p.provider_recovery_s)).cast("int"), F.col("called_at"))
    marks = _with_next(log.where("ok or limited")).where("limited")
    # a pause is over at its end, so its last moment is a microsecond before
    paused = marks.select("provider", F.col("called_at").alias("since"), F.least(until - F.expr("INTERVAL 1 MICROSECOND"), "next_at").alias("last"))
    row = log.withColumn("run", F.col("failed"))  # this call and so many before it failed
    for _ in range(p.provider_failures - 1):
        before = ranges.with_before(row, _BY, _ORDER, ("run",))
        row = before.withColumn("run", F.col("failed") & F.coalesce(F.col("prev.run"), F.lit(False))).drop("prev")
    failed = _with_next(row).where("run")
    ill = failed.select("provider", F.col("called_at").alias("since"), F.least(_seconds(p.provider_recovery_s, F.col("called_at")), "next_at").alias("last"))
    return paused.unionByName(ill).where("last > since")


def resting(attempts: DataFrame, rests: DataFrame) -> DataFrame:
    """The attempts (provider, at, ...) that fall in a span."""
    hour = lambda c: F.date_trunc("HOUR", c)
    spans = rests.select("provider", "since", "last", F.explode(F.sequence(hour("since"), hour("last"), F.expr("INTERVAL 1 HOUR"))).alias("_hour"))
    asked = attempts.withColumn("_hour", hour("at"))
    same = (asked["provider"] == spans["provider"]) & (asked["_hour"] == spans["_hour"])
    return asked.join(spans, same & (asked["at"] > spans["since"]) & (asked["at"] <= spans["last"]), "left_semi").drop("_hour")


def answers(attempts: DataFrame, calls: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Attempts (attempt, provider, at, ...) with paused: whether the provider rested then, by the
    calls before."""
    at_rest = resting(attempts.select("attempt", "provider", "at"), rests(calls, p)).select("attempt", F.lit(True).alias("_rest"))
    return attempts.join(at_rest, "attempt", "left").withColumn("paused", F.coalesce("_rest", F.lit(False))).drop("_rest")

"""From observations to state: duplicates, merges of sources, the latest-state fold,
lifecycle events, staleness, health of providers.

All folds are single aggregates, which a hot leg doesn't hurt; predecessors are found in
ranges of flight and time (see ranges).
"""

from __future__ import annotations

import functools
import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctuality.functions import scalars
from punctuality.operators import ranges
from punctuality.params import DEFAULT, SETTLED, Params
from punctuality.session import exists, written
from punctuality.sources.adapters import SOURCES

FLIGHT = ("flight_number", "origin_iata", "destination_iata", "flight_date_local")
LEG = ("flight_number", "origin_iata", "destination_iata", "utc_day")
RANK = {s: i for i, s in enumerate(("UNKNOWN", "SCHEDULED", "BOARDING", "DELAYED", "DEPARTED", "DIVERTED", "CANCELLED", "ARRIVED"))}

# Fields merged by trust, those of them that are measured, and those that
# are predicted.
SIMPLE = (
    "flight_iata",
    "flight_icao",
    "airline_iata",
    "airline_icao",
    "airline_name",
    "scheduled_departure_utc",
    "scheduled_arrival_utc",
    "terminal",
    "gate",
    "aircraft_type",
    "aircraft_registration",
    "cancellation_reason",
    "codeshare_of",
)
OBSERVED = ("actual_departure_utc", "actual_arrival_utc")
PREDICTED = ("estimated_departure_utc", "estimated_arrival_utc")
FIELDS = (*SIMPLE, *OBSERVED, *PREDICTED)

# Of the latest state, what the last record sets, and what the last record
# sets that knows it (an empty text is not known).
OVERWRITTEN = (
    "scheduled_departure_utc",
    "estimated_departure_utc",
    "estimated_arrival_utc",
    "status",
    "is_cancelled",
    "is_diverted",
    "is_codeshare",
    "data_quality",
    "data_source",
)
STICKY = (
    "flight_iata",
    "flight_icao",
    "airline_iata",
    "airline_icao",
    "airline_name",
    "actual_departure_utc",
    "actual_arrival_utc",
    "scheduled_arrival_utc",
    "delay_minutes",
    "arrival_delay_minutes",
    "cancellation_reason",
    "terminal",
    "gate",
    "aircraft_type",
    "aircraft_registration",
    "codeshare_of",
)


def legs(rows: DataFrame) -> DataFrame:
    """Adds utc_day: duplicates are told by the UTC day of the schedule."""
    return rows.withColumn("utc_day", F.to_date("scheduled_departure_utc"))


def richness() -> Column:
    """How much a record tells."""
    fields = ("actual_departure_utc", "estimated_departure_utc", "actual_arrival_utc", "scheduled_arrival_utc", "terminal", "gate", "aircraft_type", "airline_iata")
    one = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0))
    return one + F.when(F.col("status") != "UNKNOWN", 2).otherwise(0) + F.when(F.col("data_quality") == "OK", 1).otherwise(0)


def _arrival() -> Column:
    return F.struct("observed_at", "observation_id")


def _kept(rows: DataFrame, keys: tuple[str, ...], best: Column, most: bool) -> DataFrame:
    """The row of each key with the most or least of best."""
    row = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg((F.max_by if most else F.min_by)(row, best).alias("r")).select(*keys, "r.*")


def _earlier() -> Column:
    """Rises for earlier rows, so that of equals the first seen wins."""
    return F.struct(-F.unix_micros(F.col("observed_at").cast("timestamp")), -F.col("observation_id"))


def dedup_richest(rows: DataFrame, *more: str) -> DataFrame:
    return _kept(rows, (*LEG, *more), F.struct(richness().alias("n"), _earlier().alias("e")), True)


def dedup_first(rows: DataFrame) -> DataFrame:
    return _kept(rows, LEG, _arrival(), False)


def dedup_settled(rows: DataFrame) -> DataFrame:
    rank = F.coalesce(*[F.when(F.col("status") == s, i) for s, i in RANK.items()])
    return _kept(rows, LEG, F.struct(rank.alias("n"), _earlier().alias("e")), True)


def best_per_source(rows: DataFrame) -> DataFrame:
    return dedup_richest(rows, "data_source")


def _differing() -> tuple[dict[str, Column], list[Column]]:
    """What the records of a group disagree on: sums that tell it, and from them the names. Times
    differ if their least and largest minute do (no count of distinct ones, which would
    read all rows once more for each)."""
    minute = lambda c: F.date_trunc("MINUTE", c)
    sums = {f"_differs_{c}": F.min(minute(c)) != F.max(minute(c)) for c in OBSERVED}
    sums |= {f"_differs_{c}": F.bool_and(c) != F.bool_or(c) for c in ("is_cancelled", "is_diverted")}
    return sums, [F.when(F.col(c), c.removeprefix("_differs_")) for c in sums]


def conflict_counts(rows: DataFrame, *by: str) -> DataFrame:
    """(leg, by, conflicts): how many fields the records of a leg (and of `by`) disagree on, as
    `merge` tells it, without merging any."""
    sums, names = _differing()
    kinds = rows.groupBy(*LEG, *by, "is_mock").agg(*[v.alias(c) for c, v in sums.items()])
    n = sum((F.when(name.isNotNull(), 1).otherwise(0) for name in names), F.lit(0))
    of = lambda mock: F.max(F.when(F.col("is_mock") == mock, F.col("_n")))
    return kinds.withColumn("_n", n).groupBy(*LEG, *by).agg(F.coalesce(of(False), of(True)).alias("conflicts"))


def merge(rows: DataFrame, trust: tuple[str, ...] = SOURCES, p: Params = DEFAULT, by: tuple[str, ...] = ()) -> DataFrame:
    """All records of a leg (and of `by`, such as a run) as one: each field of the most trusted source that has it (of
    one source, the first record), with where it came from; flags of the most trusted;
    status, delays and quality derived anew from the merged times; what the records
    disagree on. A single record passes through as it is, every field its own. Mock
    records never meet real ones: both kinds are merged apart in one aggregate, then the
    real one is kept where there is one."""
    place = F.coalesce(*[F.when(F.col("data_source") == s, i) for i, s in enumerate(trust)], F.lit(len(trust)))
    rank = F.struct(place, F.col("observed_at"), F.col("observation_id"))
    told, keys = ("delay_minutes", "arrival_delay_minutes"), (*LEG, *by)
    first = lambda c: F.min_by(F.struct(F.col(c).alias("v"), F.col("data_source").alias("s")), F.when(F.col(c).isNotNull(), rank)).alias(c)
    sums, differ = _differing()
    base = F.struct("status", "raw_status", "is_cancelled", "is_diverted", "is_codeshare", *told, "data_quality", "data_source", "run_id", "observed_at")
    grouped = rows.groupBy(*keys, "is_mock").agg(
        *[first(c) for c in FIELDS],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(f"_{c}") for c in told],
        F.min_by(base, rank).alias("base"),
        F.count("*").alias("_n"),
        F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col("data_source").alias("s")))).alias("_all"),
        *[v.alias(c) for c, v in sums.items()],
    )
    row = F.struct(*[c for c in grouped.columns if c not in keys])
    kept = grouped.groupBy(*keys).agg(F.min_by(row, "is_mock").alias("g"), F.sum("_n").alias("records")).select(*keys, "records", "g.*")
    v = lambda c: F.col(c)["v"]
    alone = F.col("_n") == 1
    own = lambda c, derived: F.when(alone, F.col(f"base.{c}")).otherwise(derived)
    late = scalars.delay(v("scheduled_departure_utc"), v("estimated_departure_utc"), v("actual_departure_utc"), F.col("_delay_minutes"))
    landed = scalars.delay(v("scheduled_arrival_utc"), v("estimated_arrival_utc"), v("actual_arrival_utc"), F.col("_arrival_delay_minutes"))
    looked_up = kept.withColumns({"_late": late, "_landed": landed, "_mapped": scalars.status(F.col("base.raw_status"))})
    times = v("actual_departure_utc"), v("actual_arrival_utc")
    status = scalars.resolve_known(F.col("_mapped"), F.col("base.is_cancelled"), F.col("base.is_diverted"), *times, F.col("_late"), p)
    out = looked_up.withColumn("status", own("status", status)).withColumns(
        {
            "delay_minutes": own("delay_minutes", scalars.without_delay(F.col("status"), F.col("_late"))),
            "arrival_delay_minutes": own("arrival_delay_minutes", scalars.without_delay(F.col("status"), F.col("_landed"))),
        }
    )
    graded = scalars.quality(F.col("status"), v("scheduled_departure_utc"), F.col("delay_minutes"), v("scheduled_arrival_utc").isNotNull())
    named = [F.when(alone | F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), F.when(alone, F.col("base.data_source")).otherwise(F.col(c)["s"]).alias("value"))) for c in FIELDS]
    named += [F.when(~alone, F.struct(F.lit(c).alias("key"), F.col("base.data_source").alias("value"))) for c in ("is_cancelled", "is_diverted")]
    named += [F.when(~alone, F.struct(F.lit(c).alias("key"), F.lit("derived").alias("value"))) for c in ("status", "delay_minutes")]
    return out.select(
        *LEG,
        *[v(c).alias(c) for c in FIELDS],
        "status",
        "delay_minutes",
        "arrival_delay_minutes",
        own("is_cancelled", F.col("base.is_cancelled") | (F.col("status") == "CANCELLED")).alias("is_cancelled"),
        own("is_diverted", F.col("base.is_diverted") | (F.col("status") == "DIVERTED")).alias("is_diverted"),
        F.col("base.is_codeshare").alias("is_codeshare"),
        own("data_quality", graded).alias("data_quality"),
        F.array_join("_all.s", "+").alias("data_source"),
        "is_mock",
        *([] if "run_id" in by else [F.col("base.run_id").alias("run_id")]),
        *by,
        F.col("base.observed_at").alias("observed_at"),
        F.map_from_entries(F.array_compact(F.array(*named))).alias("field_sources"),
        F.when(alone, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*differ))).alias("conflicts"),
        "records",
    )


def merge_summary(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """What went in, legs that came out, legs of more than one record, disagreements."""
    counts = merged.agg(
        F.count("*").alias("merged_flights"), F.count_if(F.col("records") > 1).alias("enriched"), F.coalesce(F.sum(F.size("conflicts")), F.lit(0)).alias("conflicts")
    )
    return rows.agg(F.count("*").alias("input_records")).crossJoin(counts)  # one row each


# --- the latest state ---


def state_of(rows: DataFrame) -> DataFrame:
    """What records say of each flight, in a form that folds with more of it in any order
    and number of parts: every field beside the time and id of the record that it is of."""
    at = _arrival()
    told = [c for c in ("field_sources",) if c in rows.columns]
    known = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "") if c not in told else F.size(c) > 0
    stamped = lambda c: F.when(known(c), F.struct(at.alias("at"), F.col(c).alias("v")))
    # the greatest of a stamped value is the last: its time comes first (maps have no order)
    return rows.groupBy(*FLIGHT).agg(
        F.max_by(F.struct(*OVERWRITTEN), at).alias("last"),
        F.max(at).alias("last_at"),
        *[F.max(stamped(c)).alias(c) for c in STICKY],
        *[F.max_by(stamped(c), F.when(known(c), at)).alias(c) for c in told],
        F.min_by("scheduled_departure_utc", at).alias("first_schedule"),
        F.min(at).alias("first_at"),
        F.bool_and("is_mock").alias("is_mock"),
        F.count("*").alias("observation_count"),
    )


def fold_states(states: DataFrame, *by: str) -> DataFrame:
    """State rows of one flight as one; in whatever order they come, the result is that
    of all their records at once. by: columns that a flight's rows agree on, which are kept."""
    told = [c for c in ("field_sources",) if c in states.columns]
    return states.groupBy(*by, *FLIGHT).agg(
        F.max_by("last", "last_at").alias("last"),
        F.max("last_at").alias("last_at"),
        *[F.max(c).alias(c) for c in STICKY],
        *[F.max_by(c, F.col(c)["at"]).alias(c) for c in told],
        F.min_by("first_schedule", "first_at").alias("first_schedule"),
        F.min("first_at").alias("first_at"),
        F.bool_and("is_mock").alias("is_mock"),
        F.sum("observation_count").alias("observation_count"),
    )


def flights_of(states: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The flights that state rows stand for, with local hour and day of week."""
    local = scalars.local(F.col("last.scheduled_departure_utc"), p.zone)
    sticky = [c for c in states.columns if c in (*STICKY, "field_sources")]
    return states.select(
        *FLIGHT,
        *[(F.left(f"last.{c}", F.lit(120)) if c == "data_source" else F.col(f"last.{c}")).alias(c) for c in OVERWRITTEN],
        F.hour(local).alias("scheduled_hour_local"),
        (F.weekday(local) + 1).alias("scheduled_dow_local"),
        *[F.col(c)["v"].alias(c) for c in sticky],
        F.col("first_schedule").alias("first_scheduled_departure_utc"),
        F.col("first_at.observed_at").alias("first_seen_at"),
        F.col("last_at.observed_at").alias("last_seen_at"),
        "is_mock",
        "observation_count",
    )


def latest_state(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The latest state of each flight in one aggregate: some fields take the last
    record's value, some the last that is known, some the first; counts add up."""
    return flights_of(state_of(rows), p)


def displacement(flights: DataFrame) -> DataFrame:
    """Adds how far the schedule moved since it was first told, in minutes, and that and
    the delay together (null if neither is known)."""
    moved = F.floor((F.unix_micros(F.col("scheduled_departure_utc").cast("timestamp")) - F.unix_micros(F.col("first_scheduled_departure_utc").cast("timestamp"))) / 60_000_000).cast("int")
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = F.when(F.col("schedule_moved_minutes").isNotNull() | F.col("delay_minutes").isNotNull(), zero("schedule_moved_minutes") + zero("delay_minutes"))
    return flights.withColumn("schedule_moved_minutes", moved).withColumn("total_displacement_minutes", total)


SNAPSHOT = (*FLIGHT, "run_id", "data_source")


def append_observations(new: DataFrame, held: DataFrame, keys: tuple[str, ...] = SNAPSHOT) -> DataFrame:
    """The new snapshots that history doesn't hold: one of a flight, run and source. Give
    history pruned to the runs of the batch (see `append`)."""
    return _kept(new, keys, _arrival(), False).join(held.select(*keys), list(keys), "left_anti")


def append(new: DataFrame, path: str) -> None:
    """Append the new snapshots to the history in path, which is partitioned by the day of
    the run. Of what is there only the partitions of the batch's runs are read (a batch
    is of few runs), so the cost is that of the batch, not of history."""
    spark = new.sparkSession
    dated = new.withColumn("run_day", F.left("run_id", F.lit(8)))
    days = [r["run_day"] for r in dated.select("run_day").distinct().collect()]
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        held = spark.read.schema(dated.schema).parquet(path).where(F.col("run_day").isin(days))
        fresh = append_observations(dated, held)
    else:
        fresh = _kept(dated, SNAPSHOT, _arrival(), False)
    fresh.write.mode("append").partitionBy("run_day").parquet(path)


def fresh_snapshots(new: DataFrame, held: DataFrame) -> DataFrame:
    """New snapshots as history keeps them (with run_day), against what it holds already."""
    return append_observations(new.withColumn("run_day", F.left("run_id", F.lit(8))), held)


TABLES = ("airlines", "flights", "observations", "events", "runs")


def tables(rows: DataFrame, p: Params = DEFAULT) -> dict[str, DataFrame]:
    """The five history tables that observations make."""
    runs = rows.groupBy("run_id").agg(F.max("observed_at").alias("finished_at"), F.count("*").alias("observations"))
    return dict(zip(TABLES, (airlines(rows), latest_state(rows, p), rows, derive_events(rows, p), runs), strict=True))


def export(rows: DataFrame, path: str, p: Params = DEFAULT) -> None:
    export_tables(tables(rows, p), path)


def export_tables(made: dict[str, DataFrame], path: str) -> None:
    """Write the history tables as Parquet, a folder each, and last a manifest of what was written: of each
    table its rows and its schema."""
    spark = made["flights"].sparkSession
    for name, table in made.items():
        table.write.parquet(f"{path}/{name}")
    held = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    schemas = spark.createDataFrame([(name, held[name].schema.json()) for name in TABLES], "table_name string, schema string")  # a row a table
    count_rows(held).join(F.broadcast(schemas), "table_name").coalesce(1).write.json(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that `export` wrote, read by their own schemas. An export that wasn't finished, or
    a table that has other rows than it says, is an error."""
    if not exists(spark, f"{path}/manifest/_SUCCESS"):
        raise ValueError(f"{path}: no finished export")
    told = {r["table_name"]: r for r in spark.read.schema("table_name string, n long, schema string").json(f"{path}/manifest").collect()}
    if sorted(told) != sorted(TABLES):
        raise ValueError(f"{path}: tables {sorted(told)}, not {sorted(TABLES)}")
    held = {name: spark.read.schema(T.StructType.fromJson(json.loads(told[name]["schema"]))).parquet(f"{path}/{name}") for name in TABLES}
    for r in count_rows(held).collect():
        if r["n"] != told[r["table_name"]]["n"]:
            raise ValueError(f"{path}: {r['table_name']} has {r['n']} rows, not {told[r['table_name']]['n']}")
    return held


def count_rows(held: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of tables."""
    each = [table.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, table in held.items()]
    return functools.reduce(DataFrame.unionByName, each)


def importable(new: dict[str, DataFrame], held: DataFrame) -> dict[str, DataFrame]:
    """What an import takes of history tables: nothing if there are flights already (held);
    else no mock flights and none of their observations and events."""
    if held.limit(1).count():
        return {name: table.limit(0) for name, table in new.items()}
    keep = new["flights"].where("not is_mock")
    with_ = lambda name: new[name].join(keep.select(*FLIGHT), list(FLIGHT), "left_semi")
    return new | {"flights": keep, "observations": with_("observations"), "events": with_("events")}


def first_schedule(flights: DataFrame, rows: DataFrame) -> DataFrame:
    """Flights with the earliest schedule that was ever observed, else their own."""
    least = rows.groupBy(*FLIGHT).agg(F.min("scheduled_departure_utc").alias("_first"))
    return flights.join(least, list(FLIGHT), "left").withColumn("first_scheduled_departure_utc", F.coalesce("_first", "scheduled_departure_utc")).drop("_first")


def airlines(rows: DataFrame) -> DataFrame:
    """Airlines that the records name: by IATA code, else by ICAO code; under the newest
    name, else their code. The first code of the other kind that goes with it is filled in;
    an ICAO code that goes with an IATA code is no airline of its own, in whatever order
    the two were told."""
    code = lambda c: F.nullif(F.col(c), F.lit(""))
    at = _arrival()
    told = rows.select(code("airline_iata").alias("iata"), code("airline_icao").alias("icao"), code("airline_name").alias("name"), at.alias("at")).where("iata is not null or icao is not null")
    pairs = told.where("iata is not null and icao is not null").groupBy("icao").agg(F.min_by("iata", "at").alias("_iata"))
    known = told.join(pairs, "icao", "left").withColumn("key", F.coalesce("iata", "_iata", F.concat(F.lit("icao "), F.col("icao"))))
    out = known.groupBy("key").agg(
        F.min_by("iata", F.when(F.col("iata").isNotNull(), F.col("at"))).alias("iata"),
        F.min_by("icao", F.when(F.col("icao").isNotNull(), F.col("at"))).alias("icao"),
        F.max_by("name", F.when(F.col("name").isNotNull(), F.col("at"))).alias("name"),
    )
    return out.select("iata", "icao", F.coalesce("name", "iata", "icao").alias("name"))


def with_previous(rows: DataFrame, per_source: bool = False) -> DataFrame:
    """Adds prev: the record of the flight before (in time, then id). Flights and times are
    sorted in ranges, so that a flight with a third of all rows is no task's alone."""
    keys = (*FLIGHT, "data_source") if per_source else FLIGHT
    fields = ("observation_id", "status", "delay_minutes", "gate", "terminal", "scheduled_departure_utc")
    return ranges.with_before(rows, keys, ("observed_at", "observation_id"), fields)


def derive_events(rows: DataFrame, p: Params = DEFAULT, more: tuple[str, ...] = ()) -> DataFrame:
    """What changed from each record's predecessor, an event a row, in a fixed order. more: columns of
    the record that its events carry."""
    needed = (*FLIGHT, "observation_id", "observed_at", "data_source", "status", "delay_minutes", "gate", "terminal", "scheduled_departure_utc", *more)
    return events_of(with_previous(rows.select(*needed)), p, more=more)


def events_of(rows: DataFrame, p: Params = DEFAULT, revised: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Events of rows that carry their predecessor as `prev` (null for none). revised: a
    column that says how often a row's events were told before; if so, REVISED is first."""
    prev, first = (lambda c: F.col("prev")[c]), F.col("prev").isNull()
    text = lambda c: F.left(c.cast("string"), F.lit(120))
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    none = F.lit(None).cast("string")

    def event(when: Column, kind: Column | str, old: Column, new: Column) -> Column:
        return F.when(when, F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("event_type"), old.alias("previous_value"), new.alias("new_value")))

    status, moved = F.col("status"), ~first & (prev("status") != F.col("status"))
    both = prev("delay_minutes").isNotNull() & F.col("delay_minutes").isNotNull()
    change = F.col("delay_minutes") - prev("delay_minutes")
    late = ~first & prev("delay_minutes").isNull() & (F.col("delay_minutes") >= p.delay_threshold)
    changed = lambda c: ~first & F.col(c).isNotNull() & (F.col(c) != "") & ~prev(c).eqNullSafe(F.col(c))
    again = [] if revised is None else [event(F.col(revised) > 0, "REVISED", none, none)]
    found = F.array(
        *again, event(first, "FIRST_SEEN", none, status), event(first & (status == "CANCELLED"), "CANCELLED", none, status),
        event(moved, "STATUS_CHANGED", prev("status"), status), event(moved & status.isin("CANCELLED", "DIVERTED", "DEPARTED", "ARRIVED"), status, prev("status"), status),
        event(~first & both & (change >= p.delay_jitter), "DELAY_INCREASED", text(prev("delay_minutes")), text(F.col("delay_minutes"))),
        event(~first & both & (change <= -p.delay_jitter), "DELAY_DECREASED", text(prev("delay_minutes")), text(F.col("delay_minutes"))),
        event(late, "DELAY_INCREASED", none, text(F.col("delay_minutes"))), event(changed("gate"), "GATE_CHANGED", text(prev("gate")), text(F.col("gate"))), event(changed("terminal"), "TERMINAL_CHANGED", text(prev("terminal")), text(F.col("terminal"))),
        event(~first & (prev("scheduled_departure_utc") != F.col("scheduled_departure_utc")), "SCHEDULE_CHANGED", time(prev("scheduled_departure_utc")), time(F.col("scheduled_departure_utc"))),
    )
    return rows.select(*FLIGHT, "observation_id", F.col("observed_at").alias("occurred_at"), "data_source", *([revised] if revised else []), *more, F.inline(F.array_compact(found)))


SEEN = ("observed_at", "observation_id", "status", "delay_minutes", "data_source")
TOLD = ("occurred_at", "observation_id", "event_type", "previous_value", "new_value")


def detail(flights: DataFrame, rows: DataFrame, events: DataFrame) -> DataFrame:
    """Flights as they are, each with its observations and its events as arrays of structs in the order
    of time. A flight has as many of both as it was seen: what is asked for is one
    document a flight, so filter before it."""
    in_order = lambda df, fields, name: df.groupBy(*FLIGHT).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    seen, told = in_order(rows, SEEN, "observations"), in_order(events, TOLD, "events")
    return flights.join(seen, list(FLIGHT), "left").join(told, list(FLIGHT), "left")


def mark_stale(flights: DataFrame, seen: DataFrame, origins: DataFrame, as_of: datetime, p: Params = DEFAULT) -> DataFrame:
    """Flights that a board we read has stopped telling of: quality STALE, status as it
    was. seen: flights of this cycle; origins: boards that were read (a few rows)."""
    cutoff = F.lit(str(as_of)).cast("timestamp_ntz") - F.expr(f"INTERVAL {p.stale_minutes} MINUTES")
    open_ = flights.where((F.col("last_seen_at") < cutoff) & (F.col("data_quality") != "STALE") & ~F.col("status").isin(*SETTLED))
    gone = open_.join(origins, "origin_iata", "left_semi").join(seen.select(*FLIGHT), list(FLIGHT), "left_anti")
    return gone.withColumn("data_quality", F.lit("STALE")).withColumn("event_type", F.lit("WENT_STALE"))


def provider_health(calls: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Totals of each provider and its failures since it last worked, from one log: the
    trailing failures are those later than the last success, in two aggregates (a
    provider may have a third of all calls, so no window over its rows). A rate-limited
    call asks for a pause, of its own length or the usual one; a later success ends it.
    open_at: when the provider may be asked again (null: at once)."""
    at = F.struct("called_at", "call_id")
    last_ok = calls.groupBy("provider").agg(F.max(F.when(F.col("ok"), at)).alias("_ok"))
    rows = calls.join(last_ok, "provider")  # a row a provider: adaptive execution broadcasts it by its measured size
    since = ~F.col("ok") & (F.col("_ok").isNull() | (at > F.col("_ok")))
    pause = F.timestamp_add("SECOND", F.coalesce("retry_after_s", F.lit(p.provider_recovery_s)), F.col("called_at"))
    out = rows.groupBy("provider").agg(
        F.count("*").alias("total_calls"),
        F.count_if(~F.col("ok")).alias("total_failures"),
        F.count_if(since).alias("consecutive_failures"),
        F.max(F.when(F.col("ok"), F.col("called_at"))).alias("last_success_at"),
        F.max(F.when(~F.col("ok"), F.col("called_at"))).alias("last_failure_at"),
        F.max_by(pause, F.when(since & F.col("rate_limited"), at)).alias("cooldown_until"),
    )
    rested = F.when(F.col("consecutive_failures") >= p.provider_failures, F.timestamp_add("SECOND", F.lit(p.provider_recovery_s), F.col("last_failure_at")))
    return out.withColumn("healthy", F.col("consecutive_failures") < p.provider_failures).withColumn("open_at", F.greatest("cooldown_until", rested))


def failover(answers: DataFrame, trust: tuple[str, ...] = SOURCES) -> DataFrame:
    """(run_id, origin_iata, data_source): of each run and origin the first source in the
    order of trust that answered. answers (run_id, origin_iata, data_source, ok, paused): a row an
    attempt; an empty board that came is an answer too, a failed or paused source none."""
    place = F.coalesce(*[F.when(F.col("data_source") == s, i) for i, s in enumerate(trust)], F.lit(len(trust)))
    usable = answers.where(F.col("ok") & ~F.col("paused"))
    return usable.groupBy("run_id", "origin_iata").agg(F.min_by("data_source", F.struct(place, F.col("data_source"))).alias("data_source"))


def stored(rows: DataFrame) -> DataFrame:
    """The snapshots that a run keeps of what its sources told: of a leg and source the
    richest record, of a flight, run and source one."""
    best = dedup_richest(legs(rows), "run_id", "data_source")
    return _kept(best, SNAPSHOT, _arrival(), False)


def went_stale(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(run_id, stale_marked): how many flights each run found gone: last told of more than
    stale_minutes before a run that read their origin's board, still open, and not told of by then. Each row
    of a flight has one run at most that can find it so: the first after its time is up."""
    micros = F.unix_micros(F.col("observed_at").cast("timestamp"))
    turned = rows.select(*FLIGHT, "status", "observed_at", (-micros).alias("_late"), (-F.col("observation_id")).alias("_last"))
    told = ranges.with_before(turned, FLIGHT, ("_late", "_last"), ("observed_at",), "_next").where(~F.col("status").isin(*SETTLED))
    due = told.select("origin_iata", F.timestamp_add("MINUTE", F.lit(p.stale_minutes), F.col("observed_at")).alias("due"), F.col("_next.observed_at").alias("next"))
    read = rows.groupBy("origin_iata", "run_id").agg(F.max("observed_at").alias("finished"))
    spans = ranges.with_before(read, ("origin_iata",), ("finished", "run_id"), ("finished",))
    spans = spans.withColumn("since", F.coalesce("prev.finished", F.col("finished") - F.expr("INTERVAL 1 DAY")))
    hour = lambda c: F.date_trunc("HOUR", c)
    hours = F.explode(F.sequence(hour("since"), hour("finished"), F.expr("INTERVAL 1 HOUR")))
    met = due.withColumn("hour", hour("due")).join(spans.select("origin_iata", "run_id", "since", "finished", hours.alias("hour")), ["origin_iata", "hour"])
    gone = met.where((F.col("due") >= F.col("since")) & (F.col("due") < F.col("finished")) & (F.col("next").isNull() | (F.col("next") > F.col("finished"))))
    return gone.groupBy("run_id").agg(F.count("*").alias("stale_marked"))


def run_summary(rows: DataFrame, configured: tuple[str, ...] = ("IST",), p: Params = DEFAULT) -> DataFrame:
    """Counters of each collection run, in which all sources' records are merged by leg:
    flights seen, made and updated; snapshots and events written; cancellations and delays
    as the events tell them; records beyond one a leg; legs of several records; what they
    disagree on; origins that gave nothing; flights found gone stale. What the counters share is
    written once, and each reads the columns that it needs."""
    rows = written(rows, "run-rows")
    by_run = lambda df, *counts: df.groupBy("run_id").agg(*counts)
    seen = by_run(
        legs(rows).groupBy("run_id", *LEG).agg(F.count("*").alias("n")),
        F.count("*").alias("flights_seen"), (F.sum("n") - F.count("*")).alias("duplicates_skipped"), F.count_if(F.col("n") > 1).alias("enriched_flights"),
    )
    origins = by_run(rows, F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, configured)), F.collect_set("origin_iata"))), ",").alias("missing_origins"))
    created = by_run(rows.groupBy(*FLIGHT).agg(F.min("run_id").alias("run_id")), F.count("*").alias("flights_created"))
    kept = written(stored(rows), "run-snapshots")
    snapshots = by_run(kept, F.count("*").alias("observations_written"), F.count_distinct("data_source").alias("providers"))
    told = lambda kind, name: F.count_if(F.col("event_type") == kind).alias(name)
    events = by_run(
        derive_events(kept, p, ("run_id",)),
        F.count("*").alias("events_written"), told("CANCELLED", "cancellations_detected"), told("DELAY_INCREASED", "delays_detected"),
    )
    conflicts = by_run(conflict_counts(legs(rows), "run_id"), F.sum("conflicts").alias("merge_conflicts"))
    out = seen.join(origins, "run_id")
    for more in (created, snapshots, events, conflicts, went_stale(rows, p)):
        out = out.join(more, "run_id", "left")
    counts = ["stale_marked", "flights_created", "observations_written", "providers", "events_written", "cancellations_detected", "delays_detected", "merge_conflicts"]
    return out.fillna(0, counts).withColumn("flights_updated", F.col("flights_seen") - F.col("flights_created"))

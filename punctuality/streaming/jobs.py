"""The collection cycle as Structured Streaming jobs.

All take a streaming DataFrame of observations (see sources.adapters) whose event time is
`seen_at`. Whatever the order and the number of micro-batches that rows come in, and
however often a batch is run again, the outcome is that of the batch jobs over all rows
that weren't later than the watermark (two days).
"""

from __future__ import annotations

import functools
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctuality.operators import alerts, history, insights, metrics, statistics
from punctuality.params import DEFAULT, SETTLED, Params
from punctuality.session import exists, shared_path, written
from punctuality.streaming.state import HOUR, SNAP, STALE, Predecessors, Silence, keyed_state

LATE = "2 days"
#: Parts that an origin's flights are dealt to; rows of a local day that go into a part of it.
BUCKETS, PART_ROWS = 64, 50_000
_KEYS = "flight_number string, origin_iata string, destination_iata string, flight_date_local string"


def timed(observations: DataFrame) -> DataFrame:
    return observations.withColumn("seen_at", F.col("observed_at").cast("timestamp")).withWatermark("seen_at", LATE)


# --- events ---


def events(observations: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Lifecycle events as observations come in: the state only gives each row its
    predecessor, the difference is the batch job's own expression. A late row gets its
    right predecessor, and its successor's events are told again, under the next revision,
    after one that says REVISED; `last_word` keeps what counts."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    rows = timed(observations).select(
        *history.FLIGHT[:3],
        F.col("flight_date_local").cast("string").alias("flight_date_local"),
        *SNAP[:-1],
        text("scheduled_departure_utc").alias("scheduled"),
        text("observed_at").alias("seen"),
        F.unix_micros("seen_at").alias("micros"),
        "data_source",
        "seen_at",
    )
    kinds = ("long", "string", "int", "string", "string", "string")
    snap = ", ".join(f"{c} {k}" for c, k in zip(SNAP, kinds, strict=True))
    before = ", ".join(f"p{i} {k}" for i, k in enumerate(kinds))
    keyed_state(observations.sparkSession)
    joined = rows.groupBy(*history.FLIGHT).transformWithStateInPandas(
        Predecessors(), f"{_KEYS}, {snap}, seen string, data_source string, revision int, {before}", "append", "eventTime"
    )
    fields = [F.col(f"p{i}").alias(c) for i, c in enumerate(SNAP[:-1])]
    prev = F.when(F.col("p0").isNotNull(), F.struct(*fields, F.col("p5").cast("timestamp_ntz").alias("scheduled_departure_utc")))
    back = joined.withColumns(
        {
            "prev": prev,
            "scheduled_departure_utc": F.col("scheduled").cast("timestamp_ntz"),
            "observed_at": F.col("seen").cast("timestamp_ntz"),
            "flight_date_local": F.col("flight_date_local").cast("date"),
        }
    )
    return history.events_of(back, p, revised="revision")


def last_word(told: DataFrame) -> DataFrame:
    """Of each observation the events of its last revision. Only those that were told again (whose
    later revisions say so) are looked for."""
    again = told.where("revision > 0").groupBy("observation_id").agg(F.max("revision").alias("_last"))
    last = told.join(again, "observation_id", "left").where(F.col("revision") == F.coalesce("_last", F.lit(0)))
    return last.where("event_type <> 'REVISED'").select(*[c for c in told.columns if c != "revision"])


_TOLD = (*history.FLIGHT, "observation_id", "observed_at", "data_source", "status", "delay_minutes", "gate", "terminal", "scheduled_departure_utc")


def tell_batch(batch: DataFrame, k: int, folder: str) -> None:
    """Tell the events of a micro-batch: its new rows, and rows that have another predecessor by it, go into
    the table in folder, each with its predecessor and how often it was told before. The table has a
    partition a local day and batch; of what is there the days and flights that the batch touches are
    read, and a batch that is run again writes its own partitions again."""
    spark, new = batch.sparkSession, batch.select(*_TOLD)
    days = [str(d) for d in _listed(new, "flight_date_local")]
    if not days:
        return
    one = [*history.FLIGHT, "observation_id"]
    new = new.dropDuplicates(one).withColumns({"revision": F.lit(None).cast("int"), "was": F.lit(None).cast("long")})
    if exists(spark, folder):
        old = spark.read.parquet(folder).where(F.col("day").isin(days) & (F.col("batch") < k))
        touched = old.join(new.select(*history.FLIGHT).distinct(), list(history.FLIGHT), "left_semi")
        # of a row only what was told last counts; its own fields never change
        held = touched.groupBy(*one).agg(F.max_by(F.struct(*_TOLD[5:], F.col("prev.observation_id").alias("was")), "revision").alias("r"), F.max("revision").alias("revision")).select(*one, "r.*", "revision")
        new = new.join(held.select(*one), one, "left_anti").unionByName(held)
    told = history.with_previous(new).where(F.col("revision").isNull() | ~F.col("prev.observation_id").eqNullSafe(F.col("was")))
    out = told.withColumns({"revision": F.coalesce(F.col("revision") + 1, F.lit(0)), "day": F.col("flight_date_local").cast("string"), "batch": F.lit(k).cast("long")})
    out.drop("was").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(folder)


def tell(observations: DataFrame, folder: str):
    """Start a stream that tells events as `events` does, from a table in place of a state store:
    a large batch is told by the batch job's own sort, not flight by flight. No row is too late."""
    return observations.writeStream.foreachBatch(lambda batch, k: tell_batch(batch, k, folder))


def told_now(spark: SparkSession, folder: str, p: Params = DEFAULT) -> DataFrame:
    """The events that the table in folder tells, with revisions (see last_word)."""
    return history.events_of(spark.read.parquet(folder), p, revised="revision")


# --- counts, statistics and alerts ---


def hourly_counts(observations: DataFrame) -> DataFrame:
    """Observations of each hour and origin; late rows open their hour again."""
    by = timed(observations).groupBy(F.window("seen_at", "1 hour").alias("w"), "origin_iata")
    return by.agg(F.count("*").alias("n"), F.count_if("is_cancelled").alias("cancelled")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "origin_iata", "n", "cancelled")


def _listed(rows: DataFrame, column: str) -> list:
    """The values of a column of one micro-batch: days or runs, so few."""
    return [r[0] for r in rows.select(column).distinct().collect()]


def facts_of(flights: DataFrame) -> DataFrame:
    return metrics.facts(flights.withColumns({"hour_local": F.col("scheduled_hour_local"), "dow_local": F.col("scheduled_dow_local")}))


def restate(before: DataFrame, after: DataFrame, days: list, k: int, folder: str, p: Params = DEFAULT) -> None:
    """Bring the statistics in folder (state, and what is published of it: daily) up to what
    batch k made of flights: what they were goes out of the state, what they are goes in, and
    the touched days are rolled up from it. No other flight is read. A batch that is run
    again leaves the same."""
    spark, state = after.sparkSession, f"{folder}/state"
    statistics.fold_in(statistics.changes(facts_of(before), facts_of(after)), state, k)
    insights.write_statistics(insights.daily_of(statistics.held(spark, state, days), p), f"{folder}/daily")


def alerts_once(observations: DataFrame) -> DataFrame:
    """Cancellation alerts, each key once in the stream; the ledger (see send_once) is the
    guarantee beyond the watermark."""
    return timed(observations.where("is_cancelled")).withColumn("dedup_key", alerts.cancellation_key()).dropDuplicatesWithinWatermark(["dedup_key"]).select("dedup_key")


def send_once(built: DataFrame, ledger: str):
    """Start a stream of alerts (dedup_key and more) into a ledger, a partition a batch:
    only keys go in that no earlier batch holds, and a batch that is run again writes its
    own partition again."""

    def each(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        held = spark.read.schema("dedup_key string, batch long").parquet(ledger).where(F.col("batch") < k) if exists(spark, ledger) else None
        new = batch.dropDuplicates(["dedup_key"])
        new = new if held is None else alerts.unsent(new, held.select("dedup_key"))
        new.withColumn("batch", F.lit(k).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(ledger)

    return built.writeStream.foreachBatch(each)


def stale(observations: DataFrame, boards: DataFrame, p: Params = DEFAULT, buckets: int = BUCKETS) -> DataFrame:
    """Flights that haven't settled and that the boards of their origin, which were read, have told
    nothing of for stale_minutes of event time; their status stays. boards (origin_iata, read_at,
    ok): a stream of boards asked for, whether they were read or not; one that failed makes
    nothing stale. Each flight lies in one of `buckets` of its origin, to all of which a board goes."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    day, bucket = F.col("flight_date_local").cast("string"), F.pmod(F.xxhash64(*history.FLIGHT), F.lit(buckets)).cast("int")
    rows = observations.select(
        F.lit("seen").alias("kind"), "origin_iata", bucket.alias("bucket"), "flight_number", "destination_iata", day.alias("flight_date_local"),
        "observation_id", "status", micros("observed_at").alias("micros"), F.col("observed_at").cast("timestamp").alias("seen_at"),
    )
    none, every = F.lit(None).cast("string"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    read = boards.where("ok").select(
        F.lit("read").alias("kind"), "origin_iata", every.alias("bucket"), none.alias("flight_number"), none.alias("destination_iata"), none.alias("flight_date_local"),
        F.lit(0).cast("long").alias("observation_id"), none.alias("status"), micros("read_at").alias("micros"), F.col("read_at").cast("timestamp").alias("seen_at"),
    )
    keyed_state(observations.sparkSession)
    both = rows.unionByName(read).withWatermark("seen_at", LATE)
    return both.groupBy("origin_iata", "bucket").transformWithStateInPandas(
        Silence(p.stale_minutes * 60_000), f"{_KEYS}, status string, event_type string", "append", "eventTime"
    )


_WATCHED = "origin_iata string, micros long"


def watch_batch(batch: DataFrame, k: int, folder: str, p: Params = DEFAULT) -> None:
    """One micro-batch of rows and boards (kind "read") into the table of flights' last rows in folder, a
    version a batch, and the flights that went stale by it into a partition of its own. By the
    watermark of all that came (two days behind the latest) all rows of before are there: what
    is later than that of the batches before is dropped, and boards count when it has passed them.
    Of flights the table has those that a board may still find: the last two days before the newest one.
    A batch that is run again reads the version before its own."""
    spark, late_ms = batch.sparkSession, 2 * 86_400_000
    ms = lambda c: F.floor(F.col(c) / 1000)
    there = spark.read.schema(f"{_WATCHED}, batch long").parquet(f"{folder}/boards").where(F.col("batch") < k) if exists(spark, f"{folder}/boards") else spark.createDataFrame([], f"{_WATCHED}, batch long")
    latest = lambda rows: rows.agg(F.max(ms("micros"))).first()[0] or 0
    before = latest(there)
    upto, passed = before - late_ms, max(before, latest(batch)) - late_ms
    came = batch.where(ms("micros") > upto)
    top = spark.createDataFrame([(None, (passed + late_ms) * 1000)], _WATCHED)  # tells how far time came
    read = came.where("kind = 'read'").select("origin_iata", "micros").unionByName(top)
    read.withColumn("batch", F.lit(k).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/boards")
    last = lambda held, status: F.struct("micros", "observation_id", F.lit(held).alias("held"), status.alias("status"))
    rows = came.where("kind = 'seen'").select(*history.FLIGHT, last(0, F.col("status")).alias("last"))
    place, files = _path(spark, f"{folder}/state")
    versions = sorted(int(s.getPath().getName().split("=")[1]) for s in files.listStatus(place) if s.getPath().getName().startswith("v=")) if exists(spark, f"{folder}/state") else []
    old = [v for v in versions if v < k]
    if old:
        rows = rows.unionByName(spark.read.parquet(f"{folder}/state/v={old[-1]}").select(*history.FLIGHT, last(1, F.col("status")).alias("last")))
    every = spark.read.schema(f"{_WATCHED}, batch long").parquet(f"{folder}/boards").where((F.col("batch") <= k) & (ms("micros") <= passed))
    newest = every.where("origin_iata is not null").groupBy("origin_iata").agg(F.max(ms("micros")).alias("_read"))  # a row an origin
    flights = rows.groupBy(*history.FLIGHT).agg(F.max("last").alias("last")).select(*history.FLIGHT, "last.micros", "last.observation_id", "last.status")
    due = ~F.col("status").isin(*SETTLED, STALE) & (ms("micros") < F.col("_read") - p.stale_minutes * 60_000)
    found = flights.join(F.broadcast(newest), "origin_iata", "left").withColumn("_gone", F.coalesce(due, F.lit(False)))
    kept = written(found, "watched")
    gone = kept.where("_gone").select(*history.FLIGHT, "status", F.lit("WENT_STALE").alias("event_type"))
    gone.write.mode("overwrite").parquet(f"{folder}/gone/batch={k}")
    forget = F.coalesce((F.floor(F.col("micros") / HOUR) + 1) * (HOUR // 1000) <= F.col("_read") - late_ms, F.lit(False))
    state = kept.where(~forget).withColumn("status", F.when(F.col("_gone"), STALE).otherwise(F.col("status")))
    state.select(*history.FLIGHT, "micros", "observation_id", "status").write.mode("overwrite").parquet(f"{folder}/state/v={k}")
    for v in old[:-1]:
        files.delete(_path(spark, f"{folder}/state/v={v}")[0], True)


def watch(observations: DataFrame, boards: DataFrame, folder: str, p: Params = DEFAULT):
    """Start a stream that finds what `stale` finds, from a table in place of a state store: a batch
    is one aggregate of all its flights, however few origins they are of."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    none = F.lit(None).cast("string")
    rows = observations.select(F.lit("seen").alias("kind"), *[F.col(c).cast("string").alias(c) for c in history.FLIGHT], "observation_id", "status", micros("observed_at").alias("micros"))
    read = boards.where("ok").select(
        F.lit("read").alias("kind"), none.alias("flight_number"), "origin_iata", none.alias("destination_iata"), none.alias("flight_date_local"),
        F.lit(0).cast("long").alias("observation_id"), none.alias("status"), micros("read_at").alias("micros"),
    )
    return rows.unionByName(read).writeStream.foreachBatch(lambda batch, k: watch_batch(batch, k, folder, p))


def gone_now(spark: SparkSession, folder: str) -> DataFrame:
    """The flights that the stream found stale."""
    return spark.read.schema(f"{_KEYS}, status string, event_type string").parquet(f"{folder}/gone").drop("batch")


# --- the latest state ---


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _day() -> Column:
    return F.coalesce(F.col("flight_date_local").cast("string"), F.lit("none"))


def _sizes(rows: DataFrame) -> Counter:
    """The rows of each local day; a micro-batch's days are few."""
    return Counter({r["day"]: r["n"] for r in rows.groupBy(_day().alias("day")).agg(F.count("*").alias("n")).collect()})


def _dealt(rows: DataFrame, sizes: Counter, *by: str) -> DataFrame:
    """The rows with day and part, dealt out by these: a task has whole parts and writes a file for
    each, not one for every day. A day of many rows (see PART_ROWS) has several parts, by `by`."""
    large = [F.lit(x) for day, n in sizes.items() if n > PART_ROWS for x in (day, -(-n // PART_ROWS))]
    parts = F.coalesce(F.create_map(*large)[_day()], F.lit(1)) if large else F.lit(1)
    return rows.withColumns({"day": _day(), "part": F.pmod(F.xxhash64(*by), parts).cast("int")}).repartition("day", "part")


def state_before(spark: SparkSession, folder: str, k: int, days: list | None = None) -> DataFrame:
    """The state rows that batches before k left: of each day the newest version. Only
    the partitions of the days are read."""
    rows = spark.read.parquet(folder).where(F.col("v") < k)
    rows = rows if days is None else rows.where(F.col("day").cast("string").isin(days))
    newest = rows.groupBy("day").agg(F.max("v").alias("v"))
    return rows.join(F.broadcast(newest), ["day", "v"]).drop("day", "v")  # a row a day


def fold_batch(batch: DataFrame, k: int, folder: str, sizes: Counter | None = None) -> list:
    """Fold a micro-batch into the state table in folder, which has a partition for each
    local day and version. Only the days that the batch touches are read and get a
    version k; the one before it stays, so that a batch that is run again gives the same,
    older ones go. The touched days. sizes: the batch's rows of each, where they are known."""
    spark, states = batch.sparkSession, history.state_of(batch)
    sizes = _sizes(batch) if sizes is None else sizes
    days = list(sizes)
    if not days:
        return days
    if exists(spark, folder):
        old = state_before(spark, folder, k, days)
        out = history.fold_states(_dealt(states.unionByName(old), sizes + _sizes(old), *history.FLIGHT), "day", "part")
    else:
        out = _dealt(states, sizes, *history.FLIGHT)
    out = out.drop("part").withColumn("v", F.lit(k).cast("long"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "v").parquet(folder)
    for day in days:
        place, files = _path(spark, f"{folder}/day={day}")
        versions = sorted((int(s.getPath().getName().split("=")[1]), s.getPath()) for s in files.listStatus(place) if s.getPath().getName().startswith("v="))
        for _, old in [v for v in versions if v[0] < k][:-1]:
            files.delete(old, True)
    return days


def first_told(batch: DataFrame, k: int, folder: str, keys: tuple[str, ...], sizes: Counter) -> DataFrame:
    """The rows of a micro-batch that no earlier batch told, each once (as its flight and keys tell it). What
    was told is a table in folder with a partition a local day and batch: keys alone are compared, those
    of the batch's days, and rows are only looked up where some were told before. A batch that is run
    again writes its own partitions again."""
    spark, one = batch.sparkSession, list(dict.fromkeys((*history.FLIGHT, *keys)))
    came, held = batch.select(*one, F.lit(k).cast("long").alias("batch")), Counter()
    told = spark.read.schema(came.withColumn("day", _day()).schema)
    if exists(spark, folder):
        before = told.parquet(folder).where(F.col("day").isin(list(sizes)) & (F.col("batch") < k)).drop("day")
        came, held = came.unionByName(before), _sizes(before)
    first = _dealt(came, sizes + held, *one).groupBy("day", "part", *one).agg(F.min("batch").alias("batch")).where(F.col("batch") == k).drop("part")
    first.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(folder)
    new = told.parquet(folder).where(F.col("batch") == k)
    if new.count() == sizes.total():
        return batch
    same = functools.reduce(Column.__and__, [batch[c].eqNullSafe(new[c]) for c in one])
    return batch.dropDuplicates(one).join(new, same, "left_semi")


def flights_before(spark: SparkSession, folder: str, k: int, days: list, touched: DataFrame) -> DataFrame:
    """Of the touched flights the latest state that batches before k left."""
    if not exists(spark, folder):
        return history.flights_of(history.state_of(touched)).limit(0)
    rows = state_before(spark, folder, k, days).join(touched.select(*history.FLIGHT).distinct(), list(history.FLIGHT), "left_semi")
    return history.flights_of(rows)


def upsert_latest(observations: DataFrame, folder: str, statistics: str | None = None, keys: tuple[str, ...] = ("observation_id",)):
    """Start the fold of a stream, each snapshot (as keys tell them) once, into a state
    table (see fold_batch), beside it what was told (see first_told); no row is too late. statistics: a
    folder whose statistics follow (see restate)."""

    def each(batch: DataFrame, k: int) -> None:
        spark, batch = batch.sparkSession, batch.persist()  # whatever is read of it, all its columns would be made again
        sizes = _sizes(batch)
        if sizes:
            new = first_told(batch, k, f"{folder}-told", keys, sizes)
            days = fold_batch(new, k, folder, sizes if new is batch else None)
            if statistics and days:
                restate(*(flights_before(spark, folder, v, days, new) for v in (k, k + 1)), days, k, statistics)
        batch.unpersist()

    return observations.writeStream.foreachBatch(each)


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The flights as the state table has them now."""
    return history.flights_of(state_before(spark, folder, 1 << 62))


# --- history and state together ---


def published(spark: SparkSession, folder: str) -> int:
    """The last batch that the manifest in folder tells of; -1: none."""
    if not exists(spark, f"{folder}/manifest"):
        return -1
    place, files = _path(spark, f"{folder}/manifest")
    return max((int(f.getPath().getName()) for f in files.listStatus(place) if f.getPath().getName().isdigit()), default=-1)


def publish(spark: SparkSession, folder: str, k: int) -> None:
    """Tell of batch k: a file that is renamed, so that it is there at once or not at all. Of
    the files before only the last two are kept."""
    place, files = _path(spark, f"{folder}/manifest")
    files.mkdirs(place)
    draft, _ = _path(spark, f"{folder}/manifest/draft-{k}")
    out = files.create(draft, True)
    out.writeBytes(str(k))
    out.close()
    final, _ = _path(spark, f"{folder}/manifest/{k}")
    files.delete(final, False)
    files.rename(draft, final)
    for f in files.listStatus(place):
        name = f.getPath().getName()
        if name.isdigit() and int(name) < k - 1:
            files.delete(f.getPath(), False)


def ingest_batch(batch: DataFrame, k: int, folder: str, killed: str | None = None) -> None:
    """One micro-batch into history and state: the snapshots (one of a flight, run and source)
    that published history doesn't hold go into history, into partitions of this batch alone;
    the same go into the state; then the batch is published. A batch that is run again, wherever it was
    killed, writes the same partitions and versions again. killed: where to stop, for tests."""
    spark = batch.sparkSession
    history_, before = f"{folder}/history", published(spark, folder)
    days = [d for d in _listed(batch.withColumn("run_day", F.left("run_id", F.lit(8))), "run_day")]
    schema = batch.withColumn("run_day", F.lit("")).withColumn("batch", F.lit(0).cast("long")).schema
    held = spark.read.schema(schema).parquet(history_) if exists(spark, history_) else spark.createDataFrame([], schema)
    held = held.where(F.col("run_day").isin(days) & (F.col("batch") <= before) & (F.col("batch") < k)).drop("batch")
    fresh = history.fresh_snapshots(batch, held).select(*batch.columns, "run_day").persist()
    out = fresh.withColumn("batch", F.lit(k).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("run_day", "batch").parquet(history_)
    if killed == "history":
        raise RuntimeError("killed after history")
    fold_batch(fresh.drop("run_day"), k, f"{folder}/state")
    if killed == "state":
        raise RuntimeError("killed after state")
    publish(spark, folder, k)
    fresh.unpersist()


def ingest(observations: DataFrame, folder: str):
    """Start a stream into history and state in folder, one version of both at a time: readers
    (history_now, latest_now) see what the manifest tells of, so both or neither of a batch."""
    return observations.writeStream.foreachBatch(lambda batch, k: ingest_batch(batch, k, folder))


def history_now(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The published history; schema: of observations."""
    full = T.StructType(list(schema.fields)).add("run_day", "string").add("batch", "long")
    rows = spark.read.schema(full).parquet(f"{folder}/history") if exists(spark, f"{folder}/history") else spark.createDataFrame([], full)
    return rows.where(F.col("batch") <= published(spark, folder)).drop("run_day", "batch")


def latest_now(spark: SparkSession, folder: str) -> DataFrame:
    """The flights as the published batches left them."""
    return history.flights_of(state_before(spark, f"{folder}/state", published(spark, folder) + 1))


def run_now(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now, and read what it wrote."""
    spark: SparkSession = stream.sparkSession
    out, mark = shared_path(spark, "stream"), shared_path(spark, "stream-log")
    if mode == "append":
        query = stream.writeStream.format("parquet").outputMode("append").option("path", out)
    else:
        query = stream.writeStream.outputMode(mode).foreachBatch(lambda b, k: b.withColumn("batch", F.lit(k)).write.mode("append").parquet(out))
    query.option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    schema = stream.schema if mode == "append" else stream.schema.add("batch", "integer")
    return spark.read.schema(schema).parquet(out)

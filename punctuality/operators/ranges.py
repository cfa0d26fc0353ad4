"""Order without a window over one key: rows are sorted in ranges of about equal numbers, and what
a range must know of those before it is a row or a number for each of them.

So a key with a third of all rows lies in as many ranges as its share, and no task holds
more than its range. The ranges are written once to the shared folder: what follows
reads the same ranges, also where a task is run again.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctuality.session import written

_ROW = (1 << 33) - 1


def numbered(rows: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Adds the place of each row in the order, from 1. The order must be total."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = written(ranged, "ranks")
    part = F.shiftright("_at", 33)  # as monotonically_increasing_id puts it: the partition above, the row below
    sizes = sorted((r[0], r[1]) for r in held.groupBy(part).count().collect())  # a row a range
    before, starts = 0, []
    for which, n in sizes:
        starts.append((which, before))
        before += n
    offsets = F.broadcast(spark.createDataFrame(starts, "_part long, _before long"))
    placed = held.withColumn("_part", part).join(offsets, "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(_ROW) + 1).drop("_part", "_before", "_at")


def _same(a: pa.StructArray, b: pa.StructArray, keys: tuple[str, ...]) -> pa.Array:
    """Where rows agree in keys; nulls are alike."""
    out = pa.array([True] * len(a))
    for k in keys:
        x, y = a.field(k), b.field(k)
        out = pc.and_(out, pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(x.is_null(), y.is_null())))
    return out


def with_before(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], fields: tuple[str, ...], name: str = "prev") -> DataFrame:
    """Adds a struct of the fields of the row before, of the same keys and in the order (which
    must be total within keys); null for the first of its keys."""
    spark, told = rows.sparkSession, tuple(dict.fromkeys((*keys, *fields)))
    kept = T.StructType([rows.schema[c] for c in fields])
    schema = T.StructType([*rows.schema.fields, T.StructField(name, kept, True), T.StructField("_part", T.IntegerType()), T.StructField("_head", T.BooleanType())])

    def shift(batches):
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = pa.StructArray.from_arrays([batch.column(c) for c in told], names=list(told))
            before = pa.concat_arrays([own.slice(0, 1) if last is None else last, own.slice(0, n - 1)])
            same = _same(before, own, keys)
            head = pa.array([last is None] + [False] * (n - 1))
            gone = pc.or_(pc.invert(same), head)
            prev = pa.StructArray.from_arrays([before.field(c) for c in fields], fields=[batch.schema.field(c).with_nullable(True) for c in fields], mask=gone)
            last = own.slice(n - 1, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, prev, pa.array([part] * n, pa.int32()), head], names=[*batch.schema.names, name, "_part", "_head"])

    full = (*keys, *order)
    held = written(rows.repartitionByRange(*full).sortWithinPartitions(*full).mapInArrow(shift, schema), "before")
    tails = held.groupBy("_part").agg(F.max_by(F.struct(*told), F.struct(*full)).alias("_tail"))  # a row a range
    parts = sorted(r["_part"] for r in tails.select("_part").collect())
    nexts = spark.createDataFrame(list(zip(parts, parts[1:], strict=False)), "_part int, _next int")
    carried = tails.join(F.broadcast(nexts), "_part").select(F.col("_next").alias("_part"), "_tail")
    alike = F.lit(True)
    for k in keys:
        alike = alike & F.col("_tail")[k].eqNullSafe(F.col(k))
    over = F.when(F.col("_tail").isNotNull() & alike, F.struct(*[F.col("_tail")[c].alias(c) for c in fields]))
    return held.join(F.broadcast(carried), "_part", "left").withColumn(name, F.when(F.col("_head"), over).otherwise(F.col(name))).drop("_part", "_head", "_tail")

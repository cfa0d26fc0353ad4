"""Helpers that the corpus operators share: shared storage, row order, words."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in a local
    session, as in tests, where nothing sets it, a temporary one is made."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and a
    lost executor costs a task of what follows, not all that came before. Within
    `scratch` it is deleted at the end, unless it is to be kept."""
    spark = df.sparkSession
    path = new_path(spark, name)
    held = _scratch.get()
    if held[keep:]:
        held[-1 - keep].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A name for one more column that df has none of, in whatever case."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


_scratch: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scratch", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end what was written within and not kept. What is kept belongs to the
    scratch around this one, if there is any. Nothing that is returned may read the rest."""
    paths: list[str] = []
    token = _scratch.set((*_scratch.get(), paths))
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    root = shared_dir(spark)
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if not folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            continue
        _delete(spark, folder)


def join_skewed(rows: DataFrame, other: DataFrame, key: str, how: str) -> DataFrame:
    """rows.join(other, key, how) for an other of one row a key. Keys that more than a
    HOT-th of all rows have (so at most HOT) are joined by a broadcast of those alone, so
    that no task gets all rows of one."""
    n = rows.count()
    hot = written(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > max(HOT_ROWS, n // HOT)).select(key), "hot-keys")
    if hot.isEmpty():
        return rows.join(other, key, how)
    hot = F.broadcast(hot)
    few = F.broadcast(other.join(hot, key))
    return rows.join(hot, key, "left_semi").join(few, key, how).unionByName(rows.join(hot, key, "left_anti").join(other, key, how))


HOT, HOT_ROWS = 4096, 500


def tasks(spark: SparkSession) -> int:
    """How many partitions a shuffle makes in this session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ordered(df: DataFrame, keys: list[str], name: str, running: str | None = None) -> DataFrame:
    """df in ascending order of keys, written in ranges: adds `_part` (the range),
    `_pos` (the row within it, from 0) and, for a column `running`, `_sum` (its sum in
    the range up to this row). Ranges hold about equal numbers of rows; nothing but
    their bounds passes the driver."""
    spark = df.sparkSession
    schema = T.StructType(list(df.schema.fields)).add("_part", "integer").add("_pos", "long").add("_sum", "long")
    at = None if running is None else df.columns.index(running)

    def number(batches):
        from pyspark import TaskContext

        part, done, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            sums = np.zeros(n, np.int64) if at is None else total + np.cumsum(batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64))
            cols = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(done, done + n)), pa.array(sums)]
            done, total = done + n, int(sums[-1]) if n else total
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "_part", "_pos", "_sum"])

    ranged = df.repartitionByRange(tasks(spark), *keys).sortWithinPartitions(*keys)
    return written(ranged.mapInArrow(number, schema), name)


def ascii_lower(text: str) -> str:
    """A-Z to a-z, every other character kept."""
    return text if text.islower() else text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}
_LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER_BYTES)


def fold(column: str, modulus: int):
    """crc32 of the id as text, mod modulus; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))

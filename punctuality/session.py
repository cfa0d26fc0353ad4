"""Sessions and shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "punctuality", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; a cluster's own settings stay."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    return builder.config(map=conf).getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir). Only
    in a local session, as in tests, where nothing sets it, a temporary one is made."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def written(df: DataFrame, name: str, shredded: bool = True) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and a lost
    executor costs a task of what follows. The folder is the session's to clear.
    shredded: whether paths that VARIANTs share become columns of their own, which costs
    far more to write than it saves in one reading."""
    spark, path, infer = df.sparkSession, shared_path(df.sparkSession, name), "spark.sql.variant.inferShreddingSchema"
    before = spark.conf.get(infer)
    spark.conf.set(infer, str(shredded and before == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(infer, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)

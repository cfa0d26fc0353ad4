"""What both text classifiers share: the labelled sample, and scoring by a table."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, rows: int, keep: Column | None = None) -> DataFrame:
    """(id, y, text) of at most `rows` labelled documents, the first by a hash of the
    id; keep: a condition on the column `id` of labels. Ids with no label of 0 or 1,
    or with both, teach nothing; of documents that share an id one teaches, that of the
    least hash of its text. Only the ids of the sample are broadcast."""
    y = F.col(label).cast("int")
    known = labels.select(F.col(id_col).alias("id"), y.alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    known = known if keep is None else known.where(keep)
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("_y")).where("y = _y").select("id", "y")
    # ids without a document must not fill the sample
    known = known.join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    known = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(known), "id")
    # one text an id: partial aggregates leave one in each task before any is moved
    return found.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def scored(docs: DataFrame, id_col: str, text_col: str, score: Callable, result: str = "score") -> DataFrame:
    """docs' ids with score(list of texts) -> list of floats, batch by batch. A null
    text is scored as the empty one."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def each(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = score([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], names=["id", result])

    return rows.mapInArrow(each, rows.select("id").schema.add(result, "double")).withColumnRenamed("id", id_col)


def filtered(docs: DataFrame, text_col: str, score: Callable, keep: Callable[[float], bool]) -> DataFrame:
    """The rows of docs whose score passes, all columns as they are: no join, no shuffle."""
    at = docs.columns.index(text_col)

    def each(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = score([t or "" for t in part.column(at).cast(pa.string()).to_pylist()])
                yield part.filter(pa.array([keep(x) for x in found], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)

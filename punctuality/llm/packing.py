"""Best-fit packing of documents into bins of a fixed size, with conflicts.

Pieces are dealt to packing shards of about SHARD_ROWS by their place in the input, so
that neither a hot source nor repeated rows or ids gather in one. In a shard, pieces go in by falling size; open bins are kept in order of what
is left in them, each with a bitmap of its sources (max_per_source bits a source) and
one of its duplicate clusters. The search starts at the tightest bin that has room and
goes on to its successors until one is compatible: no other document of the same
cluster, and a free bit for the source. If none is, a new bin opens.

A document costs its length and 1 for a separator; one longer than a bin is cut into
pieces that fill whole bins, and a last one. Only ids, sizes and hashes are shuffled.

Defined results: a null or empty text has length 0 and is packed (cost 1); a null
source is a source, a null cluster never conflicts; pieces of equal size go in by id and
piece, then by source; of bins with equal room the oldest is taken; a very long text
makes as many full bins as it fills, its length alone is read; repeated rows (ids too)
are packed each; an empty table gives no bins; other columns are never read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctuality.llm.shared import written

CAPACITY = 16384
MAX_PER_SOURCE = 4
SHARD_ROWS = 4096


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, max_per_source: int) -> tuple[list[int], list[int]]:
    """Bin and place in it of each item, in the order given. clusters: None for no
    conflict."""
    source_at = {s: i * max_per_source for i, s in enumerate(dict.fromkeys(sources))}
    cluster_at = {c: i for i, c in enumerate(dict.fromkeys(c for c in clusters if c is not None))}
    full = (1 << max_per_source) - 1
    residual: list[tuple[int, int]] = []  # (room left, bin), ascending
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    counts: list[int] = []
    bins, slots = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        shift, bit = source_at[source], 0 if cluster is None else 1 << cluster_at[cluster]
        i = bisect_left(residual, (size, -1))
        while i < len(residual) and (cluster_bits[residual[i][1]] & bit or source_bits[residual[i][1]] >> shift & full == full):
            i += 1
        if i < len(residual):
            room, b = residual.pop(i)
        else:
            room, b = capacity, len(counts)
            source_bits.append(0)
            cluster_bits.append(0)
            counts.append(0)
        used = source_bits[b] >> shift & full
        source_bits[b] |= (used + 1 & ~used) << shift  # the lowest free bit of this source
        cluster_bits[b] |= bit
        bins.append(b)
        slots.append(counts[b])
        counts[b] += 1
        if room > size:
            insort(residual, (room - size, b))
    return bins, slots


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    length: Column | None = None,
    source_col: str = "source",
    cluster: Column | None = None,
    capacity: int = CAPACITY,
    max_per_source: int = MAX_PER_SOURCE,
) -> DataFrame:
    """A row for each piece: id_col, piece, start, length, bin_id, slot. length: of a
    document, by default its characters; cluster: its duplicate cluster (long)."""
    if capacity < 2 or max_per_source < 1:
        raise ValueError("capacity is 2 at least, max_per_source 1")
    most = capacity - 1
    length = F.length(F.col("text").cast("string")) if length is None else length
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(length, F.lit(0)).cast("long").alias("n"),
        F.xxhash64(F.col(source_col)).alias("source"),
        (F.lit(None).cast("long") if cluster is None else cluster.cast("long")).alias("cluster"),
    )
    # sizes alone are written: a shard is dealt by a row's place, which must not change
    rows = written(rows, "piece-sizes")
    how_many = F.greatest(F.lit(1), F.ceil(F.col("n") / most)).cast("long")
    n = max(1, -(-int(rows.agg(F.sum(how_many)).first()[0] or 0) // SHARD_ROWS))
    pieces = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("piece", F.explode(F.sequence(F.lit(0), (how_many - 1).cast("int"))))
    pieces = pieces.select(
        "id", "piece", "source", "cluster", (F.col("piece").cast("long") * most).alias("start"),
        F.least(F.lit(most).cast("long"), F.col("n") - F.col("piece").cast("long") * most).alias("length"),
        F.pmod(F.xxhash64("row", "piece"), F.lit(n)).cast("long").alias("shard"),
    )

    def each(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "id", "piece", "source"], ascending=[False, True, True, True], kind="stable")
        times = part["cluster"].value_counts()
        shared = set(times[times > 1].index)  # a cluster of one never conflicts
        clusters = [c if c in shared else None for c in part["cluster"].tolist()]
        bins, slots = best_fit((part["length"] + 1).tolist(), part["source"].tolist(), clusters, capacity, max_per_source)
        out = part[["id", "piece", "start", "length"]].copy()
        out["bin_id"] = (int(key[0]) << 32) + np.array(bins, np.int64)
        out["slot"] = np.array(slots, np.int32)
        return out

    schema = T.StructType(list(rows.select("id").schema.fields)).add("piece", "integer").add("start", "long").add("length", "long").add("bin_id", "long").add("slot", "integer")
    return pieces.groupBy("shard").applyInPandas(each, schema).withColumnRenamed("id", id_col)


def text_cluster(text_col: str = "text") -> Column:
    """The cluster of documents whose texts differ in case and white space only; a null
    text has none."""
    text = F.col(text_col).cast("string")
    return F.when(text.isNotNull(), F.xxhash64(F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))))


def bin_texts(docs: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\x00") -> DataFrame:
    """(bin_id, text): the pieces of each bin in order, a separator after each. A bin is
    bounded by its capacity. Ids must not repeat."""
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    pieces = packed.join(texts, id_col).select("bin_id", "slot", F.substring("_text", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("piece"))
    return pieces.groupBy("bin_id").agg(F.array_sort(F.collect_list(F.struct("slot", "piece"))).alias("p")).select("bin_id", F.concat(F.array_join("p.piece", separator), F.lit(separator)).alias("text"))

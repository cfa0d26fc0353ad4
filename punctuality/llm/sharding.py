"""Sharding by minimax contiguous partition.

Documents of equal texts are one atomic group. Groups stand in the order of their
smallest ids; the largest shard's size is the least possible for cuts of that order.
A binary search over the capacity checks each greedily (fill a shard, go on), then the
order is cut there.

The check needs the groups' running sizes, which no one machine may hold. The driver
has at most POINTS of them; between two known points a cut is only bounded, so that
some capacities are surely feasible and some surely not. While capacities between are
in doubt, the points of the windows in which their cuts lie are fetched, and the
search goes on: the result is exact.

Defined results: a null text has size 1 and is a group of its own, apart from the empty
text's; a very long text has the size of all its bytes and is one group; groups whose
smallest ids tie stand in the order of their digests; null ids come first; repeated rows
are in one group, in slots one after the other; with few groups the last shards are empty;
an empty table gives no rows; other columns are never read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctuality.llm.shared import join_skewed, ordered, written

SHARDS = 16
POINTS = 65536


class _Points:
    """Some of the rising running sizes, and the stretches in which all are known."""

    def __init__(self, total: int):
        self.at, self.total, self.whole = np.array([0, total], np.int64), total, []

    def add(self, a: int, b: int, values: np.ndarray, all_: bool) -> None:
        self.at = np.union1d(self.at, values)
        if all_:
            self.whole.append((a, b))

    def around(self, a: int, b: int) -> tuple[int, int]:
        """The stretch between known points that holds a and b."""
        i, j = np.searchsorted(self.at, a, "right") - 1, np.searchsorted(self.at, b, "left")
        return int(self.at[i]), int(self.at[min(j, len(self.at) - 1)])

    def below(self, t: int) -> tuple[int, int]:
        """Bounds of the largest running size that is at most t."""
        i = int(np.searchsorted(self.at, t, "right")) - 1
        low = int(self.at[i])
        if low == t or i == len(self.at) - 1:
            return low, low
        high = int(self.at[i + 1])
        known = any(a <= low and high <= b for a, b in self.whole)
        return low, low if known else min(t, high - 1)

    def cuts(self, capacity: int, shards: int) -> tuple[list[int], list[int]]:
        """Greedy cuts at a capacity: lower and upper bounds of where each shard ends."""
        low, high = [0], [0]
        for _ in range(shards):
            low.append(self.below(low[-1] + capacity)[0])
            high.append(self.below(high[-1] + capacity)[1])
        return low[1:], high[1:]


def _least(low: int, high: int, holds: Callable[[int], bool]) -> int:
    """The least number in [low, high] that holds; high must."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if holds(mid) else (mid + 1, high)
    return low


def minimax(total: int, shards: int, fetch: Callable[[list[tuple[int, int]]], tuple[np.ndarray, bool]]) -> tuple[int, list[int]]:
    """Least capacity and its cuts. fetch(windows) gives running sizes within them in
    order, and whether those are all there are."""
    points = _Points(total)
    values, all_ = fetch([(0, total)])
    points.add(0, total, values, all_)
    while True:
        first = max(1, -(-total // shards))
        sure = _least(first, max(first, total), lambda c: points.cuts(c, shards)[0][-1] >= total)
        maybe = _least(first, sure, lambda c: points.cuts(c, shards)[1][-1] >= total)
        if sure == maybe:
            return sure, points.cuts(sure, shards)[0]
        low, high = points.cuts(maybe, shards)[0], points.cuts(sure, shards)[1]
        windows: list[list[int]] = []
        for a, b in sorted(points.around(a, b) for a, b in zip(low, high, strict=True)):
            if windows and a <= windows[-1][1]:
                windows[-1][1] = max(b, windows[-1][1])
            elif a < b:
                windows.append([a, b])
        values, all_ = fetch([(a, b) for a, b in windows])
        for a, b in windows:
            points.add(a, b, values[(values >= a) & (values <= b)], all_)


def _offsets(rows: DataFrame, by: list[str], value) -> list:
    """Per range (and by): collected sums, a row a range: as many as shuffle tasks."""
    return sorted(rows.groupBy(*by).agg(*value).collect())


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", points: int = POINTS) -> DataFrame:
    """A row a document: id_col, size, text_crc32, law, shard, slot, grown_shard."""
    if points < 64 * shards:
        raise ValueError("points: 64 for each shard at least, so that each round narrows the windows")
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"), F.coalesce(F.unhex(F.sha1(text.cast("binary"))), F.lit(bytearray(1))).alias("group"),
    )
    rows = written(rows, "sizes")
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.min("id").alias("first"))
    placed = ordered(groups, ["first", "group"], "groups", "bytes")
    base, n, bases = 0, 0, []
    for part, count, total in _offsets(placed, ["_part"], [F.count("*").alias("n"), F.max("_sum").alias("total")]):
        bases.append((part, base, n))
        base, n = base + total, n + count
    bases_df = spark.createDataFrame(bases, "_part int, _base long, _rows long")
    run = placed.join(F.broadcast(bases_df), "_part").select("group", (F.col("_base") + F.col("_sum")).alias("end"), (F.col("_rows") + F.col("_pos")).alias("number"))

    def fetch(windows: list[tuple[int, int]]) -> tuple[np.ndarray, bool]:
        inside = F.lit(False)
        for a, b in windows:
            inside = inside | F.col("end").between(a, b)
        found = run.where(inside)
        step = max(1, -(-found.count() // points))
        return np.array(sorted(r["end"] for r in found.where(F.col("number") % step == 0).select("end").collect()), np.int64), step == 1

    _, cuts = minimax(base, shards, fetch) if base else (0, [])
    which = sum((F.when(F.col("end") > c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0))
    of = run.select("group", which.cast("int").alias("shard"))
    # the place in the input last, so that equal rows don't all fall in one range
    placed_rows = join_skewed(rows.withColumn("row", F.monotonically_increasing_id()), of, "group", "inner").select("id", "size", "crc", "shard", "row")
    dealt = ordered(placed_rows, ["shard", "id", "crc", "row"], "sharded")
    done: dict[int, int] = {}
    starts = []
    for part, s, first, count in _offsets(dealt, ["_part", "shard"], [F.min("_pos").alias("first"), F.count("*").alias("n")]):
        starts.append((part, s, done.get(s, 0) - first))
        done[s] = done.get(s, 0) + count
    starts_df = spark.createDataFrame(starts, "_part int, shard int, _start long")
    return dealt.join(F.broadcast(starts_df), ["_part", "shard"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_start") + F.col("_pos")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

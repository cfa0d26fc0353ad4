"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are dealt to lanes by a hash of their row number. A task cuts a lane's vectors
into shards, builds each shard's KD-tree (median splits of the widest dimension, tight
bounding boxes) and packs it with its vectors in one row. Queries travel in blocks, with
the k best that they have so far; a task holds one lane's trees and takes the blocks one
after the other, each through all its trees, and carries every query's kth score along,
so that a leaf whose box cannot reach it is not opened. Leaves are opened best first:
each query follows its own order of box bounds, and the queries that are at the same
leaf are scored together.

Lanes are searched in waves, the first of as many as a shuffle has tasks, each next one
of as many as all before. Between waves blocks get their new kth scores, so that after
half of the vectors few more pass. Vectors are shuffled once; a block is shuffled once a
lane, and a lane holds up to LANE_BYTES of vectors, whatever their length: what moves is all vectors, and
queries times (bytes of vectors / LANE_BYTES).

Defined results: vectors that are null, or hold a null or a non-finite component, and
rows without an id take no part; rows that share an id are rows each, as queries and as
candidates (a query leaves out its own row alone); vectors of different lengths never
meet, empty ones score 0; whole numbers are exact at any size, but a score beyond
2**63 - 1 is given as that, one below -(2**63 - 1) as that, and 64 * x beyond the largest
double is the largest double; ties go to the smaller id; long vectors only make shards
larger; empty tables give no rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctuality.llm.shared import discard, tasks, written

K = 20
SHARD_ROWS, LEAF_ROWS, QUERY_ROWS = 8192, 128, 512
#: Bytes of the vectors of a lane: what a task holds; and of a shard or block as doubles, while it is packed.
LANE_BYTES, PACK_BYTES = 64 << 20, 32 << 20
#: Vectors with a component beyond this stand in shards of their own, so that others
#: never need whole numbers beyond those of doubles.
NARROW = 1 << 21
MOST = np.iinfo(np.int64).max
_NONE = np.iinfo(np.int64).min


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(row, id, v): usable vectors with each component x as floor(scale * x), as doubles
    that are whole numbers. row: a number that tells rows apart."""
    most = float(np.finfo(np.float64).max)
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= most))
    rows = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    whole = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(F.greatest(F.least(y, F.lit(most)), F.lit(-most)))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: whole(x.cast("double") * scale)).alias("v"))


def kd_tree(rows: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The rows' order by leaves, and where leaves start."""
    order, starts = np.arange(len(rows)), []
    todo = [(0, len(rows))]
    while todo:
        a, b = todo.pop()
        if b - a <= leaf:
            starts.append(a)
            continue
        part = rows[order[a:b]]
        spread = part.max(0) / 2 - part.min(0) / 2 if rows.shape[1] else np.zeros(1)
        if not spread.any():
            starts.append(a)  # equal vectors: nothing to split
            continue
        mid = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, int(spread.argmax())], mid)]
        todo += [(a + mid, b), (a, a + mid)]
    return order, np.array(starts, np.int64)


def _exact(q: np.ndarray, rows: np.ndarray) -> bool:
    """Whether float64 sums of the products are exact."""
    most = [float(np.abs(x).max(initial=1)) for x in (q, rows)]
    return most[0] < 2**53 and most[1] < 2**53 and most[0] * most[1] * max(1, q.shape[1]) < 2**53


def _whole(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers of any size."""
    return np.array([[int(c) for c in r] for r in x.tolist()], object).reshape(x.shape)


def _longs(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -MOST, MOST).astype(np.int64) if x.dtype == object else x.astype(np.int64)


def search(q_own: np.ndarray, q: np.ndarray, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, starts: np.ndarray, best: np.ndarray, best_ids: np.ndarray, floor: np.ndarray) -> None:
    """Put what the shard has into each query's best scores and ids (descending, padded
    with _NONE). The kth of them, or the kth that the query had before (floor), bounds
    the search. own: row numbers."""
    k = best.shape[1]
    ends = np.append(starts[1:], len(rows))
    lo, hi = np.minimum.reduceat(rows, starts), np.maximum.reduceat(rows, starts)
    if not _exact(q, rows):
        q, rows, lo, hi = map(_whole, (q, rows, lo, hi))
    bound = _longs(np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T)
    order = np.argsort(-bound, axis=1, kind="stable")
    for step in range(len(starts)):
        leaf = order[:, step]
        open_ = np.flatnonzero(bound[np.arange(len(q)), leaf] >= np.maximum(best[:, k - 1], floor))
        if not len(open_):
            break  # bounds fall along each query's order
        for at in np.unique(leaf[open_]):
            who = open_[leaf[open_] == at]
            a, b = starts[at], ends[at]
            score = _longs(q[who] @ rows[a:b].T)
            hit = (score >= np.maximum(best[who, k - 1], floor[who])[:, None]) & (q_own[who][:, None] != own[a:b][None, :])
            for i in np.flatnonzero(hit.any(1)):
                j, w = np.flatnonzero(hit[i]), who[i]
                best[w], best_ids[w] = _top(np.concatenate([best[w], score[i, j]]), np.concatenate([best_ids[w], ids[a:b][j]]), k)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    top = np.lexsort((ids, ~scores))[:k]
    return scores[top], ids[top]


def _packed(batches, size: int, tree: bool, k: int):
    """Rows (lane, row, id, v) as packs of up to size vectors of one lane, length and
    width: (lane, dim, size, own, ids, rows, kind, starts), and for a query block its
    number and the best so far."""
    held: dict[tuple, list] = {}

    def out(key, parts):
        own, ids, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, starts = kd_tree(rows) if tree else (np.arange(len(own)), np.zeros(0, np.int64))
        kind = next((t for t in (np.int8, np.int16, np.int32) if np.abs(rows).max(initial=0) <= np.iinfo(t).max), np.float64)
        cells = {"own": own[order], "ids": ids[order], "rows": rows[order].astype(kind), "starts": starts, "best": np.full((0 if tree else len(own), k), _NONE), "best_ids": np.full((0 if tree else len(own), k), MOST)}
        return pa.RecordBatch.from_pydict(
            {"lane": pa.array([key[0]], pa.int64()), "dim": pa.array([key[1]], pa.int32()), "block": pa.array([int(own[0])], pa.int64()), "kind": pa.array([np.dtype(kind).str])} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in cells.items()}
        )

    for batch in batches:
        lane, own, ids, vectors = batch.columns
        lane, own, ids = (x.to_numpy() for x in (lane, own, ids))
        n, flat = vectors.value_lengths().to_numpy(), vectors.flatten().to_numpy()
        begin = np.cumsum(n) - n
        for dim in np.unique(n).tolist():
            at = np.flatnonzero(n == dim)
            rows = flat[begin[at][:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0))
            wide = np.abs(rows).max(1, initial=0) > NARROW
            for key in {*zip(lane[at].tolist(), wide.tolist(), strict=True)}:
                mine = np.flatnonzero((lane[at] == key[0]) & (wide == key[1]))
                most = min(size, max(1, PACK_BYTES // (8 * max(1, dim))))
                for a in range(0, len(mine), most):
                    part, name = mine[a : a + most], (key[0], dim, key[1])
                    parts = held.setdefault(name, [])
                    parts.append((own[at[part]], ids[at[part]], rows[part]))
                    if sum(len(p[0]) for p in parts) >= most:
                        yield out(name, held.pop(name))
    for name, parts in sorted(held.items()):
        yield out(name, parts)


_SHAPE = "lane long, dim int, block long, kind string, own binary, ids binary, rows binary, starts binary, best binary, best_ids binary"


def _read(row: dict, k: int) -> tuple:
    own, ids = np.frombuffer(row["own"], np.int64), np.frombuffer(row["ids"], np.int64)
    best, best_ids = (np.frombuffer(row[c], np.int64).reshape(-1, k).copy() for c in ("best", "best_ids"))
    return own, ids, np.frombuffer(row["rows"], row["kind"]).astype(np.float64).reshape(len(own), row["dim"]), np.frombuffer(row["starts"], np.int64), best, best_ids


def _meet(batches, k: int):
    """Of a lane first its trees, which are held, then the blocks: what each query finds
    that is better than what it has."""
    now, trees = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: x[0] for c, x in batch.slice(i, 1).to_pydict().items()}
            if row["lane"] != now:
                now, trees = row["lane"], []
            if not row["asked"]:
                trees.append(row)
                continue
            own, _, q, _, best, best_ids = _read(row, k)
            floor, best, best_ids = best[:, k - 1], np.full_like(best, _NONE), np.full_like(best_ids, MOST)
            for tree in trees:
                if tree["dim"] == row["dim"]:
                    t_own, t_ids, t_rows, starts, _, _ = _read(tree, k)
                    search(own, q, t_own, t_ids, t_rows, starts, best, best_ids, floor)
            real = best > _NONE
            if real.any():
                yield pa.RecordBatch.from_pydict(
                    {"block": pa.array([row["block"]], pa.int64()), "query": pa.array([np.repeat(np.arange(len(own)), real.sum(1)).astype(np.int32).tobytes()], pa.binary()), "scores": pa.array([best[real].tobytes()], pa.binary()), "ids": pa.array([best_ids[real].tobytes()], pa.binary())}
                )


def _merge(batches, k: int):
    """Blocks with what their lanes found: of a block first itself, then the finds."""
    block, best, best_ids = None, None, None

    def out():
        return pa.RecordBatch.from_pydict({c: pa.array([x], t) for (c, x), t in zip((block | {"best": best.tobytes(), "best_ids": best_ids.tobytes()}).items(), _TYPES, strict=True)}) if block else None

    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: x[0] for c, x in batch.slice(i, 1).to_pydict().items()}
            if row["query"] is None:
                if block:
                    yield out()
                block = {c: row[c] for c in _NAMES}
                best, best_ids = _read(block, k)[4:]
                continue
            who, scores, ids = (np.frombuffer(row[c], t) for c, t in (("query", np.int32), ("scores", np.int64), ("found", np.int64)))
            ends = np.searchsorted(who, np.arange(len(best) + 1))
            for w in np.unique(who).tolist():
                a, b = ends[w], ends[w + 1]
                best[w], best_ids[w] = _top(np.concatenate([best[w], scores[a:b]]), np.concatenate([best_ids[w], ids[a:b]]), k)
    if block:
        yield out()


_NAMES = [c.split()[0] for c in _SHAPE.split(", ")]
_TYPES = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in _SHAPE.split(", ")]


def lane_count(vectors: DataFrame, wide: int) -> int:
    """As many lanes as a shuffle has tasks, and so many that none holds more than LANE_BYTES.
    A component takes what the largest of the narrow ones takes (see NARROW), or 8 bytes."""
    most = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))
    size, narrow = F.size("v").cast("long"), most <= NARROW
    row = vectors.agg(
        F.count("*"), F.max(F.when(narrow, most)), F.coalesce(F.sum(F.when(narrow, size)), F.lit(0)), F.coalesce(F.sum(F.when(~narrow, size)), F.lit(0))
    ).first()
    width = next(w for w, t in ((1, np.int8), (2, np.int16), (4, np.int32)) if (row[1] or 0) <= np.iinfo(t).max)
    held = row[0] * 16 + row[2] * width + row[3] * 8
    return max(1, -(-held // LANE_BYTES), min(-(-row[0] // SHARD_ROWS), wide))


def top_k(vectors: DataFrame, query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors (row, id, v; see
    integer_vectors) of highest inner product with each row of them that meets the
    condition query."""
    spark = vectors.sparkSession
    wide = tasks(spark)
    lanes = lane_count(vectors, wide)
    dealt = vectors.select(F.pmod(F.xxhash64("row"), F.lit(lanes)).alias("lane"), "row", "id", "v")
    trees = written(dealt.repartition(lanes, "lane").mapInArrow(lambda b: _packed(b, SHARD_ROWS, True, k), _SHAPE), "kd-trees")
    blocks = written(dealt.where(query).withColumn("lane", F.lit(0).cast("long")).mapInArrow(lambda b: _packed(b, QUERY_ROWS, False, k), _SHAPE), "kd-queries")
    first, last = 0, min(wide, lanes)
    while first < lanes:
        there = trees.where(F.col("lane").between(first, last - 1)).withColumn("asked", F.lit(False))
        asked = blocks.withColumn("lane", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last - 1).cast("long")))).withColumn("asked", F.lit(True))
        met = there.unionByName(asked).repartition(last - first, "lane").sortWithinPartitions("lane", "asked", "block")
        found = met.mapInArrow(lambda b: _meet(b, k), "block long, query binary, scores binary, ids binary")
        finds = found.select("block", "query", "scores", F.col("ids").alias("found"))
        both = blocks.unionByName(finds, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("query").isNotNull())
        merged = written(both.mapInArrow(lambda b: _merge(b, k), _SHAPE), "kd-best")
        discard(spark, blocks)
        blocks, first, last = merged, last, min(2 * last, lanes)

    def told(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, ids, _, _, best, best_ids = _read({c: x[0] for c, x in batch.slice(i, 1).to_pydict().items()}, k)
                there = best > _NONE
                ranks = np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), best.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, there.sum(1))), pa.array(ranks[there]), pa.array(best_ids[there]), pa.array(best[there])], names=["query_id", "rank", "vec_id", "score"])

    discard(spark, trees)
    return blocks.mapInArrow(told, "query_id long, rank int, vec_id long, score long")

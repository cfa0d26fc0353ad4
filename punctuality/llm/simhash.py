"""Near-duplicate classes by SimHash, linked exactly with vantage-point trees.

`fingerprints` gives every document a 64-bit SimHash. `links` takes vantage points from
a bounded sample of the distinct fingerprints, orders all of them by their Hamming
distances to these (to the first, within a ring of it to the second, and so on), cuts
that order into shards of bounded size and keeps the pairs of shards whose rings can hold
a pair within the radius (by the triangle inequality |d(v,a) - d(v,b)| <= d(a,b)). In a
shard a vantage-point tree is built: a point of the data with the widest spread of
distances, the nearer and the farther half by the median distance, and so on down to
leaves; each fingerprint of the other shard goes down those branches alone that its
distance, give or take the radius, can reach. A task gives a spanning forest of the links
it has found, never all pairs of a group. `components` contracts these links to classes.

Defined results: a null or blank text has fingerprint zero and links like any other; a
very long text is hashed whole, block by block; null ids never become a class id (a class
of null ids only has a null id); of the ids of a class the smallest is its name; repeated
rows each get a row; an empty table gives an empty result; other columns are kept out,
whatever they are called.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctuality.llm.shared import discard, join_skewed, lower_bytes, scratch, written

RADIUS = 4
SHINGLE = 4
#: Vantage points of the shards, and fingerprints of the sample that they are taken from.
POINTS, SAMPLE = 7, 2048
#: Fingerprints in a shard, in a leaf, and at once on their way down a tree.
SHARD_MIN, SHARD_MAX, SHARDS = 1024, 65536, 48
LEAF, TILE = 256, 2048

_hash = functools.partial(xxhash.xxh64_intdigest, seed=42)


def simhash(text: str | None, words: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    found = lower_bytes(text or "").split()
    if not found:
        return 0
    if len(found) <= words:
        return _hash(b" ".join(found))
    hashes = map(_hash, map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)))
    n = len(found) - words + 1
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        block = np.fromiter(hashes, "<u8", min(8192, n - at))
        votes += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """(id, fp long): fp holds the fingerprint's 64 bits."""

    def each(batches):
        for batch in batches:
            texts = batch.column(1)
            fps = np.array([simhash(t.as_py(), words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(each, rows.select("id").schema.add("fp", "long"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ring(fp: Column, v: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(v)).cast("long"))).cast("int")


def vantage_points(nodes: DataFrame) -> list[int]:
    """POINTS fingerprints of a bounded sample of the nodes (the least by a hash), each
    as far from those before it as can be. They decide what is pruned, not what is found."""
    sample = np.array([r["fp"] for r in nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()] or [0], np.int64).view(np.uint64)
    found = [int(sample[0])]
    while len(found) < POINTS:
        away = np.min([np.bitwise_count(sample ^ np.uint64(v)) for v in found], axis=0)
        found.append(int(sample[int(away.argmax())]))
    return found


def shards(nodes: DataFrame, n: int, beside: tuple[str, ...] = (), many: int = SHARDS, most: int = SHARD_MAX) -> DataFrame:
    """(shard, lo, hi, fps): runs of the order by the vantage points; lo and hi bound the
    distances to each. The long columns beside go with their fingerprints, one after the
    other. many: of shards, unless one would hold more than most."""
    each = min(most, max(SHARD_MIN, -(-n // many)))
    points = vantage_points(nodes)
    rings = [_ring(F.col("fp"), v).alias(f"d{i}") for i, v in enumerate(points)]

    def pack(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        kept, held = [], 0

        def out(rows):
            fps = rows[0]
            d = np.stack([np.bitwise_count(fps ^ np.uint64(v)) for v in points])
            return pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([(part << 24) + k], pa.int64()),
                    "lo": pa.array([d.min(1).astype(int).tolist()], pa.list_(pa.int32())),
                    "hi": pa.array([d.max(1).astype(int).tolist()], pa.list_(pa.int32())),
                    "fps": pa.array([rows.tobytes()], pa.binary()),
                }
            )

        for batch in batches:
            fps = np.stack([c.to_numpy().view(np.uint64) for c in batch.columns])
            kept, held = [*kept, fps], held + fps.shape[1]
            while held >= each:
                rows = np.concatenate(kept, 1)
                yield out(rows[:, :each])
                kept, held, k = [rows[:, each:]], held - each, k + 1
        if held:
            yield out(np.concatenate(kept, 1))

    order = [f"d{i}" for i in range(POINTS)]
    ranged = nodes.select("fp", *beside, *rings).repartitionByRange(max(1, -(-n // each)), *order, "fp").sortWithinPartitions(*order, "fp").select("fp", *beside)
    return ranged.mapInArrow(pack, "shard long, lo array<int>, hi array<int>, fps binary")


class _Forest:
    """Disjoint sets of 0..n-1 that keep the links which joined two sets."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


class VpTree:
    """A vantage-point tree of fingerprints. order: their places, leaf by leaf. nodes: a
    leaf is (from, to) in that order; a branch is (vantage point, (least and greatest
    distance, child) of the nearer and of the farther half)."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.order, self.nodes = fps, np.arange(len(fps)), []
        self._build(0, len(fps))

    def _build(self, a: int, b: int) -> int:
        at = len(self.nodes)
        self.nodes.append((a, b))
        if b - a > LEAF:
            part = self.fps[self.order[a:b]]
            tried, some = part[:: -(-len(part) // 8)], part[:: -(-len(part) // 256)]
            v = tried[int(np.bitwise_count(tried[:, None] ^ some[None]).astype(float).var(1).argmax())]
            d = np.bitwise_count(part ^ v).astype(int)
            by = np.argsort(d, kind="stable")
            self.order[a:b], d, mid = self.order[a:b][by], d[by], (b - a) // 2
            near, far = self._build(a, a + mid), self._build(a + mid, b)
            self.nodes[at] = (v, (d[0], d[mid - 1], near), (d[mid], d[-1], far))
        return at

    def reached(self, points: np.ndarray, radius: int):
        """(from, to, who): the leaves, as runs of order, that the triangle bounds leave,
        each with the points that may have something in it."""
        todo = [(0, np.arange(len(points)))]
        while todo:
            at, who = todo.pop()
            node = self.nodes[at]
            if len(node) == 2:
                yield *node, who
                continue
            d = np.bitwise_count(points[who] ^ node[0]).astype(int)
            for lo, hi, child in node[1:]:
                some = who[(d >= lo - radius) & (d <= hi + radius)]
                if len(some):
                    todo.append((child, some))


def near_pairs(a: np.ndarray, b: np.ndarray | None, radius: int):
    """(at, start, i, j, found): of a leaf of a and a tile of b (b None: of a) where they
    start, the places of their members, and which pairs of those are within the radius;
    within a each pair once."""
    tree, same = VpTree(a), b is None
    b = a[tree.order] if same else b
    for start in range(0, len(b), TILE):
        tile = b[start : start + TILE]
        for x, y, who in tree.reached(tile, radius):
            if same and x >= start + len(tile):
                continue
            found = np.bitwise_count(tree.fps[tree.order[x:y], None] ^ tile[None, who]) <= radius
            if same and y > start:
                found &= np.arange(x, y)[:, None] < start + who[None]
            if found.any():
                yield x, start, tree.order[x:y], tree.order[start + who] if same else start + who, found


def link_shards(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links between a and b (b None: within a), as pairs of
    fingerprints."""
    both = a if b is None else np.concatenate([a, b])
    shift = 0 if b is None else len(a)
    forest = _Forest(len(both))
    for _, _, i, j, found in near_pairs(a, b, radius):
        j = j + shift
        while found.any():
            rows = np.flatnonzero(found.any(1))
            for x, y in zip(i[rows].tolist(), j[found[rows].argmax(1)].tolist(), strict=True):
                forest.link(x, y)
            ra, rb = (np.array([forest.root(k) for k in of.tolist()]) for of in (i, j))
            found = found & (ra[:, None] != rb[None, :])
    return [(int(both[i]), int(both[j])) for i, j in forest.links]


def _shard_pairs(blocks: DataFrame, radius: int) -> DataFrame:
    """(shard, b_shard, left, right): the pairs of shards whose rings can hold a link."""
    sides = blocks.select("shard", "lo", "hi")
    home = sides.withColumn("ring", F.explode(F.sequence(F.col("lo")[0], F.col("hi")[0]))).select("ring", *[F.col(c).alias(f"b_{c}") for c in sides.columns])
    query = sides.withColumn("ring", F.explode(F.sequence(F.col("lo")[0] - radius, F.col("hi")[0] + radius)))
    overlap = [(F.col("b_lo")[i] <= F.col("hi")[i] + radius) & (F.col("b_hi")[i] >= F.col("lo")[i] - radius) for i in range(POINTS)]
    pairs = query.join(home, "ring").where(functools.reduce(lambda x, y: x & y, overlap, F.col("shard") <= F.col("b_shard"))).select("shard", "b_shard").distinct()
    held = blocks.select(F.col("shard"), F.col("fps").alias("left"))
    other = blocks.select(F.col("shard").alias("b_shard"), F.col("fps").alias("right"))
    return pairs.join(held, "shard").join(other, "b_shard").select("shard", "b_shard", "left", "right")


def links(nodes: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between n distinct fingerprints (column fp) that join all that
    is reachable in steps of radius bits."""
    blocks = written(shards(nodes, n), "vp-shards")

    def search(batches):
        for batch in batches:
            for one, other, left, right in zip(*(batch.column(i) for i in range(4)), strict=True):
                a = np.frombuffer(left.as_py(), np.uint64)
                b = None if one == other else np.frombuffer(right.as_py(), np.uint64)
                found = np.array(link_shards(a, b, radius), np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return _shard_pairs(blocks, radius).mapInArrow(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the class of every node that has an edge (a, b). In each round a
    node moves to the neighbour of the least hash (anew in each round, so that no
    order of ids makes long chains) and the edges with it, until none is left."""
    found, old, k = None, [], 0
    edges = edges.where("a <> b")
    while True:
        edges = written(edges, "edges")
        for done in old:  # what the round before needed
            discard(edges.sparkSession, done)
        if edges.isEmpty():
            break
        near = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        rank = lambda c, k=k: F.xxhash64(F.lit(k), F.col(c))
        best = near.groupBy("node").agg(F.min(F.struct(rank("to").alias("h"), F.col("to"))).alias("m"))
        moves = written(best.select("node", F.when(F.col("m.h") < rank("node"), F.col("m.to")).otherwise(F.col("node")).alias("comp")), "moves")
        old = [edges, *([moves, found] if found is not None else [])]
        found = moves if found is None else written(found.join(moves.select(F.col("node").alias("comp"), F.col("comp").alias("_to")), "comp", "left").select("node", F.coalesce("_to", "comp").alias("comp")), "classes")
        at = moves.select(F.col("node").alias("b"), F.col("comp").alias("_b"))
        edges = edges.join(moves.select(F.col("node").alias("a"), F.col("comp").alias("_a")), "a").join(at, "b")
        edges = edges.where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        k += 1
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")) if found is None else found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """One row a document: id_col, fingerprint (16 hex digits), component_id (the
    smallest id that is reachable over links of radius bits or fewer)."""
    with scratch(docs.sparkSession):
        fps = written(fingerprints(docs, id_col, text_col, words), "fingerprints", keep=True)
        nodes = written(fps.groupBy("fp").agg(F.min("id").alias("first")), "fp-nodes")
        classes = components(written(links(nodes, nodes.count(), radius), "fp-links"))
        linked = nodes.join(classes.withColumnRenamed("node", "fp"), "fp")
        least = linked.groupBy("comp").agg(F.min("first").alias("least"))
        known = linked.join(least, "comp").select("fp", "least")
        named = written(nodes.join(known, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "fp-named", keep=True)
    return join_skewed(fps, named, "fp", "inner").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """docs without near duplicates: of each class the row of the smallest id stays
    (one, if several rows have that id). Documents without an id stay, as nothing
    tells them apart."""
    found = written(near_duplicates(docs, id_col, text_col, radius, words), "near-duplicates")
    keep = found.where(F.col(id_col) == F.col("component_id")).select(id_col)
    twice = written(keep.groupBy(id_col).agg(F.count("*").alias("_n")).where("_n > 1").select(id_col), "repeated-ids")
    once = keep.distinct()
    kept = docs.join(once, id_col, "left_semi")
    if not twice.isEmpty():
        kept = kept.join(twice, id_col, "left_anti").unionByName(docs.join(twice, id_col, "left_semi").dropDuplicates([id_col]))
    return kept.unionByName(docs.where(F.col(id_col).isNull()))

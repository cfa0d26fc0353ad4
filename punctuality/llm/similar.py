"""Near copies by shingle similarity: texts whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more are linked, and one of each class of linked texts stays.

Candidates come from SimHash fingerprints by the vantage-point search of `simhash`, with
a radius that one pair in some 3,000 of similarity 0.8 passes, and fewer of more (see RADIUS), and
are linked only after both sets of shingles were compared in full. Two things bound the
work, and neither drops a pair but once in some 240,000:
`stars` first joins what shares a least hash with the first text of its bucket, so that of
a large group of near copies few pairs are left for the search, which skips texts that are
joined already; and a sketch of LONG bytes goes with the fingerprints into the shards: of its
first SKETCH bytes a pair at 0.8 shares 13 on average, which turns random neighbours away,
of all of them 51, which turns away what shares passages only, before any set of shingles is moved.
The search never lists pairs, of which a group of near copies that are not similar enough
has as many as the square of its size: it tells which texts of two blocks have candidates
in the other; these come together with their sets of shingles, block by block, and give a
spanning forest of their links. Shards are few and large (see merged), whatever the number
of partitions of a shuffle, so that a text is named for few blocks.

Defined results: a null text is an empty one, empty and blank texts are copies of each
other; texts of fewer than five words are one shingle; very long texts are compared whole;
of a class the smallest id stays; repeated rows of an id are one document, documents
without an id stay and link nothing, as nothing tells them apart; an empty table stays
empty; other columns are kept, whatever they are called.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctuality.llm import simhash
from punctuality.llm.shared import free_name, join_skewed, lower_bytes, scratch, written

SHINGLE, SIMILARITY = 5, 0.8
#: At 0.8 a bit differs with p = acos(0.89) / pi = 0.15: 9.7 of 64 bits, deviation 2.9;
#: more than 20 do so once in some 3,000.
RADIUS = 20
#: Bytes of the sketches, how many of them candidates share at least (each fewer once in
#: some 240,000 at 0.8), buckets of a text.
SKETCH, SHARED, LONG, LONG_SHARED, STARS = 16, 5, 64, 36, 4
#: Shards of the search, and texts in one at most. As the bounds rule out next to nothing, a
#: shard meets all others: few large ones are moved, and name a text, less often.
SHARDS, SHARD_MAX = 16, 1 << 18
_SKETCH = [f"s{i}" for i in range(LONG // 8)]
_SALTS = np.random.default_rng(8).integers(1, 1 << 63, (2, LONG), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_hash = functools.partial(xxhash.xxh64_intdigest, seed=42)


def shingles(text: str | None) -> np.ndarray:
    """The hashes of a text's shingles, in the text's order, with repeats."""
    found = lower_bytes(text or "").split()
    if len(found) <= SHINGLE:
        return np.array([_hash(b" ".join(found))], np.uint64)
    grams = map(b" ".join, zip(*(found[i:] for i in range(SHINGLE)), strict=False))
    return np.fromiter(map(_hash, grams), np.uint64, len(found) - SHINGLE + 1)


def fingerprint(hashes: np.ndarray) -> int:
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        votes += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little")


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(LONG, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 512):
        mixed = (hashes[at : at + 512, None] ^ _SALTS[0]) * _SALTS[1]
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(0))
    return least


def sketch(least: np.ndarray) -> np.ndarray:
    """Of each least hash eight of its middle bits, eight bytes a number."""
    return (least >> np.uint64(20)).astype(np.uint8).view(np.uint64)


def agree(a: np.ndarray, b: np.ndarray, least: int = SHARED) -> np.ndarray:
    """For rows of sketches whether they share enough bytes."""
    width = a.shape[1] * a.itemsize
    return (a.view(np.uint8).reshape(-1, width) == b.view(np.uint8).reshape(-1, width)).sum(1) >= least


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Of two sorted sets: Jaccard similarity of SIMILARITY or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 10 >= round(SIMILARITY * 10) * (len(a) + len(b) - both)


def _longs(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.uint64).view(np.int64), pa.int64()) for c in columns], names=names)


def _numbers(batch: pa.RecordBatch, *at: int) -> list[np.ndarray]:
    return [batch.column(i).to_numpy().view(np.uint64) for i in at]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, text) of documents with an id; node stands for the exact text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("node"), text.alias("text"))


def prints(rows: DataFrame) -> DataFrame:
    """(id, node, fp, s0..., m0...): fingerprint, sketch and least hashes."""
    names = ["fp", *_SKETCH, *[f"m{i}" for i in range(STARS)]]

    def each(batches):
        for batch in batches:
            out = np.zeros((len(names), batch.num_rows), np.uint64)
            for i, t in enumerate(batch.column(2)):
                hashes = shingles(t.as_py())
                least = least_hashes(hashes)
                out[:, i] = [fingerprint(hashes), *sketch(least), *least[:STARS]]
            cells = [batch.column(0), batch.column(1), *[pa.array(c.view(np.int64)) for c in out]]
            yield pa.RecordBatch.from_arrays(cells, names=["id", "node", *names])

    schema = rows.select("id", "node").schema
    for name in names:
        schema = schema.add(name, "long")
    return rows.mapInArrow(each, schema)


def stars(nodes: DataFrame) -> DataFrame:
    """(a, b): candidates between the first text of each bucket and its others."""
    at = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col(f"m{i}")) for i in range(STARS)]))
    rows = nodes.select(at.alias("bucket"), "node", "s0", "s1")
    first = rows.groupBy("bucket").agg(F.min(F.struct("node", "s0", "s1")).alias("f"), F.count("*").alias("n")).where("n > 1").select("bucket", "f")
    pairs = rows.join(first, "bucket").where("node <> f.node").select(F.col("f.node").alias("a"), F.col("node").alias("b"), F.col("f.s0"), F.col("f.s1"), F.col("s0").alias("t0"), F.col("s1").alias("t1"))

    def keep(batches):
        for batch in batches:
            a, b, s0, s1, t0, t1 = _numbers(batch, *range(6))
            ok = agree(np.stack([s0, s1], 1), np.stack([t0, t1], 1))
            yield _longs([a[ok], b[ok]], ["a", "b"])

    return pairs.mapInArrow(keep, "a long, b long").distinct()


def near(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Which nodes have candidates among the columns of a and b (b None: within a), by
    blocks of up to simhash.TILE on either side: never the pairs themselves, of which a
    group of near copies has as many as the square of its size. Columns are fp, class,
    node and sketch; what is of one class is joined already."""
    short = 3 + SKETCH // 8
    other = a if b is None else b
    found: dict[tuple[int, int], list] = {}
    for at, start, i, j, hit in simhash.near_pairs(np.ascontiguousarray(a[0]), None if b is None else np.ascontiguousarray(b[0]), radius):
        x, y = np.nonzero(hit)
        x, y = i[x], j[y]
        apart = a[1, x] != other[1, y]
        x, y = x[apart], y[apart]
        for end, least in ((short, SHARED), (len(a), LONG_SHARED)):
            ok = agree(np.ascontiguousarray(a[3:end, x].T), np.ascontiguousarray(other[3:end, y].T), least)
            x, y = x[ok], y[ok]
        if len(x):
            found.setdefault((at // simhash.TILE, start // simhash.TILE), []).append((np.unique(a[2, x]), np.unique(other[2, y])))
    return {block: tuple(np.unique(np.concatenate(side)) for side in zip(*of, strict=True)) for block, of in found.items()}


_BLOCK = "block long, side boolean, node long"


def _block_rows(block: int, sides) -> pa.RecordBatch:
    nodes = np.concatenate(list(sides)).astype(np.uint64).view(np.int64)
    side = np.repeat([False, True], [len(s) for s in sides])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), block)), pa.array(side), pa.array(nodes)], names=["block", "side", "node"])


def merged(shards: DataFrame, n: int, width: int) -> DataFrame:
    """Neighbouring shards of n texts as one, as long as they hold no more than a shard may. A
    range of the order has a shard at least, so there are as many as a shuffle makes
    partitions, and each text would be named for as many blocks. Bounds of shards, some
    hundreds of bytes, pass the driver."""
    each = min(SHARD_MAX, max(simhash.SHARD_MIN, -(-n // SHARDS)))
    sizes = sorted(shards.select("shard", F.octet_length("fps").alias("size")).collect())
    to, held = {}, 0
    for shard, size in sizes:
        held += size // (8 * width)
        new = not to or held > each
        held = size // (8 * width) if new else held
        to[shard] = shard if new else last
        last = to[shard]
    if len(set(to.values())) == len(to):
        return shards
    places = shards.sparkSession.createDataFrame(list(to.items()), "shard long, into long")

    def join(key, table):
        lo, hi = (np.array(table.column(c).to_pylist()) for c in ("lo", "hi"))
        rows = np.concatenate([np.frombuffer(v.as_py(), np.uint64).reshape(width, -1) for v in table.column("fps")], 1)
        return pa.table({"shard": [key[0].as_py()], "lo": pa.array([lo.min(0).tolist()], pa.list_(pa.int32())), "hi": pa.array([hi.max(0).tolist()], pa.list_(pa.int32())), "fps": pa.array([rows.tobytes()], pa.binary())})

    return shards.join(F.broadcast(places), "shard").groupBy("into").applyInArrow(join, shards.schema)


def neighbours(nodes: DataFrame, n: int) -> DataFrame:
    """(block, side, node): the nodes (of n: fp, comp, node, sketch) that have candidates on
    the other side of a block."""
    width = 3 + len(_SKETCH)
    found = written(simhash.shards(nodes, n, ("comp", "node", *_SKETCH), SHARDS, SHARD_MAX), "near-ranges")
    blocks = written(merged(found, n, width), "near-shards")

    def search(batches):
        for batch in batches:
            for one, other, left, right in zip(*(batch.column(i) for i in range(4)), strict=True):
                a = np.frombuffer(left.as_py(), np.uint64).reshape(width, -1)
                b = None if one == other else np.frombuffer(right.as_py(), np.uint64).reshape(width, -1)
                for (x, y), sides in near(a, b).items():
                    yield _block_rows(xxhash.xxh64_intdigest(f"{one} {other} {x} {y}") >> 1, sides)

    return simhash._shard_pairs(blocks, RADIUS).mapInArrow(search, _BLOCK)


def _in_blocks(batches):
    """(block, columns of one side, columns of the other) of rows that are sorted by block
    and side: block, side, node, fp, comp, sketch, set."""
    held: list[pa.RecordBatch] = []

    def both():
        table = pa.Table.from_batches(held).combine_chunks()
        side = table.column("side").to_numpy()
        return [table.filter(pa.array(side == s)).to_pydict() for s in (False, True)]

    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
            if held and held[0].column("block")[0].as_py() != block[a]:
                yield int(held[0].column("block")[0].as_py()), *both()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield int(held[0].column("block")[0].as_py()), *both()


def _candidates(a: dict, b: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the pairs of different classes that are within the radius
    and whose long sketches agree."""
    numbers = lambda x: np.array(x, np.int64).view(np.uint64)
    sketches = [np.stack([numbers(of[c]) for c in _SKETCH], 1) for of in (a, b)]
    fps, comps = ([numbers(of[c]) for of in (a, b)] for c in ("fp", "comp"))
    out_x, out_y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(fps[0]), 256):
        near_ = (np.bitwise_count(fps[0][at : at + 256, None] ^ fps[1][None]) <= RADIUS) & (comps[0][at : at + 256, None] != comps[1][None])
        x, y = np.nonzero(near_)
        ok = agree(sketches[0][x + at], sketches[1][y], LONG_SHARED)
        out_x.append(x[ok] + at)
        out_y.append(y[ok])
    return np.concatenate(out_x), np.concatenate(out_y)


def shingle_sets(asked: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, set): the sorted shingle hashes of the texts of the nodes asked for."""
    first = asked.select("node").distinct().join(nodes.select("node", F.col("first").alias("id")), "node")

    def each(batches):
        for batch in batches:
            sets = [np.unique(shingles(t.as_py())).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    texts = rows.join(first, ["id", "node"], "left_semi").select("node", "text")
    return written(texts.mapInArrow(each, "node long, set binary").dropDuplicates(["node"]), "near-sets")


def forest(a: dict, b: dict) -> list[tuple[int, int]]:
    """Links between nodes of both sides of a block whose sets are similar: a spanning
    forest of them. Each node's set is held against those of all its candidates at once."""
    x, y = _candidates(a, b)
    if not len(x):
        return []
    sets = [np.frombuffer(v, np.uint64) for v in (*a["set"], *b["set"])]
    size, shift = np.array([len(v) for v in sets]), len(a["set"])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    sets = np.split(ids, np.cumsum(size)[:-1])
    flags, names = np.zeros(int(ids.max()) + 1, np.int32), [*a["node"], *b["node"]]
    joined = simhash._Forest(len(sets))
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order] + shift
    for part in np.split(y, np.flatnonzero(np.diff(x)) + 1):
        one = int(x[0])
        x = x[len(part) :]
        part = np.array([k for k in part.tolist() if joined.root(k) != joined.root(one)], np.int64)
        if not len(part):
            continue
        flags[sets[one]] = 1
        both = np.add.reduceat(flags[np.concatenate([sets[k] for k in part])], np.cumsum(size[part]) - size[part])
        flags[sets[one]] = 0
        for k in part[both * 10 >= round(SIMILARITY * 10) * (size[one] + size[part] - both)].tolist():
            joined.link(one, k)
    return [(names[i], names[j]) for i, j in joined.links]


def block_links(involved: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between nodes of each block (see neighbours)."""

    def link(batches):
        for _, a, b in _in_blocks(batches):
            found = np.array(forest(a, b) if a["node"] and b["node"] else [], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    known = written(nodes.select("node", "fp", "comp", *_SKETCH).join(sets, "node"), "near-known")
    rows = involved.join(known, "node").select("block", "side", "node", "fp", "comp", *_SKETCH, "set")
    return rows.repartition("block").sortWithinPartitions("block", "side").mapInArrow(link, "a long, b long")


def verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of stars, at most STARS a node, whose sets of shingles are similar."""

    def keep(batches):
        for batch in batches:
            a, b, *words = _numbers(batch, *range(2 + 2 * len(_SKETCH)))
            ok = agree(*(np.stack(words[i : i + len(_SKETCH)], 1) for i in (0, len(_SKETCH))), LONG_SHARED)
            yield _longs([a[ok], b[ok]], ["a", "b"])

    side = lambda node: nodes.select(F.col("node").alias(node), *[F.col(c).alias(f"{node}_{c}") for c in _SKETCH])
    told = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *[f"{x}_{c}" for x in "ab" for c in _SKETCH])
    pairs = written(told.mapInArrow(keep, "a long, b long"), "near-pairs")
    sets = shingle_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), rows, nodes)
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("left")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("right")), "b")

    def compare(batches):
        for batch in batches:
            ok = np.array([similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)], bool)
            a, b = _numbers(batch, 0, 1)
            yield _longs([a[ok], b[ok]], ["a", "b"])

    return joined.select("a", "b", "left", "right").mapInArrow(compare, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node, comp): of every document with an id its text and the class of that."""
    with scratch(docs.sparkSession):
        rows = keyed(docs, id_col, text_col)
        printed = written(prints(rows), "near-prints", keep=True)
        nodes = written(printed.groupBy("node").agg(F.min("id").alias("first"), *[F.any_value(c).alias(c) for c in printed.columns[2:]]), "near-nodes")
        near_links = written(verified(written(stars(nodes), "near-stars"), rows, nodes), "near-links")
        joined = simhash.components(near_links).withColumnRenamed("comp", "joined")
        labelled = written(nodes.join(joined, "node", "left").select("fp", F.coalesce("joined", "node").alias("comp"), "node", *_SKETCH), "near-labelled")
        involved = written(neighbours(labelled, labelled.count()), "near-involved")
        more = written(block_links(involved, labelled, shingle_sets(involved, rows, nodes)), "near-links")
        comps = written(simhash.components(near_links.union(more)), "near-classes", keep=True)
    return join_skewed(printed.select("id", "node"), comps, "node", "left").select("id", "node", F.coalesce("comp", "node").alias("comp"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each class the row of the smallest id stays (one, if
    several rows have that id). Documents without an id stay."""
    hashed = free_name(docs, "_near_node")
    with scratch(docs.sparkSession):
        found = written(classes(docs, id_col, text_col), "near-rows")
        at = F.struct("id", "node")
        least = found.groupBy("comp").agg(F.min(at).alias("least"))
        other = join_skewed(found, least, "comp", "inner").where(at != F.col("least"))
        named = (F.col("id").alias(id_col), F.col("node").alias(hashed))
        drop = written(other.select(*named).distinct(), "near-drop", keep=True)
        twice = written(found.groupBy("id", "node").agg(F.count("*").alias("n")).where("n > 1").select(*named), "near-repeated", keep=True)
    noded = docs.withColumn(hashed, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    kept = noded.join(drop, [id_col, hashed], "left_anti")
    if not twice.isEmpty():
        kept = kept.join(twice, [id_col, hashed], "left_anti").unionByName(kept.join(twice, [id_col, hashed], "left_semi").dropDuplicates([id_col, hashed]))
    return kept.select(*docs.columns)

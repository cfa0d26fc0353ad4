"""The corpus operators against brute force, with odd inputs."""

import hashlib
import itertools
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from punctuality.llm import decontam, learning, licences, packing, quality, sharding, simhash, tokens, topk, toxicity, warc
from punctuality.llm.shared import new_path, written

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def documents(spark, texts, ids=None, sources=None):
    ids = range(len(texts)) if ids is None else ids
    sources = itertools.repeat("s") if sources is None else sources
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources)], DOCS)


def odd(spark):
    """Nulls, empty, long, repeated rows, and columns named as the operators' own."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(0, None, None), (1, "", "a"), (1, "", "a"), (None, "text without an id", "a"), (None, None, None), (2, long, "b"), (3, long + " more", "b"), (4, "Ünï © 中文 \U0001f600", "c"), (4, "Ünï © 中文 \U0001f600", "c"), (5, " \n\t ", "c")]
    return spark.createDataFrame([(i, t, "en", s, 1, 7, 8.0, "x", [1], 9, 10) for i, t, s in rows], DOCS + ", id long, score double, fp string, spans array<int>, _part int, _row int")


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1


def brute_top(rows, k):
    """rows: (id, whole numbers)."""
    out, most = [], 2**63 - 1
    for n, (q, v) in enumerate(rows):
        if q % 20:
            continue
        scores = [(max(-most, min(most, sum(a * b for a, b in zip(v, w)))), i) for m, (i, w) in enumerate(rows) if m != n and len(w) == len(v)]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


def brute_rows(rows):
    return [(i, [math.floor(64 * Fraction(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


def test_top_k(spark, monkeypatch):
    """Ties, repeated ids, large components, lengths, over many lanes and waves."""
    rng = random.Random(1)
    rows = [(i, [rng.randint(-9, 9) / 64 + 0.001 for _ in range(3 if i % 3 else 5)]) for i in range(900)]
    rows += [(901, [1e8, 1e9, -1e9]), (920, [-1e9, 3.0, 1e9]), (940, [1e16, -2e15, 1.0]), (941, [1e16, 2e15, -7.5]), (942, [1e300, 1.0, 2.0]), (960, [-3e15, 5e-324, 0.5])]
    rows += [(2000 + i, [1.0, 1.0, 1.0]) for i in range(300)] + [(20, [0.5, 0.25, 1.0]), (20, [0.5, 0.25, 1.0]), (40, [1.0, 2.0, 3.0]), (40, rows[40][1])]
    rows += [(5000, None), (5020, [1.0, None, 2.0]), (5040, [float("nan"), 1.0, 1.0]), (5060, [float("-inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (5080, []), (5100, []), (5120, [2.0, 1e308])]
    table = spark.createDataFrame([(i, v, i, 7, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id long, v int, dim string, lane int, block int")
    vectors = written(topk.integer_vectors(table), "v")
    want = brute_top(brute_rows(rows[:-1]) + [(5120, [128, 0])], 7)
    for shard, lane in ((8192, 64 << 20), (50, 2500)):
        monkeypatch.setattr(topk, "SHARD_ROWS", shard)
        monkeypatch.setattr(topk, "LANE_BYTES", lane)
        monkeypatch.setattr(topk, "QUERY_ROWS", shard // 5)
        assert sorted(map(tuple, topk.top_k(vectors, F.col("id") % 20 == 0, 7).collect())) == want
    assert topk.top_k(vectors.limit(0), F.col("id") % 20 == 0).count() == 0
    same = topk.integer_vectors(spark.createDataFrame([(i, [i / 64]) for i in range(50)], "vec_id long, embedding array<double>"))
    assert topk.top_k(written(same, "v"), F.col("id") == 0, 20).count() == 20


def test_kd_leaves_bound():
    rng = np.random.default_rng(2)
    rows = rng.integers(-50, 50, (1000, 6))
    order, starts = topk.kd_tree(rows, 64)
    assert sorted(order.tolist()) == list(range(1000)) and (np.diff(np.append(starts, 1000)) <= 64).all()


def test_top_k_of_long_vectors(spark, monkeypatch):
    """What a task holds is bounded in bytes, however long the vectors are."""
    rng = random.Random(5)
    rows = [(i, [rng.randint(-600, 600) / 64 for _ in range(2048)]) for i in range(200)]
    vectors = written(topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "v")
    monkeypatch.setattr(topk, "LANE_BYTES", 200_000)
    monkeypatch.setattr(topk, "PACK_BYTES", 300_000)
    assert topk.lane_count(vectors, 2) == 5 and topk.lane_count(vectors.limit(0), 2) == 1
    packs = [p for b in topk._packed(iter(vectors.selectExpr("0L as lane", "row", "id", "v").toArrow().to_batches()), 8192, True, 20) for p in b.to_pylist()]
    assert len(packs) > 10 and all(len(p["rows"]) <= 2 * 300_000 // 4 and p["kind"].endswith("i2") for p in packs)
    want = brute_top([(i, [int(x * 64) for x in v]) for i, v in rows], 5)
    assert sorted(map(tuple, topk.top_k(vectors, F.col("id") % 20 == 0, 5).collect())) == want


# 2


def check_bins(rows, docs, capacity, each):
    bins = {}
    for r in rows:
        bins.setdefault(r["bin_id"], []).append(r)
    for got in bins.values():
        assert sum(r["length"] + 1 for r in got) <= capacity
        assert sorted(r["slot"] for r in got) == list(range(len(got)))
    return bins


def test_best_fit_rule():
    """Against a search over all bins for the tightest compatible one."""
    rng = random.Random(3)
    n = 600
    sizes = sorted((rng.randint(1, 50) for _ in range(n)), reverse=True)
    sources = [rng.choice("aaabcd") for _ in range(n)]
    clusters = [rng.choice([None, None, *range(20)]) for _ in range(n)]
    bins, slots = packing.best_fit(sizes, sources, clusters, 100, 2)
    open_ = []
    for size, s, c, b in zip(sizes, sources, clusters, bins):
        fits = [(left, k) for k, (left, held) in enumerate(open_) if left >= size and [x for x, _ in held].count(s) < 2 and (c is None or c not in [y for _, y in held])]
        want = min(fits)[1] if fits else len(open_)
        assert b == want
        if not fits:
            open_.append([100, []])
        open_[want][0] -= size
        open_[want][1].append((s, c))


def test_pack(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, cluster=packing.text_cluster(), capacity=4000).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for got in check_bins(rows, docs, 4000, 4).values():
        ids = {r["doc_id"] for r in got}
        assert max(map([source[r["doc_id"]] for r in got].count, source.values())) <= 4
        assert len({" ".join(texts[i].split()).lower() for i in ids}) == len(ids)
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == {i: len(t) for i, t in texts.items()}
    whole = packing.bin_texts(docs, spark.createDataFrame(rows), separator="|").collect()
    assert sum(len(r["text"]) for r in whole) == sum(map(len, texts.values())) + len(rows)
    assert packing.pack(empty(spark)).count() == 0
    # 30,000 equal rows, without an id: many shards, none much larger than others
    same = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"), F.lit("s").alias("source"))
    packed = packing.pack(same, cluster=packing.text_cluster()).groupBy(F.shiftright("bin_id", 32).alias("shard")).count().collect()
    assert len(packed) == 8 and sum(r["count"] for r in packed) == 30_000 and max(r["count"] for r in packed) < 4500
    assert packing.pack(odd(spark), cluster=packing.text_cluster()).select("doc_id", "piece").distinct().count() > 10


# 3


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The software is provided \"as is\", without warranty of any kind, express or implied."
    texts = ["Hello.\nReleased under the MIT License.\nBye", "Licensed under the Apache License, Version 2.0.", mit, "All rights reserved! Released under   the mit-license", None, "", "Released under the MIT Licenses.", "you may obtain a copy of the license at"]
    got = [tuple(r) for r in licences.licences(documents(spark, texts)).orderBy("doc_id").collect()]
    assert [g[3] for g in got] == ["MIT", "Apache-2.0", "MIT", "MIT,Proprietary", "", "", "", ""]
    assert got[2][:3] == (2, 3, "8,9,10") and got[7][1] == 1
    assert licences.licences(odd(spark)).count() == 10 and licences.licences(empty(spark)).count() == 0
    words = licences.anchors()
    assert all(any(w in s for w in words) for s in licences.counted())


# 4


def brute_hits(text, items, n=10):
    tokens = decontam.words(text)
    hit, found = set(), set()
    for item, t in items:
        w = decontam.words(t)
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            for j in range(len(tokens) - m + 1):
                if tokens[j : j + m] == w[i : i + m]:
                    hit |= set(range(j, j + m))
                    found.add(item)
    return len(tokens), len(hit), found


@pytest.mark.parametrize("chars", [10**9, 40])
def test_decontamination(spark, chars):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "C", "dé"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 14]) or 0))) for i in range(12)] + [(12, None), (3, "zz yy")]
    items = [(i, t if not t or len(t.split()) > 2 else "q" + t) for i, t in items]
    texts = [" ".join(word() for _ in range(rng.randint(0, 200))) for _ in range(40)] + [None, "", "zz, YY!", "zz"]
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.report(docs, bench, part_chars=chars).collect()}
    for i, t in enumerate(texts):
        n, hit, found = brute_hits(t, items)
        names = sorted(map(str, found))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"]) == (n, hit, len(found))
        assert got[i]["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest() and got[i]["contaminated"] == (hit > 0)
    kept = {r["doc_id"] for r in decontam.decontaminate(docs, bench, part_chars=chars).collect()}
    assert kept == {i for i in got if not got[i]["contaminated"]}
    for r in decontam.decontaminate(docs, bench, mode="span").collect():
        assert len(decontam.words(r["text"])) == got[r["doc_id"]]["n_words"] - got[r["doc_id"]]["n_hit"]
    clash = odd(spark).withColumn("items", F.lit(1)).withColumn("n_words", F.lit(2))
    assert decontam.decontaminate(clash, bench, part_chars=chars).columns == clash.columns
    assert decontam.report(clash, bench, part_chars=chars).count() == 10
    assert decontam.decontaminate(odd(spark), bench).count() == 10 and decontam.report(empty(spark), bench).count() == 0
    assert decontam.report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_one_large_item_is_dealt_in_parts(spark):
    """An item of 5 MB that repeats: no part of it is larger than the bound."""
    rng = random.Random(44)
    item = " ".join(f"w{rng.randrange(10**6)}" for _ in range(650_000))
    bench = spark.createDataFrame([(1, item)] * 3 + [(2, "a b c")], "item_id long, text string")
    parts, n = decontam._parts(bench, "item_id", "text", 10, 10**6)
    sizes = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert n == len(sizes) > 5 and max(sizes.values()) <= 10**6
    words = item.split()
    texts = [" ".join(words[a : a + 10]) for a in (0, 1985, 1995, 3999, 649_990)] + [" ".join(words[649_991:]), "so a b c"]
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontam.report(documents(spark, texts), bench, part_chars=10**6).collect()}
    assert got == {i: (10, 1) for i in range(5)} | {5: (0, 0), 6: (3, 1)}


# 5


def brute_fp(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rng = random.Random(5)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += [t + " tail words here" for t in texts[:40]] + texts[:30] + [None, "", "One", "one", "a b c"]
    del rng
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = [brute_fp(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            a, b = sorted((root(i), root(j)))
            up[b] = a
    for i in range(len(texts)):
        assert got[i]["fingerprint"] == f"{fps[i]:016x}" and got[i]["component_id"] == root(i)
    kept = simhash.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({root(i) for i in range(len(texts))}) and kept.columns == docs.columns
    one = simhash.keep_one(odd(spark)).collect()
    assert sorted(r["doc_id"] for r in one if r["doc_id"] is not None) == [0, 2, 4] and sum(r["doc_id"] is None for r in one) == 2
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.near_duplicates(odd(spark)).count() == 10


def test_links_of_many_shards(spark, monkeypatch):
    """Dense groups over many shards keep their connectedness, with few links."""
    rng = np.random.default_rng(6)
    seeds = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = {int(s) for s in rng.integers(0, 2**63, 1500, dtype=np.uint64)}
    for s in seeds.tolist():
        for _ in range(60):
            x = s
            for b in rng.integers(0, 64, 3).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "SHARD_MIN", 128)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = written(simhash.links(nodes, len(fps)), "edges")
    comp = {r["node"]: r["comp"] for r in simhash.components(edges).collect()}
    at = np.array(fps, np.uint64)
    near = np.bitwise_count(at[:, None] ^ at[None, :]) <= 4
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(1)
        if (new == label).all():
            break
        label = new
    groups = {}
    for f, c in zip(signed, label.tolist()):
        groups.setdefault(c, set()).add(comp.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
    path = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert simhash.components(path).select("comp").distinct().count() == 1


# 6


def test_warc(spark, monkeypatch):
    big, record = "x" * 1500, "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    trap = "<pre>" + record * 3 + "</pre>" + "WARC/1.1\r\n" + "é" * 900 + "\r\n\r\nWARC/1.1\r\n"
    html = [big, big, big, None, "", "short", "short", trap, trap, "WARC/1.1\r\n", "a\nb\r\n\r\nc\r\n\r\n", record, "中文" * 3000]
    rows = [(i, None if i % 5 == 4 else f"http://x/é{i}\r\nX: y", h, 1, "z") for i, h in enumerate(html)] + [(2, "u", big, 1, "z"), (None, "u", big, 1, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, bytes int, sha1 string")
    held = new_path(spark, "pages")
    pages.repartition(5).write.parquet(held)
    for size, repeats, pages in (("1k", 0, pages), ("64m", 9, pages), ("64m", 1, spark.read.parquet(held)), ("64m", 0, spark.read.parquet(held))):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", repeats)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = sorted((tuple(r) for r in warc.report(spark, pages, new_path(spark, "warc")).collect()), key=str)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        want = []
        for i, _, h, _, _ in rows:
            data = (h or "").encode()
            same = [j for j, _, g, _, _ in rows if g == h and j is not None]
            later = i is not None and len(data) >= 1000 and max(same) != i
            want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if later else "response", max(same) if later else None))
        assert got == sorted(want, key=str)
    assert warc.report(spark, pages.limit(0), new_path(spark, "warc")).count() == 0


# 7 and 8


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_classifiers(spark, name):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    op, mod, fold, sign = (quality.quality, 4, 2, 0.7) if name == "quality" else (toxicity.toxicity, 5, 0, 0.5)
    keep = F.crc32(F.col("id").cast("string").cast("binary")) % mod != fold
    got = {r["doc_id"]: r for r in op(docs, labels, keep=keep).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= sign) for r in got.values())
    held = [(r[name], got[r["doc_id"]]["predicted"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % mod == fold]
    assert np.mean([a == b for a, b in held]) > 0.93
    keep_fn = quality.keep_good if name == "quality" else toxicity.keep_civil
    kept = keep_fn(docs, labels, keep=keep)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"] == (name == "quality")}
    assert op(odd(spark), labels).count() == 10 and op(empty(spark), labels).count() == 0
    # a labelled id that repeats teaches once
    many = docs.limit(50).unionByName(docs.limit(1).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(20_000)))).drop("x"))
    every = docs.limit(50).select("doc_id", F.lit(1).alias(name))
    assert learning.labelled(many, every, name, "doc_id", "text", 40).count() == 40
    conflict = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (None, 1, 1), (2, None, None), (3, 7, 7)], "doc_id long, quality int, toxic int")
    assert len({r["score"] for r in op(docs.limit(9), conflict).collect()}) == 1


def test_long_text_scores_as_in_pieces():
    text = "Some words, and more of them. " * 20_000
    rng = np.random.default_rng(7)
    table = rng.normal(size=1 << toxicity.BITS).astype(np.float32)
    data = toxicity.plain(text)
    total = sum(float(table[s].astype(np.float64).sum()) for _, s in toxicity.grams(data)) * toxicity.SCALE / len(data)
    assert abs(toxicity.score_texts([text], table, 0.0)[0] - 1 / (1 + np.exp(-total))) < 1e-3


# 9


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)

    def fits(c):
        n, at = 1, 0
        for s in sizes:
            if at + s > c:
                n, at = n + 1, 0
            at += s
        return n <= shards

    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("points", [65536, 1024])
def test_sharding(spark, points):
    rng = random.Random(8)
    texts = ["t" * rng.randint(0, 300) + rng.choice("abcdé") for _ in range(3000)] + ["hot"] * 500 + [None, None, ""]
    rng.shuffle(texts)
    docs = documents(spark, texts)
    got = sorted(sharding.shard(docs, points=points).collect(), key=lambda r: r["doc_id"])
    first, size = {}, {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
        size[t] = size.get(t, 0) + len((t or "").encode()) + 1
    capacity = brute_capacity([size[t] for t in sorted(first, key=first.get)], 16)
    load, slots, where = {}, {}, {}
    for r, t in zip(got, texts):
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None)
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert where.setdefault(t, r["shard"]) == r["shard"]
    assert max(load.values()) == capacity and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(odd(spark)).count() == 10 and sharding.shard(empty(spark)).count() == 0


# 10


def test_coder():
    rng = np.random.default_rng(9)
    ids = rng.zipf(1.3, 20_000).clip(0, 3000).astype(np.uint32)
    table = tokens.Table(tokens.frequencies(np.bincount(ids)))
    assert table.freq.sum() == 1 << tokens.SCALE
    for n in (0, 1, 63, 64, 65, 20_000):
        data = tokens.encode_block(ids[:n], table, lanes=64, interval=16)
        assert (tokens.decode_block(data, table) == ids[:n]).all()
    assert len(data) < 20_000 * 2
    assert (tokens.decode_block(data, table, checkpoint=3, steps=5) == ids[3 * 16 * 64 :][: 5 * 64]).all()
    broken = bytearray(data)
    broken[-3] ^= 1
    with pytest.raises(ValueError):
        tokens.decode_block(bytes(broken), table)
    alone = tokens.frequencies(np.array([0, 5]))
    assert alone.tolist() == [0, 1 << tokens.SCALE]


def test_encoder_equals_library(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    make = tokens.Encoder(path, 2)
    rng = random.Random(10)
    parts = [" ", " ", " ", "\n", "\t", "a", "word", "It's", "'s", "é", "中", "　", "\xa0", " ", "<|endoftext|>", "12", "!!", ".", "\x1c", "\x85", "\r"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(8000)] + [None, "", " ", "it's we'll I've 'sabc ''s !'s d'm'd", "a\0b", "x" * 300]
    want = [e.ids + [2] for e in make.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]

    def lists(found):
        ids, n = found
        return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]

    assert lists(make(texts)) == want
    assert lists(make(texts[:50])) == want[:50]
    # with a memory of few pieces, and texts in parts
    monkeypatch.setattr(tokens, "PIECES", 100)
    monkeypatch.setattr(tokens, "CHARS", 500)
    texts = texts[:2000] + [" ".join(t or "" for t in texts[2000:3000]), "word " * 1000, "中" * 3000]
    want = want[:2000] + [e.ids + [2] for e in make.library.encode_batch(texts[2000:], add_special_tokens=False)]
    assert [x for found in make.slices(texts) for x in lists(found)] == want
    # pieces of one hash: the library decides
    monkeypatch.setattr(make, "_hashes", lambda codes, starts, width: width.astype(np.uint64))
    assert lists(make(texts[:300])) == want[:300]


def test_encoder_asks_the_library_what_letters_are():
    """Every assigned character between letters, digits and signs."""
    import public_tokenizers

    make = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 2)
    every = [chr(c) for c in range(1, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c}!{c} b {c}" for c in every[i : i + 50]) for i in range(0, len(every), 50)]
    ids, n = make(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids + [2] for e in make.library.encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(documents(spark, [None, ""], [9001, 9000]).select("doc_id", "text"))
    out = new_path(spark, "tokens")
    tokens.encode(docs, out, path, block=3000)
    got = sorted(tokens.digest(spark, out).collect())
    library, start = Tokenizer.from_file(path), 0
    for r, d in zip(got, sorted(docs.collect()), strict=True):
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        assert tuple(r) == (d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [len(r["ids"]) for r in tokens.decode(spark, out).orderBy("doc_id").collect()] == [r[2] for r in got]
    assert tokens.report(spark, odd(spark), path).count() == 10 and tokens.report(spark, empty(spark), path).count() == 0
    # rows of one id are dealt over the ranges, and are still in order
    same = documents(spark, [f"text {i}" for i in range(4000)] + ["other"], [7] * 4000 + [8])
    tokens.encode(same, out + "-same", path)
    assert spark.read.parquet(f"{out}-same/blocks").select("part").distinct().count() > 1
    got = sorted(tokens.digest(spark, out + "-same").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [7] * 4000 + [8] and all(a["start"] + a["n_tokens"] == b["start"] for a, b in itertools.pairwise(got))


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, docs, sf), name)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
        docs = kept
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = decontam.Windows(items)
    assert not any(windows.hits(decontam.words(r["text"]))[1] for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd(spark), sf) is not None and stage(spark, empty(spark), sf).count() == 0

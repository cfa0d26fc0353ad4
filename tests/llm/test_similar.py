"""The near-duplicate stage of the pipeline against brute force."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from punctuality.llm import similar

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def sets_of(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_copies(spark):
    """Copies with a few words changed, at similarities around 0.8, in chains and groups."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for size in (8, 30, 120, 400):
        for _ in range(12):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for changes in (1, 2, size // 60, size // 40, size // 25):
                copy = list(base)
                for at in rng.sample(range(size), changes):
                    copy[at] = word()
                texts.append(" ".join(copy))
            texts += [" ".join(base + [word() for _ in range(size // 6)]), " ".join(base).upper()]
    base = [word() for _ in range(300)]
    for _ in range(80):
        copy = list(base)
        copy[rng.randrange(300)] = word()
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    found = [sets_of(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(found[i] & found[j])
        if both * 10 >= 8 * (len(found[i]) + len(found[j]) - both):
            a, b = sorted((root(i), root(j)))
            up[b] = a
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + [rows[root(7)], (None, texts[9], "en", "s", 1), (None, None, "en", "s", 1)], DOCS)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(None) == 2
    assert sorted(i for i in ids if i is not None) == sorted({root(i) for i in range(len(texts))})


def test_search_tells_who_has_candidates_of_other_classes(monkeypatch):
    monkeypatch.setattr(similar.simhash, "LEAF", 64)
    monkeypatch.setattr(similar.simhash, "TILE", 256)
    rng = np.random.default_rng(12)
    fps = rng.integers(0, 2**63, 40, dtype=np.uint64)[rng.integers(0, 40, 1500)] ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))
    rows = np.stack([fps, rng.integers(0, 9, 1500).astype(np.uint64), np.arange(1500, dtype=np.uint64), *[fps * 0] * 8])
    want = {(i, j) for i in range(1500) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 20 and rows[1, i] != rows[1, j]}

    def covered(found, pairs):
        """Every pair is in some block, and a node is there only if it has a pair."""
        together = set()
        for a, b in found.values():
            a, b = set(a.tolist()), set(b.tolist())
            together |= {(i, j) for i, j in pairs if i in a and j in b or j in a and i in b}
            named = a | b
            assert named <= {k for p in pairs for k in p}
        return together == pairs

    one = rows[:, :300].copy()
    one[1] = 1
    assert similar.near(one, None) == {}  # all of one class
    assert covered(similar.near(rows, None), want)
    assert covered(similar.near(rows[:, :700], rows[:, 700:]), {(i, j) for i, j in want if i >= 700 > j})


def test_small_shards_are_merged(spark, monkeypatch):
    rng = np.random.default_rng(5)
    names = ["fp", "comp", "node", *similar._SKETCH]
    rows = rng.integers(-(2**63), 2**63, (300, len(names)))
    nodes = spark.createDataFrame(rows.tolist(), ", ".join(f"{c} long" for c in names))
    small = similar.simhash.shards(nodes, 300, tuple(names[1:]), 16, 20).cache()

    def held(shards):
        cells = [np.frombuffer(r["fps"], np.int64).reshape(len(names), -1).T for r in shards.collect()]
        return sorted(map(tuple, np.concatenate(cells).tolist()))

    one = similar.merged(small, 300, len(names))
    assert small.count() > 14 and one.count() == 1 and held(one) == held(small) == sorted(map(tuple, rows.tolist()))
    row, parts = one.first(), small.collect()
    assert row["lo"] == [min(x) for x in zip(*(p["lo"] for p in parts), strict=True)] and row["hi"] == [max(x) for x in zip(*(p["hi"] for p in parts), strict=True)]
    monkeypatch.setattr(similar.simhash, "SHARD_MIN", 64)
    some = similar.merged(small, 300, len(names)).collect()
    assert 1 < len(some) < small.count() and all(len(r["fps"]) <= 64 * 8 * len(names) for r in some)


def test_other_columns_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b c", "mine", 7), (2, "a b c", "other", 8), (3, "d", None, None)], "doc_id long, text string, _near_node string, _NEAR_NODE_ int")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(1, "a b c", "mine", 7), (3, "d", None, None)]


def test_a_group_of_unlike_near_copies_stays(spark):
    """400 texts of one template, each pair under 0.8: no pair is linked, none is lost."""
    rng = random.Random(13)
    base = [f"t{i}" for i in range(30)]
    texts = []
    for k in range(400):
        copy = list(base)
        for at in (rng.randrange(30), rng.randrange(30)):
            copy[at] = f"x{k}y{at}"
        texts.append(" ".join(copy))
    texts += [texts[7] + " end", texts[7] + " end of it"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())
    found = [sets_of(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(found[i] & found[j])
        if both * 10 >= 8 * (len(found[i]) + len(found[j]) - both):
            a, b = sorted((root(i), root(j)))
            up[b] = a
    assert kept == sorted({root(i) for i in range(len(texts))}) and len(kept) < len(texts)


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    from punctuality.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 99), (3, 98), (None, 97)], "k int, v int")
    other = spark.createDataFrame([(1, "a"), (2, "b")], "k int, w string")
    for how in ("left", "inner"):
        assert sorted(map(str, shared.join_skewed(rows, other, "k", how).collect())) == sorted(map(str, rows.join(other, "k", how).collect()))


def test_kept_texts_of_the_sample_have_no_near_copy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = [sets_of(r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").select(F.col("text")).collect()]
    for a, b in itertools.combinations(kept, 2):
        assert len(a & b) * 10 < 8 * len(a | b)

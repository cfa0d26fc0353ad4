"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from punctuality.llm import phrases


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows, top=2000):
    """rows: (doc_id, text, lang)"""
    f, total = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        c = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\n-\r]", lower(text or "")):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for n in (1, 2, 3):
                c.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in f.items():
        kept = []
        for g, a in c.items():
            if len(g) < 2 or a < 10:
                continue
            score, _, left, right = min((1_000_000 * a * a // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            if len(g) == 2 and any(100 * b >= 50 * a and b >= 10 and g in (h[:2], h[1:]) for h, b in c.items() if len(h) == 3):
                continue
            kept.append((-score, -a, " ".join(g).encode(), left, right))
        for i, (score, a, g, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, i, g.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def made(n, seed=3):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "b", "cé", "d d", "Ée", "f'", "g-", "\U0001f600", "x" * 40]
    gap = [" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "\r\n", "\x0b"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice(gap) for _ in range(rng.choice([0, 1, 2, 5, 40, 200])))
        rows.append((i % 150 if i % 11 else None, rng.choice([text, text, None]) if i % 5 == 0 else text, rng.choice(["en", "de", None, "", "x\ny"])))
    return [*rows, rows[-1], rows[-1], (1, "one two three " * 3000, "en"), (2, ", ".join(["hot dog stand"] * 500), "en"), (3, " \t.,", "zz")]


def test_against_plain_count(spark):
    rows = made(200)
    docs = spark.createDataFrame([(*r, "mine", 1) for r in rows], "doc_id long, text string, lang string, print string, n int").repartition(3)
    out = phrases.collocations(docs)
    got = sorted(tuple(r)[:8] for r in out.collect())
    assert got == plain(rows)
    for r in out.where("first_doc is not null").limit(50).collect():
        texts = [" ".join(re.findall(r"[^ \t]+", lower(t))) for i, t, lang in rows if i == r["first_doc"] and (lang or ("und" if lang is None else "")) == r["lang"] and t]
        assert any(r["phrase"] in t for t in texts)


def test_top(spark):
    rows = made(200, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(tuple(r)[:8] for r in phrases.collocations(docs, top=7).collect()) == plain(rows, 7)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None), (2, "", "en")], none.schema)).count() == 0


@pytest.mark.parametrize("size", [1, 7, 64])
def test_slices_lose_no_run(monkeypatch, size):
    monkeypatch.setattr(phrases, "SLICE", size)
    rows = made(60, 4)
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "und" for r in rows], "text": [r[1] for r in rows]})
    found = Counter()
    for text, of, starts in phrases.slices(batch):
        words = phrases.Words(text, phrases._Powers())
        row = of[np.searchsorted(starts, words.at, "right") - 1]
        norm = words.norm.tobytes()
        for i in words.runs(3).tolist():
            assert row[i] == row[i + 2]
            found[int(row[i]), norm[words.off[i] : words.off[i + 3] - 1]] += 1
    want = Counter()
    for k, (_, text, _lang) in enumerate(rows):
        for piece in re.split(r"[.,;:!?\n-\r]", lower(text or "")):
            w = re.findall(r"[^ \t]+", piece)
            want.update((k, " ".join(w[i : i + 3]).encode()) for i in range(len(w) - 2))
    assert found == want


def test_texts_of_one_fingerprint_are_told_apart():
    text = np.frombuffer(b"ab cd ab ce ab cd abc d\n", np.uint8)
    words = phrases.Words(text, phrases._Powers())
    first = words.runs(2)
    same = np.full(len(first), 7, np.uint64)
    got = phrases._told(words, 2, first, same, np.zeros(len(words.at), np.int64), ["en"], pa.array([5]))
    count = Counter()
    for p, n in zip(got.column("key").to_pylist(), got.column("n").to_pylist(), strict=True):
        count[p.removeprefix("en\n")] += n
    assert count == {"ab cd": 2, "cd ab": 1, "ab ce": 1, "ce ab": 1, "cd abc": 1, "abc d": 1}


def test_fingerprints_are_those_of_the_bytes_alone():
    powers = phrases._Powers()
    one, two = (phrases.Words(np.frombuffer(t, np.uint8), powers) for t in (b"q the big dog\n", b"x. y  the\tbig  dog z\n"))
    seed = np.zeros(9, np.uint64)
    assert one.prints(np.array([1]), 3, seed) == two.prints(np.array([2]), 3, seed)
    assert one.prints(np.array([1]), 3, seed) != one.prints(np.array([1]), 3, seed + np.uint64(1))

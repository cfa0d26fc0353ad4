"""Tokenizer alignment against a plain reading of its definition."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from punctuality.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
_letters = alignment.byte_letters()


def plain(rows):
    one, other = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    held, holds = [], Counter()
    for i, text in rows:
        groups = []
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, other.encode(text)
            ba = [bytes(_letters[c] for c in one.id_to_token(x)) for x in a]
            bb = [bytes([int(p[3:5], 16)]) if other.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(b, map(other.id_to_piece, b), strict=True)]
            if b"".join(ba) == b"".join(bb) == (" " + text).encode():
                i_a = i_b = end_a = end_b = 0
                group = ([], [])
                while i_a < len(a) or i_b < len(b):
                    if end_a <= end_b:
                        group[0].append(a[i_a])
                        end_a += len(ba[i_a])
                        i_a += 1
                    else:
                        group[1].append(b[i_b])
                        end_b += len(bb[i_b])
                        i_b += 1
                    if end_a == end_b:
                        groups.append(group)
                        group = ([], [])
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        holds.update(links.keys())
        held.append((i, groups, links))
    top = {}
    for (x, _), n in holds.items():
        top[x] = max(n, top.get(x, 0))
    out = []
    for i, groups, links in held:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for p, n in links.items() if holds[p] == top[p[0]])
        total = sum(n * holds[p] for p, n in links.items())
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), links.total(), best, total, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


TEXTS = [
    "Hello world", "Hello  world", " leading", "trailing ", "  ", " ", "", None, "a\nb\n c", "tab\tx \t y", "<|endoftext|> <s> </s> <unk> <0x41>", "x▁y z", "▁", "Ünïcödé ñandú",
    "日本語のテキスト と 空白", "🙂🙂 🙃", "nul\0 byte", "end　 wide", "don't we'll I'M", "a  b", "x\x1c y", "᠎ z", "é é", "1234567 89 3.14", "...!!! ?? --", "{}[] ()<>", "the " * 3000,
    "q" * 5000, "日" * 700, "\r\n\r\n  \r\n", "a" * 70 + " " + "b" * 63 + " c",
]


def key(row):
    return tuple(str(v) for v in row)


@pytest.mark.parametrize("dealt", [False, True])
def test_against_the_definition(spark, monkeypatch, dealt):
    if dealt:
        monkeypatch.setattr(alignment, "MOST_PAIRS", 0)
        monkeypatch.setattr("punctuality.llm.shared.HOT_ROWS", 3)
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()
    rows = [*[(None if i == 3 else i % 29, t) for i, t in enumerate(TEXTS)], *[tuple(r) for r in real], *[tuple(r) for r in real[:3]]]
    docs = spark.createDataFrame([(*r, 1, "mine") for r in rows], "doc_id long, text string, n_a int, pair string").repartition(3)
    out = alignment.report(docs, A, B)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(key, out.collect())) == sorted(map(key, plain(rows)))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.report(none, A, B).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], none.schema)
    assert sorted(map(tuple, alignment.report(only, A, B).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_words_give_what_whole_texts_give():
    by_word, whole = alignment.Aligner(A, B), alignment.Aligner(A, B)
    whole.cuts = False
    for one, other in zip(by_word.rows(TEXTS)[:2], whole.rows(TEXTS)[:2], strict=True):
        assert np.array_equal(np.array(one, object), np.array(other, object))


def test_bitmaps_keep_documents_and_numbers():
    rng = np.random.default_rng(1)
    codes, doc, often = rng.integers(0, 5, 9000).astype(np.uint64), rng.integers(0, alignment.CHUNK, 9000), rng.integers(1, 5, 9000)
    codes[:20], doc[:20] = 9, 7  # many times in one document
    want = Counter()
    for c, d, n in zip(codes.tolist(), doc.tolist(), often.tolist(), strict=True):
        want[c, d] += n
    got, docs = Counter(), Counter()
    for pair, plane, count, bits in alignment.bitmaps(codes, often, doc):
        for c, n in zip(pair.tolist(), count.tolist(), strict=True):
            docs[c] += n
        for d, row in zip(*map(np.ndarray.tolist, alignment.members(bits)), strict=True):
            got[int(pair[row]), d] += 1 << max(plane, 0)
    assert got == want
    assert docs == Counter(c for c, _ in want)


def test_heavy_groups_are_counted_by_ids(monkeypatch):
    make = alignment.Aligner(A, B)
    found = make.align("日本語🙂🙂" * 30 + "é")
    light = Counter()
    for c, n in zip(*map(np.ndarray.tolist, found.pairs()), strict=True):
        light[c] += n
    monkeypatch.setattr(alignment, "HEAVY", 0)
    heavy = Counter(dict(zip(*map(np.ndarray.tolist, found.pairs()), strict=True))) if len(found.ends) == 1 else Counter()
    if not heavy:
        for c, n in zip(*map(np.ndarray.tolist, found.pairs()), strict=True):
            heavy[c] += n
    assert light == heavy

"""Collocations: phrases of two or three words that stand together more often than their
parts would by chance, of each language.

Every phrase is known by a Rabin-Karp fingerprint: polynomials over the bytes of all the
text before a place (numpy sums) give that of any run of words by a difference. Phrases are
counted level by level, so that nothing is shuffled that can't be frequent: words; pairs of
words that are both frequent; triples of words whose two pairs are. What is frequent goes to
the next level as a bit filter of at most 2**MOST_BITS bits (128 MB; with more than some 130 million
frequent phrases it lets more through than it need, and nothing is lost). A fingerprint's
count is never less than that of any of its phrases. So those that are frequent are then read in the texts:
the shuffle brings together each one's texts with their numbers and a pointer to an occurrence (the
smallest id of a document that holds it), so that different texts of one fingerprint are told apart and
counted apart. Nothing but frequent phrases is ever made into text. (Pointers travel with the frequent
fingerprints alone: beside all of them they would double what the counting moves.)

Defined results: A-Z are lower-cased; a null text is empty; a null language is `und`; phrases don't
cross [.,;:!?] or line ends, nor documents; very long texts are read whole (in slices cut between
pieces); repeated rows count each; ties of scores go by number, then by the phrase's bytes;
an empty table gives an empty result; other columns are kept out, whatever they are called. Numbers
are whole: the products of a score are decimals of 38 digits, exact up to counts of 10**16.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctuality.llm.shared import join_skewed, scratch, written

LEAST, INSIDE, TOP, PARTS = 10, 50, 2000, 16
WORDS = 3
#: Bytes of text that are hashed at once, but for longer pieces; the filter's greatest size.
SLICE, MOST_BITS = 2 << 20, 30
_PAGE = 15  # bits of a page of the filter, as bitmap_construct_agg makes them

# What ends a word, what ends a piece.
_BLANKS = [0x20, 0x09]
_STOPS = [*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]

_KIND = np.zeros(256, np.uint8)
_KIND[_BLANKS], _KIND[_STOPS] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MIX, _SPREAD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = (np.full(n + n // 2, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.cumprod(self.up), np.cumprod(self.down)
        return self.up[:n], self.down[:n]


class Words:
    """The words of a slice of text: norm (each word and one space after it), off (where
    each starts in that, and the end), at (where each starts in the slice), piece."""

    def __init__(self, text: np.ndarray, powers: _Powers):
        kind = _KIND[text]
        inside = np.zeros(len(text) + 2, bool)
        inside[1:-1] = kind == 0
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.at, ends = edges[::2], edges[1::2]
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.at]
        keep = kind == 0
        keep[ends] = True  # a slice ends with a stop
        self.norm = text[keep]
        self.off = np.concatenate([[0], np.cumsum(ends - self.at + 1)])
        self.norm[self.off[1:] - 1] = 32
        up, self.down = powers.get(len(self.norm) + 1)
        self.sums = np.zeros(len(self.norm) + 1, np.uint64)
        np.cumsum(_BYTE[self.norm] * up[:-1], out=self.sums[1:])

    def runs(self, n: int) -> np.ndarray:
        """The first words of the runs of n words within a piece."""
        return np.flatnonzero(self.piece[: max(0, len(self.piece) - n + 1)] == self.piece[n - 1 :])

    def prints(self, first: np.ndarray, n: int, seed: np.ndarray) -> np.ndarray:
        """The fingerprints of runs of n words; seed stands for the language of each."""
        a, b = self.off[first], self.off[first + n] - 1
        x = (self.sums[b] - self.sums[a]) * self.down[a] + seed[first]
        x = (x ^ (x >> np.uint64(32))) * _MIX
        return x ^ (x >> np.uint64(29))


def slices(batch: pa.RecordBatch):
    """(text, rows, starts) of a batch (lang, text, ...): lower-case bytes cut between pieces, the rows
    whose text ends in it or goes on, and where each of these starts (before the slice: negative)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
    group = np.cumsum(lengths) // SLICE  # few rows are made bytes at once
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).slice(a, b - a).to_pylist()]
        text = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
        ends, at = np.cumsum([len(t) + 1 for t in texts]), 0
        while at < len(text):
            stop = len(text)
            if stop - at > SLICE:
                stops = np.flatnonzero(_KIND[text[at : at + SLICE]] == 2)
                stop = at + 1 + (int(stops[-1]) if len(stops) else SLICE + int(np.argmax(_KIND[text[at + SLICE :]] == 2)))
            rows = np.arange(np.searchsorted(ends, at, "right"), np.searchsorted(ends, stop, "left") + 1)
            yield text[at:stop], rows + a, np.concatenate([[0], ends])[rows] - at
            at = stop


def _lang_seeds(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(lang.encode(), seed=11) for lang in langs], np.uint64)


def in_filter(prints: np.ndarray, held: np.ndarray) -> np.ndarray:
    found = np.ones(len(prints), bool)
    for at in places(prints, (len(held) * 8).bit_length() - 1):
        found[found] = (held[at[found] >> 3] >> (at[found] & 7).astype(np.uint8)) & 1 == 1
    return found


def places(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A fingerprint's two places in a filter of 2**bits bits."""
    shift = np.uint64(64 - bits)
    return (prints >> shift).astype(np.int64), ((prints * _SPREAD) >> shift).astype(np.int64)


def frequent_filter(frequent: DataFrame):
    """A broadcast of the bits of the fingerprints in frequent (print)."""
    spark = frequent.sparkSession
    bits = min(MOST_BITS, max(_PAGE, (16 * frequent.count()).bit_length()))

    def each(batches):
        for batch in batches:
            at = np.concatenate(places(batch.column(0).to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> _PAGE), pa.array(at & ((1 << _PAGE) - 1))], names=["page", "bit"])

    pages = frequent.select("print").mapInArrow(each, "page long, bit long").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    held = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (_PAGE - 3)
    for row in pages.toLocalIterator():  # at most 2**(MOST_BITS - 15) pages of 4 KB
        held[row["page"] * size : (row["page"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)[:size]
    return spark.sparkContext.broadcast(held)


def candidates(words: Words, n: int, seed: np.ndarray, held: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """First words and fingerprints of runs of n words; held: of the level below, both of
    whose runs must be in it."""
    first = words.runs(n)
    if held is not None and len(first):
        below = words.runs(n - 1)
        there = np.zeros(len(words.at) + 1, bool)
        there[below] = in_filter(words.prints(below, n - 1, seed), held)
        first = first[there[first] & there[first + 1]]
    return first, words.prints(first, n, seed)


def counted(docs: DataFrame, n: int, held=None) -> DataFrame:
    """(print, n): how often each fingerprint of n words occurs, if often enough."""

    def each(batches):
        powers = _Powers()
        bits = None if held is None else held.value
        for batch in batches:
            seeds = _lang_seeds(batch.column(0).to_pylist())
            for text, rows, starts in slices(batch):
                words = Words(text, powers)
                seed = seeds[rows[np.searchsorted(starts, words.at, "right") - 1]]
                prints, number = np.unique(candidates(words, n, seed, bits)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(number)], names=["print", "n"])

    found = docs.select("lang", "text").mapInArrow(each, "print long, n long")
    return found.groupBy("print").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def read(docs: DataFrame, filters: list) -> DataFrame:
    """(key, n, first): the phrases of 1 to WORDS words in the texts whose fingerprints are in
    the filter of their size, each text counted by itself, with the smallest id of a
    document that holds it; the key is language, line break, phrase. Without a phrase: all words of a language."""

    def each(batches):
        powers = _Powers()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            seeds, ids = _lang_seeds(langs), batch.column(2)
            for text, rows, starts in slices(batch):
                words = Words(text, powers)
                row = np.searchsorted(starts, words.at, "right") - 1
                seed = seeds[rows[row]]
                of = [langs[i] for i in rows.tolist()]
                yield _rows(of, [b""] * len(rows), np.bincount(row, minlength=len(rows)), ids.take(pa.array(rows)))
                for n, held in enumerate(filters, 1):
                    first, prints = candidates(words, n, seed, None)
                    ok = in_filter(prints, held.value)
                    yield _told(words, n, first[ok], prints[ok], row, of, ids.take(pa.array(rows)))

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("lang", "text", "doc_id").mapInArrow(each, f"key string, n long, doc_id {kind}")
    return found.groupBy("key").agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"))


def _told(words: Words, n: int, first: np.ndarray, prints: np.ndarray, row: np.ndarray, of: list[str], ids: pa.Array) -> pa.RecordBatch:
    """The different phrases among runs of words: same fingerprint, language, length and
    bytes. row: of each word its text; of and ids: the texts' languages and ids."""
    _, example, which, number = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
    a, size = words.off[first], words.off[first + n] - 1 - words.off[first]
    one = example[which]
    lang = np.unique(np.array(of, object).astype(str), return_inverse=True)[1][row[first]] if of else row[first]
    same = (size == size[one]) & (lang == lang[one])
    for k in range(int(size.max(initial=0))):  # byte by byte, all runs at once
        some = np.flatnonzero(same & (size > k))
        some = some[one[some] != some]
        same[some] = words.norm[a[some] + k] == words.norm[a[one[some]] + k]
    lone = np.flatnonzero(~same)  # another text of the same fingerprint: rows of their own
    number = number - np.bincount(which[lone], minlength=len(number))
    shown = np.concatenate([example, lone])
    number = np.concatenate([number, np.ones(len(lone), np.int64)])
    norm, at = words.norm.tobytes(), row[first[shown]]
    text = [norm[i : i + m] for i, m in zip(a[shown].tolist(), size[shown].tolist(), strict=True)]
    return _rows([of[i] for i in at.tolist()], text, number, ids.take(pa.array(at)))


def _rows(langs: list[str], text: list[bytes], number: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    keys = [f"{lang}\n{t.decode('utf-8', 'surrogatepass')}" for lang, t in zip(langs, text, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(number.astype(np.int64)), ids], names=["key", "n", "doc_id"])


def frequent(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, size, phrase, n, first): all frequent phrases of 1 to WORDS words, by text;
    of size 0 (without a phrase) the words of each language. Written."""
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("doc_id")
    )
    filters = []
    try:
        with scratch(docs.sparkSession):
            for n in range(1, WORDS + 1):
                held = filters[-1] if filters else None
                filters.append(frequent_filter(written(counted(rows, n, held), "phrase-prints")))
            # a phrase has no line break, a language may
            lang, phrase = F.regexp_extract("key", r"(?s)^(.*)\n", 1), F.substring_index("key", "\n", -1)
            told = read(rows, filters).select(lang.alias("lang"), phrase.alias("phrase"), "n", "first")
            size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
            return written(told.withColumn("size", size).where((F.col("n") >= LEAST) | (F.col("size") == 0)), "phrases", keep=True)
    finally:
        for held in filters:
            held.destroy()


def scored(found: DataFrame) -> DataFrame:
    """Of phrases (see frequent) those of two words or more: a, the l and r of the cut that
    scores least, and that score."""
    key = lambda phrase: F.concat("lang", F.lit("\n"), phrase)
    many = found.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), "first", F.split("phrase", " ").alias("w"))
    part = lambda i, n: F.array_join(F.slice("w", i, n), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), part(1, k).alias("left"), part(k + 1, F.col("size") - k).alias("right")))
    rows = many.withColumn("cut", F.explode(cuts)).select("lang", "size", "phrase", "a", "first", "cut.*").withColumns({"left": key("left"), "right": key("right")})
    counts = found.where("size > 0").select(key("phrase").alias("key"), "n")
    with_l = join_skewed(rows, counts.select(F.col("key").alias("left"), F.col("n").alias("l")), "left", "inner")
    both = join_skewed(written(with_l, "phrase-cuts"), counts.select(F.col("key").alias("right"), F.col("n").alias("r")), "right", "inner")
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    top, under = (exact("a") * exact("a")).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)"), exact("l") * exact("r")
    cut = both.withColumns({"top": top.cast("decimal(38,0)"), "under": under}).withColumn("score", F.expr("top div under").cast("long"))
    best = cut.groupBy("lang", "size", "phrase", "a", "first").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "size", "phrase", "a", "first", "b.l", "b.r", "b.score", "b.k")


def outer(rows: DataFrame) -> DataFrame:
    """Phrases without those that are mostly part of a longer one."""
    w = F.split("phrase", " ")
    inner = F.explode(F.array_distinct(F.array(F.array_join(F.slice(w, 1, 2), " "), F.array_join(F.slice(w, 2, 2), " "))))
    longer = rows.where("size = 3").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return rows.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < INSIDE * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """Of each language the first phrases by score: lang, rank, phrase, a, l, r, n, score, and
    first_doc (the smallest id of a document that holds it)."""
    with scratch(docs.sparkSession):
        found = frequent(docs, id_col, text_col, lang_col)
        total = found.where("size = 0").groupBy("lang").agg(F.sum("n").alias("n"))  # a row a language
        kept = written(outer(written(scored(found), "phrase-scores")), "phrase-kept", keep=True)
        totals = written(total, "phrase-words", keep=True)
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(*order))
    # first within parts of each language, so that no task gets more of one than PARTS * top
    best = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", rank("part")).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", rank()).where(F.col("rank") <= top).join(totals, "lang")
    return ranked.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score",
        F.col("first").alias("first_doc"),
    )

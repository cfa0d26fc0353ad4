"""Alignment of two tokenizers: which tokens of one stand for which of the other, and how
common that is in all documents.

Both tokenizers cut a text's bytes; where both cut, a group of tokens ends, and all pairs of a token
of A and one of B in a group are linked. Links are kept as an inverted index: for each pair of
ids and each chunk of up to CHUNK documents a compressed bitmap of the documents that hold it
(numbers while they are few, bits beyond), and, where a document holds it more than once, bit planes
of how often it holds it again. A pair's documents are the sum of the bits of its bitmaps, as chunks share
no document (within a chunk the bitmaps of all slices of text are merged); the postings then
bring the scores back: they are joined with their pairs' counts and summed chunk by
chunk, so that no list of a pair's documents is ever in one place.

Words that begin with a space after a letter, digit or ASCII sign are cut apart by both tokenizers (which is
checked in their vocabularies), so that a word is aligned once while it is remembered; what is cut elsewhere
goes to the libraries whole.

Defined results: null and empty texts, and texts that the tokens of either side don't give back byte
for byte, have no tokens: zeros and an empty groups_sha256; the signs of special tokens in a
text are plain text; very long texts are taken whole; repeated rows are documents of their own; null ids
stay null; an empty table gives an empty result; other columns are kept out, whatever they are called.
"""

from __future__ import annotations

import functools
import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctuality.llm.shared import join_skewed, scratch, written

#: Documents and links of a chunk, and documents that are kept as numbers in a bitmap.
CHUNK_BITS, LINKS, SPARSE = 12, 2 << 20, 255
CHUNK = 1 << CHUNK_BITS
#: Characters and numbers of the words that are remembered, at most but for those of one call.
MEMORY = 32 << 20
#: Bits of an id in a pair; words that are remembered, and the longest that are joined; characters of texts and
#: words that are worked on at once; a group of more links is counted by its different ids.
ID_BITS, WORDS, LONGEST, CHARS, JOINED, HEAVY = 26, 400_000, 64, 1 << 20, 256, 4096
#: Pairs that are broadcast with their counts, at most (32 bytes each); more are joined by a shuffle.
MOST_PAIRS = 1 << 20
_SIGNS = set(range(0x21, 0x30)) | set(range(0x3A, 0x41)) | set(range(0x5B, 0x61)) | set(range(0x7B, 0x7F))


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for
    themselves, the others for letters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(other)}


def token_bytes_a(library) -> list[bytes]:
    letters, vocabulary = byte_letters(), library.get_vocab(with_added_tokens=True)
    added = {t.content for t in library.get_added_tokens_decoder().values()}
    out = [b""] * (max(vocabulary.values()) + 1)
    for word, i in vocabulary.items():
        out[i] = word.encode() if word in added else bytes(letters[c] for c in word)
    return out


def token_bytes_b(library) -> list[bytes]:
    one = lambda i, piece: bytes([int(piece[1:-1], 16)]) if library.is_byte(i) else piece.replace("▁", " ").encode()
    return [one(i, library.id_to_piece(i)) for i in range(library.get_piece_size())]


class Aligned:
    """One text's tokens and groups: ids and ends (in bytes) of both sides, and the ends of
    groups; at: of each token its group."""

    def __init__(self, a, b, ends_a, ends_b):
        self.a, self.b, self.ends_a, self.ends_b = a, b, ends_a, ends_b
        place = np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)
        self.ends = ends_a[ends_b[place] == ends_a]
        self.at_a, self.at_b = np.searchsorted(self.ends, ends_a), np.searchsorted(self.ends, ends_b)
        self.n_a, self.n_b = (np.bincount(at, minlength=len(self.ends)) for at in (self.at_a, self.at_b))
        self.links = self.n_a * self.n_b

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs and how often they are linked; a pair may stand there several times."""
        light = self.links <= HEAVY
        i = np.flatnonzero(light[self.at_a])
        times = self.n_b[self.at_a[i]]
        first = (np.cumsum(self.n_b) - self.n_b)[self.at_a[i]]
        j = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        pair = lambda a, b: (a.astype(np.uint64) << np.uint64(ID_BITS)) | b.astype(np.uint64)
        codes, number = [pair(np.repeat(self.a[i], times), self.b[j])], [np.ones(len(j), np.int64)]
        for g in np.flatnonzero(~light).tolist():
            a, many_a = np.unique(self.a[self.at_a == g], return_counts=True)
            b, many_b = np.unique(self.b[self.at_b == g], return_counts=True)
            codes.append(pair(np.repeat(a, len(b)), np.tile(b, len(a))))
            number.append(np.outer(many_a, many_b).ravel())
        return np.concatenate(codes), np.concatenate(number)

    def tokens(self, size: int, size_b: int) -> np.ndarray:
        """The tokens in the order in which groups are told, as places in Aligner.shown."""
        last_a, last_b = (np.append(at[1:] != at[:-1], True) for at in (self.at_a, self.at_b))
        before_b, before_a = np.cumsum(self.n_b) - self.n_b, np.cumsum(self.n_a)
        out = np.empty(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + before_b[self.at_a]] = self.a + size * last_a
        out[np.arange(len(self.b)) + before_a[self.at_b]] = self.b + 2 * size + size_b * last_b
        return out


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.one, self.other = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.one.encode_special_tokens = True
        self.bytes_a, self.bytes_b = token_bytes_a(self.one), token_bytes_b(self.other)
        self.size_a, self.size_b = (np.array([len(t) for t in of]) for of in (self.bytes_a, self.bytes_b))
        cutter = self.one.pre_tokenizer
        spaces_apart = not any(" " in t.lstrip(b" ").decode("utf-8", "replace") for t in self.bytes_b)
        self.cuts = spaces_apart and self.one.normalizer is None and isinstance(cutter, ByteLevel) and cutter.use_regex and not cutter.add_prefix_space
        ids = [[str(i) for i in range(len(of))] for of in (self.bytes_a, self.bytes_b)]
        self.shown = [f"{i}{sign}" for of, signs in zip(ids, (",|", ",;"), strict=True) for sign in signs for i in of]
        self._forget()

    def _forget(self) -> None:
        #: Of words their entries, -1 for words that can't be cut off from what follows.
        self.known: dict[str | tuple[str], int] = {}
        self.told: list[str | None] = []  # None: the tokens don't give the word back
        self.numbers, self.codes, self.often, self.start = array("q"), array("Q"), array("q"), array("q", [0])
        self.size = 0

    def align(self, text: str) -> Aligned | None:
        """The text with a space before it; None if the tokens of a side don't give it back."""
        target = b" " + text.encode("utf-8", "surrogatepass")
        a, b = self.one.encode(" " + text, add_special_tokens=False).ids, self.other.encode(text)
        if not b or b"".join(map(self.bytes_a.__getitem__, a)) != target or b"".join(map(self.bytes_b.__getitem__, b)) != target:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return Aligned(a, b, np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))

    def _keep(self, key, told: str | None, numbers, codes, often) -> None:
        self.known[key] = len(self.told)
        self.told.append(told)
        self.size += len(told or "") + len(codes)
        self.numbers.extend(numbers)
        self.codes.frombytes(codes.tobytes())
        self.often.frombytes(often.tobytes())
        self.start.append(len(self.codes))

    def _alone(self, key, word: str) -> None:
        found = self.align(word)
        if found is None:
            self._keep(key, None, (0, 0, 0, 0), np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return
        told = "".join(map(self.shown.__getitem__, found.tokens(len(self.bytes_a), len(self.bytes_b)).tolist()))
        self._keep(key, told[:-1], (len(found.a), len(found.b), len(found.ends), int(found.links.sum())), *found.pairs())

    def _together(self, words: list[str]) -> bool:
        """Align many words as one text; False if that doesn't give each of them."""
        found = self.align(" ".join(words))
        if found is None or (found.links > HEAVY).any():
            return False
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        place = np.searchsorted(found.ends, ends)
        if not (found.ends[place] == ends).all():
            return False
        first = np.concatenate([[0], place + 1])  # groups of each word
        cut = lambda n: np.concatenate([[0], np.cumsum(n)])[first]
        at_a, at_b, at_links = cut(found.n_a), cut(found.n_b), cut(found.links)
        pieces = list(map(self.shown.__getitem__, found.tokens(len(self.bytes_a), len(self.bytes_b)).tolist()))
        at = (at_a + at_b).tolist()
        numbers = np.stack([np.diff(at_a), np.diff(at_b), np.diff(first), np.diff(at_links)], 1)
        base = len(self.told)
        self.known.update(zip(words, range(base, base + len(words)), strict=True))
        self.told += ["".join(pieces[i:j])[:-1] for i, j in zip(at, at[1:], strict=False)]
        self.size += sum(map(len, self.told[base:])) + int(at_links[-1])
        self.numbers.frombytes(numbers.astype(np.int64).tobytes())
        codes, often = found.pairs()
        self.start.frombytes((len(self.codes) + at_links[1:]).astype(np.int64).tobytes())
        self.codes.frombytes(codes.tobytes())
        self.often.frombytes(often.tobytes())
        return True

    def _learn(self, words: set[str]) -> None:
        some = []
        for word in words:
            if not word or not (word[-1].isalnum() or ord(word[-1]) in _SIGNS):
                self.known[word] = -1
            elif len(word) > LONGEST:
                self._alone(word, word)
            else:
                some.append(word)
        for i in range(0, len(some), JOINED):
            part = some[i : i + JOINED]
            if not self._together(part):
                for word in part:
                    self._alone(word, word)

    def _merged(self, words: list[str]) -> list:
        """Keys of a text's words, with those that can't be cut off joined to the next."""
        out, held = [], None
        for word in words:
            key = word if held is None else f"{held} {word}"
            if self.known[word] < 0:
                held = key
                continue
            out.append(key)
            if key not in self.known:
                self._alone(key, key)
            held = None
        if held is not None:
            last = held if held else f"{out.pop()} "  # a lone space at the end goes with the word before
            out.append((last,))
            if (last,) not in self.known:
                self._alone((last,), last)
        return out

    def rows(self, texts: list[str | None]):
        """Of texts: numbers (tokens of A, of B, groups, links), groups as text (None: no tokens),
        and of all links their pair, number and text."""
        if len(self.known) > WORDS or self.size > MEMORY:
            self._forget()
        split = [t.split(" ") if t and self.cuts else [] for t in texts]
        self._learn(set().union(*split) - self.known.keys() - {None})
        whole = [[(t,)] if t and not self.cuts else [] for t in texts]
        keys = []
        for words, all_ in zip(split, whole, strict=True):
            found = list(map(self.known.__getitem__, words))
            if all_ and all_[0] not in self.known:
                self._alone(all_[0], all_[0][0])
            keys.append([self.known[k] for k in (self._merged(words) if -1 in found else all_)] if -1 in found or all_ else found)
        many = np.array([len(k) for k in keys])
        entries = np.fromiter((e for k in keys for e in k), np.int64, int(many.sum()))
        told = [None if not k or None in (some := [self.told[e] for e in k]) else ";".join(some) for k in keys]
        good = np.array([t is not None for t in told], bool)
        text = np.repeat(np.arange(len(texts)), many)
        entries, text = entries[good[text]], text[good[text]]
        numbers = np.zeros((len(texts), 4), np.int64)
        np.add.at(numbers, text, np.frombuffer(self.numbers, np.int64).reshape(-1, 4)[entries])
        start = np.frombuffer(self.start, np.int64)
        n = start[entries + 1] - start[entries]
        at = np.repeat(start[entries] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        codes, often = np.frombuffer(self.codes, np.uint64)[at], np.frombuffer(self.often, np.int64)[at]
        return numbers, told, codes, often, np.repeat(text, n)


@functools.lru_cache(4)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


# --- the index ---


def firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


def bitmaps(codes: np.ndarray, often: np.ndarray, doc: np.ndarray):
    """(pair, plane, docs, bits) of a chunk's links: plane -1 is the bitmap of a pair's documents,
    plane k has those whose further links have bit k. Bits are 16-bit numbers of documents
    up to SPARSE of them, else a bit a document; docs counts those of plane -1."""
    key = (codes << np.uint64(CHUNK_BITS)) | doc.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key, often = key[order], often[order]
    first = firsts(key)
    key, more = key[first], np.add.reduceat(often, first) - 1 if len(first) else often
    for plane in range(-1, int(more.max(initial=0)).bit_length()):
        some = key if plane < 0 else key[(more >> plane) & 1 == 1]
        pair, docs = some >> np.uint64(CHUNK_BITS), (some & np.uint64(CHUNK - 1)).astype("<u2")
        start = firsts(pair)
        size = np.diff(start, append=len(pair))
        few = size <= SPARSE
        kept = docs[np.repeat(few, size)]
        offsets = np.concatenate([[0], 2 * np.cumsum(size[few])]).astype(np.int32)
        sparse = pa.Array.from_buffers(pa.binary(), int(few.sum()), [None, pa.py_buffer(offsets), pa.py_buffer(kept.tobytes())])
        dense = np.zeros((int((~few).sum()), CHUNK), bool)
        dense[np.repeat(np.arange(len(dense)), size[~few]), docs[np.repeat(~few, size)]] = True
        packed = [row.tobytes() for row in np.packbits(dense, axis=1, bitorder="little")]
        for which, bits in ((few, sparse), (~few, pa.array(packed, pa.binary()))):
            count = size[which] if plane < 0 else np.zeros(int(which.sum()), np.int64)
            yield pair[start[which]].view(np.int64), plane, count, bits


def members(bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The documents of bitmaps, and of which bitmap each is."""
    cells = bits.to_pylist()
    size = np.array([len(c) for c in cells], np.int64)
    few = np.flatnonzero(size <= 2 * SPARSE)
    docs = [np.frombuffer(b"".join(cells[i] for i in few.tolist()), "<u2").astype(np.int64)]
    rows = [np.repeat(few, size[few] // 2)]
    many = np.flatnonzero(size > 2 * SPARSE)
    if len(many):
        held = np.frombuffer(b"".join(cells[i] for i in many.tolist()), np.uint8).reshape(len(many), -1)
        row, doc = np.nonzero(np.unpackbits(held, axis=1, bitorder="little"))
        docs.append(doc)
        rows.append(many[row])
    return np.concatenate(docs), np.concatenate(rows)


def indexed(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents (pair null: doc, id, n_a, n_b, n_groups, n_links, groups_sha256) and postings
    (pair, chunk, plane, docs, bits) in one table."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(list(rows.select("id").schema.fields))
    for name in ("doc", "n_a", "n_b", "n_groups", "n_links"):
        schema = schema.add(name, "long")
    schema = schema.add("groups_sha256", "string").add("pair", "long").add("chunk", "long").add("plane", "integer").add("docs", "long").add("bits", "binary")
    names = schema.names

    def empty(kind: pa.DataType, n: int) -> dict:
        return {c: pa.nulls(n, kind if c == "id" else {"groups_sha256": pa.string(), "plane": pa.int32(), "bits": pa.binary()}.get(c, pa.int64())) for c in names}

    def each(batches):
        from pyspark import TaskContext

        make, chunk = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        held, count, links, kind = [], 0, 0, pa.int64()

        def postings():
            nonlocal held, count, links, chunk
            if held:
                for pair, plane, n, bits in bitmaps(*(np.concatenate(x) for x in zip(*held, strict=True))):
                    k = len(pair)
                    cells = {"pair": pa.array(pair), "chunk": pa.array(np.full(k, chunk)), "plane": pa.array(np.full(k, plane, np.int32)), "docs": pa.array(n), "bits": bits}
                    yield pa.RecordBatch.from_pydict(empty(kind, k) | cells)
            held, count, links, chunk = [], 0, 0, chunk + 1

        for batch in batches:
            kind, texts, at = batch.schema.field(0).type, batch.column(1).to_pylist(), 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and stop - at < CHUNK - count and size < CHARS:
                    size += len(texts[stop] or "")
                    stop += 1
                numbers, told, codes, often, doc = make.rows(texts[at:stop])
                n = stop - at
                digest = ["" if t is None else hashlib.sha256(t.encode()).hexdigest() for t in told]
                cells = {"id": batch.column(0).slice(at, n), "doc": pa.array((chunk << CHUNK_BITS) + count + np.arange(n)), "groups_sha256": pa.array(digest)}
                cells |= {c: pa.array(numbers[:, i]) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
                yield pa.RecordBatch.from_pydict(empty(kind, n) | cells)
                held.append((codes, often, doc + count))
                at, count, links = stop, count + n, links + len(codes)
                if count >= CHUNK or links >= LINKS:
                    yield from postings()
        yield from postings()

    return written(rows.mapInArrow(each, schema), "alignment")


def pair_counts(postings: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents each pair is linked, and whether no other pair of its
    token of A is in more."""
    counts = written(postings.where("plane = -1").groupBy("pair").agg(F.sum("docs").alias("n")), "alignment-pairs")
    a = F.shiftright("pair", ID_BITS)
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    return counts.join(top, a == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def returned(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc, n_best, count_sum): the scores of documents from the postings of their pairs."""
    rows = postings.select("pair", "chunk", "plane", "bits")
    if counts.count() <= MOST_PAIRS:
        met = rows.join(F.broadcast(counts), "pair")
    else:
        met = join_skewed(rows, counts, "pair", "inner")

    def out(chunk: int, sums: np.ndarray) -> pa.RecordBatch:
        there = np.flatnonzero(sums[1])
        return pa.RecordBatch.from_arrays([pa.array((chunk << CHUNK_BITS) + there), *[pa.array(s[there]) for s in sums]], names=["doc", "n_best", "count_sum"])

    def add(batches):
        now, sums = None, np.zeros((2, CHUNK), np.int64)
        for batch in batches:
            chunks, planes, n, best = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("chunk", "plane", "n", "best"))
            weight = np.int64(1) << np.maximum(planes, 0)
            cuts = np.flatnonzero(np.diff(chunks)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunks)], strict=True):
                if now is not None and now != chunks[a]:
                    yield out(now, sums)
                    sums = np.zeros((2, CHUNK), np.int64)
                now = int(chunks[a])
                doc, row = members(batch.column("bits").slice(a, b - a))
                np.add.at(sums[0], doc, (weight * best)[a:b][row])
                np.add.at(sums[1], doc, (weight * n)[a:b][row])
        if now is not None:
            yield out(now, sums)

    dealt = met.select("chunk", "plane", "n", "best", "bits").repartition("chunk").sortWithinPartitions("chunk")
    return dealt.mapInArrow(add, "doc long, n_best long, count_sum long")


def report(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, n_a, n_b, n_groups, n_links, n_best (links whose pair is in as
    many documents as any of its token of A), count_sum (documents of their pairs, over
    all links), groups_sha256 (of `a1,a2|b1;a3|b2,b3`)."""
    spark = docs.sparkSession
    with scratch(spark):
        table = indexed(docs, path_a, path_b, id_col, text_col)
        postings = table.where("pair is not null")
        scores = returned(postings, written(pair_counts(postings), "alignment-counts"))
        told = table.where("pair is null").select("doc", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        out = told.join(scores, "doc", "left").select(
            F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
        )
        return written(out, "aligned", keep=True)

"""Token-id files: documents as the ids of a given tokenizer, entropy-coded with a
static range asymmetric numeral system (rANS).

`encode` writes a folder: `table` (symbol, frequency: one table for all blocks, from
the counts over all documents) and `blocks` (a row a block). A block holds whole
consecutive documents in ascending order of id, BLOCK ids or more, and is decoded alone.

A block's bytes, little-endian: "rANS" | version u32 | lanes u32 | checkpoint interval
u32 | ids u64 | words u64 | crc32 of the ids as u32 | checkpoints u32 | the lanes'
states u64 at the start | for each checkpoint its place in the words u64 and the states
u64 | words u32. Id i is in lane i mod lanes, at step i div lanes; at every multiple of
the interval of steps there is a checkpoint, from which decoding can begin.

Defined results: a null text is the empty one: its end id alone; a very long text is
tokenised whole (in parts that are cut between words, where the tokenizer never joins
anything) and its ids stay in one block, which then is longer; null ids come first; rows
of equal ids stand in the order of a hash of their token ids, equal ones one after the
other, each written; an empty table makes empty files; other columns are never read.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctuality.llm.shared import discard, new_path, tasks, written

SCALE = 20
LANES = 4096
INTERVAL = 128
BLOCK = 1 << 20
END_ID = 2
#: Pieces of a generation (there are two) that a Python worker remembers, and characters
#: that are tokenised at once, at most, but for a single longer text.
PIECES, CHARS = 600_000, 1_000_000

_HEAD = struct.Struct("<4sIIIQQII")
_LOW = np.uint64(1 << 31)
_S, _W = np.uint64(SCALE), np.uint64(32)
# Kinds of characters; white space first.
_BLANK, _SPACE, _LETTER, _NUMBER, _OTHER, _STOP, _UNKNOWN = range(7)
# The contractions of the byte-level pre-tokenizer: 's 't 'm 'd, 're 've 'll.
_SHORT = [ord(c) for c in "stmd"]
_LONG = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
_GAP = re.compile(r"(?<=\w) (?=\w)")
_WEIGHTS = np.random.default_rng(10).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --- the coder ---


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE, with 1 at least where there was any."""
    total, size = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), np.uint64)
    out = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * size // total), 0).astype(np.int64)
    if np.count_nonzero(out) > size // 2:
        raise ValueError("too many symbols for the table")
    order = np.lexsort((np.arange(len(out)), -out))
    over = int(out.sum()) - size
    for i in itertools.cycle(order):  # the commonest give or take what rounding left
        if not over:
            break
        move = min(over, int(out[i]) - 1, max(1, int(out[i]) // 8)) if over > 0 else over
        out[i] -= move
        over -= move
    return out.astype(np.uint64)


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq
        self.first = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, interval: int = INTERVAL) -> bytes:
    n = len(ids)
    steps = -(-n // lanes)
    freq, first = table.freq[ids], table.first[ids]
    if n and not freq.all():
        raise ValueError("an id that is not in the table")
    most = freq << np.uint64(63 - SCALE)
    state = np.full(lanes, _LOW, np.uint64)
    words, marks, count = [], [], 0
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x, f = state[: b - a], freq[a:b]
        big = x >= most[a:b]
        if big.any():
            out = x[big]
            words.append(out.astype(np.uint32))
            count += len(out)
            x = np.where(big, x >> _W, x)
        q = x // f
        state[: b - a] = (q << _S) + (x - q * f) + first[a:b]
        if step and step % interval == 0:
            marks.append((count, state.copy()))
    marks = [(count - c, s) for c, s in reversed(marks)]  # words that come before, read forward
    body = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    head = _HEAD.pack(b"rANS", 1, lanes, interval, n, len(body), zlib.crc32(ids.astype("<u4").tobytes()), len(marks))
    return b"".join([head, state.tobytes(), *(struct.pack("<Q", c) + s.tobytes() for c, s in marks), body.tobytes()])


def decode_block(data: bytes, table: Table, checkpoint: int = 0, steps: int | None = None) -> np.ndarray:
    """The ids of a block, or those from a checkpoint (0: the start) on for so many
    steps. A whole block is held against its checksum."""
    magic, version, lanes, interval, n, size, crc, marks = _HEAD.unpack_from(data)
    if magic != b"rANS" or version != 1:
        raise ValueError("not a block")
    at = _HEAD.size
    words = np.frombuffer(data, np.uint32, size, at + 8 * lanes + marks * (8 + 8 * lanes))
    place = 0
    if checkpoint:
        at += 8 * lanes + (checkpoint - 1) * (8 + 8 * lanes)
        (place,) = struct.unpack_from("<Q", data, at)
        at += 8
    state = np.frombuffer(data, np.uint64, lanes, at).copy()
    begin = checkpoint * interval
    end = -(-n // lanes) if steps is None else min(-(-n // lanes), begin + steps)
    out = np.empty(max(0, min(n, end * lanes) - begin * lanes), np.uint32)
    mask = np.uint64((1 << SCALE) - 1)
    for step in range(begin, end):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x = state[: b - a]
        slot = x & mask
        ids = table.symbol[slot]
        out[a - begin * lanes : b - begin * lanes] = ids
        x = table.freq[ids] * (x >> _S) + slot - table.first[ids]
        small = np.flatnonzero(x < _LOW)
        if len(small):
            x[small] = (x[small] << _W) | words[place : place + len(small)]
            place += len(small)
        state[: b - a] = x
    if not checkpoint and steps is None and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's ids don't have its checksum")
    return out


# --- the tokenizer ---


class _Memory:
    """Pieces of text by a hash: their ids, and their characters, which tell whether a
    piece of the same hash is the same piece. A table of slots with linear probing,
    looked up for many hashes at once."""

    def __init__(self):
        self.ids, self.chars, self.keys = _Runs("I"), _Runs("I"), array("Q")
        self._grow(20)

    def _grow(self, bits: int) -> None:
        self.shift, self.slots = np.uint64(64 - bits), np.full(1 << bits, -1, np.int32)
        self._place(np.frombuffer(self.keys, np.uint64), 0)

    def _place(self, keys: np.ndarray, base: int) -> None:
        todo, at = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = base + todo[free]
            lost = self.slots[at] != base + todo
            todo, at = todo[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def add(self, keys: np.ndarray, ids: np.ndarray, n: np.ndarray, chars: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Add different pieces that aren't there; their entries."""
        base = len(self.keys)
        self.keys.frombytes(keys.tobytes())
        self.ids.add(ids, n)
        self.chars.add(chars, width)
        if 2 * len(self.keys) > len(self.slots):
            self._grow((4 * len(self.keys)).bit_length())
        else:
            self._place(keys, base)
        return np.arange(base, base + len(keys))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entries of hashes, -1 for what isn't known."""
        keys, out = np.frombuffer(self.keys, np.uint64), np.full(len(hashes), -1, np.int64)
        todo, at = np.arange(len(hashes)), (hashes >> self.shift).astype(np.int64)
        while len(todo):
            entry = self.slots[at]
            there = entry >= 0
            todo, at, entry = todo[there], at[there], entry[there]
            same = keys[entry] == hashes[todo]
            out[todo[same]] = entry[same]
            todo, at = todo[~same], (at[~same] + 1) & (len(self.slots) - 1)
        return out


class _Runs:
    """Runs of numbers in one growing array."""

    def __init__(self, kind: str):
        self.flat, self.start, self.count = array(kind), array("q"), array("q")

    def add(self, flat: np.ndarray, count: np.ndarray) -> None:
        self.start.frombytes((len(self.flat) + np.cumsum(count) - count).astype(np.int64).tobytes())
        self.count.frombytes(count.astype(np.int64).tobytes())
        self.flat.frombytes(flat.astype(np.uint32).tobytes())

    def of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of the entries, one after the other, and their lengths."""
        start, count, flat = (np.frombuffer(x, x.typecode) for x in (self.start, self.count, self.flat))
        n = count[entries]
        ends = np.cumsum(n)
        return flat[np.repeat(start[entries] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n


class Encoder:
    """Ids of texts by the library. Texts are cut into the pieces that the library's
    byte-level pre-tokenizer makes, for many texts at once, and each different piece is
    encoded by the library once while it is remembered (for two generations, so that
    common ones outlive the limit). Which characters are letters, numbers or spaces is
    asked of the library, as releases of Unicode differ. Texts that hold the sign of a
    special token, and all texts of tokenizers of other kinds, go to the library whole."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library, self.end_id = Tokenizer.from_file(path), end_id
        vocabulary = self.library.get_vocab()
        #: Ids that begin with a space: where pieces that are encoded together begin.
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for word, i in vocabulary.items() if word.startswith("\u0120")]] = True
        cutter = self.library.pre_tokenizer
        self.cuts = self.library.normalizer is None and isinstance(cutter, ByteLevel) and not cutter.add_prefix_space and cutter.use_regex
        self.kind = np.full(0x110000, _UNKNOWN, np.uint8)
        self.kind[[0, 32]] = _STOP, _BLANK
        self.old, self.young = _Memory(), self._fresh()

    def _fresh(self) -> _Memory:
        """A memory that knows what ends a text."""
        memory, stop = _Memory(), np.zeros(1, np.uint64)
        memory.add(self._hashes(stop, stop, stop + 1), np.array([self.end_id]), np.array([1]), stop, np.array([1]))
        return memory

    @staticmethod
    def _hashes(codes: np.ndarray, starts: np.ndarray, width: np.ndarray) -> np.ndarray:
        place = np.arange(len(codes)) - np.repeat(starts.astype(np.int64), width.astype(np.int64))
        return np.add.reduceat(codes * _WEIGHTS[place & 63], starts.astype(np.int64)) ^ (width.astype(np.uint64) * _WEIGHTS[0])

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids, one text after the other, and how many each has."""
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(n.sum())), n

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces. Many words that begin with a space make one text for the
        library; each begins at an id that begins with a space."""
        joined = np.array([len(p) > 1 and p[0] == " " and p[1:].isalpha() for p in pieces], bool)
        some = [p for p, j in zip(pieces, joined.tolist(), strict=True) if j]
        ids, _ = self._library(["".join(some[i : i + 256]) for i in range(0, len(some), 256)])
        at = np.flatnonzero(self.begins[ids])
        if len(at) != len(some):
            return self._library(pieces)
        rest, n_rest = self._library([p for p, j in zip(pieces, joined.tolist(), strict=True) if not j])
        n = np.zeros(len(pieces), np.int64)
        n[joined], n[~joined] = np.diff(np.append(at, len(ids))), n_rest
        out, own = np.zeros(int(n.sum()), np.uint32), np.repeat(joined, n)
        out[own], out[~own] = ids, rest
        return out, n

    def _classify(self, code: int) -> int:
        one = lambda text: len(self.library.pre_tokenizer.pre_tokenize_str(text)) == 1
        c = chr(code)
        return _LETTER if one(f"a{c}a") else _NUMBER if one(f"1{c}1") else _OTHER if one(f"!{c}!") else _SPACE

    def _starts(self, codes: np.ndarray) -> np.ndarray:
        """Where pieces start. A run of letters, of numbers or of other signs takes the
        space before it along; of white space before a sign, the last is apart; a
        contraction is a piece where its apostrophe begins one."""
        kind = self.kind[codes]
        if (kind == _UNKNOWN).any():
            for code in np.unique(codes[kind == _UNKNOWN]).tolist():
                self.kind[code] = self._classify(code)
            kind = self.kind[codes]
        before = np.concatenate([[_STOP], kind[:-1]])
        after = np.concatenate([kind[1:], [_STOP]])
        white = kind <= _SPACE
        start = np.where(white, (before > _SPACE) | ((after > _SPACE) & (after != _STOP)), (kind != before) & (before != _BLANK)) | (kind == _STOP) | (before == _STOP)
        at = np.flatnonzero((codes == 39) & start)
        one, two = codes[np.minimum(at + 1, len(codes) - 1)], codes[np.minimum(at + 2, len(codes) - 1)]
        size = np.where(np.isin(one, _SHORT), 2, 0)
        for a, b in _LONG:
            size[(one == a) & (two == b)] = 3
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        start[at + size] = True
        return np.flatnonzero(start)

    def _find(self, text: str, codes: np.ndarray, starts: np.ndarray) -> np.ndarray | None:
        """The memory's entries of the pieces; None if two pieces share a hash."""
        width = np.diff(starts, append=len(codes))
        which, different = pd.factorize(self._hashes(codes, starts, width))
        first = np.empty(len(different), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        entries = self.young.find(different)
        missing = np.flatnonzero(entries < 0)
        if len(missing) and len(self.old.keys):
            held = self.old.find(different[missing])
            again, held = missing[held >= 0], held[held >= 0]
            entries[again] = self.young.add(different[again], *self.old.ids.of(held), *self.old.chars.of(held))
            missing = np.flatnonzero(entries < 0)
        if len(missing):
            a, n = starts[first[missing]], width[first[missing]]
            pieces = [text[i:j] for i, j in zip(a.tolist(), (a + n).tolist(), strict=True)]
            chars = codes[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            entries[missing] = self.young.add(different[missing], *self._encode(pieces), chars, n)
        found = entries[which]
        chars, n = self.young.chars.of(found)
        return found if (n == width).all() and (chars == codes).all() else None

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids, each text's with the end id, one text after the other, and
        how many each has."""
        if len(self.young.keys) > PIECES:
            self.old, self.young = self.young, self._fresh()
        texts = [t or "" for t in texts]
        whole = [i for i, t in enumerate(texts) if not self.cuts or "<|" in t or "\0" in t]
        cut = list(texts)
        for i in whole:
            cut[i] = ""
        text = "\0".join([*cut, ""])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        starts = self._starts(codes)
        entries = self._find(text, codes, starts)
        if entries is None:
            ids, n = self._library(texts)
            return np.insert(ids, np.cumsum(n), self.end_id), n + 1
        ids, n = self.young.ids.of(entries)
        counts = np.diff(np.cumsum(n)[codes[starts] == 0], prepend=0)
        if not whole:
            return ids, counts
        found, n = self._library([texts[i] for i in whole])
        at = np.cumsum(counts) - counts  # a text that goes whole has its end id alone so far
        ids = np.insert(ids, np.repeat(at[whole], n), found)
        counts[whole] += n
        return ids, counts

    def slices(self, texts: list[str | None]):
        """Calls for texts one after the other, of CHARS characters or so at once. A text
        that is longer is taken in parts, cut before spaces between words."""
        some, held = [], 0
        for text in texts:
            if text and len(text) > 2 * CHARS and self.cuts and "<|" not in text:
                if some:
                    yield self(some)
                    some, held = [], 0
                cuts = [0]
                while place := _GAP.search(text, cuts[-1] + CHARS):
                    cuts.append(place.start())
                parts = [self([text[a:b]])[0][:-1] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]
                ids = np.concatenate([*parts, np.array([self.end_id], np.uint32)])
                yield ids, np.array([len(ids)])
                continue
            some.append(text)
            held += len(text or "")
            if held > CHARS:
                yield self(some)
                some, held = [], 0
        if some:
            yield self(some)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


# --- the jobs ---


def tokenised(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(id, ids, wide, counts): each text's ids and end_id, as bytes: two an id if the
    text's ids allow it, else four (wide). The last row of a task has no text: its counts
    say how often each id occurs in the task's rows (two arrays of 64-bit numbers)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", "ids", "wide", "counts"]

    def each(batches):
        make, total, kind = encoder(path, end_id), np.zeros(1 << 16, np.int64), None
        for batch in batches:
            at, kind = 0, batch.schema.field(0).type
            for ids, n in make.slices(batch.column(1).to_pylist()):
                one = np.bincount(ids, minlength=len(total))
                total = one + (total if len(one) == len(total) else np.pad(total, (0, len(one) - len(total))))
                wide = np.maximum.reduceat(ids, np.cumsum(n) - n) > 0xFFFF
                data = [x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(np.split(ids, np.cumsum(n)[:-1]), wide.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.array(data, pa.binary()), pa.array(wide), pa.nulls(len(n), pa.binary())], names=names)
                at += len(n)
        if kind is not None:
            kept = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.nulls(1, pa.bool_()), pa.array([np.concatenate([kept, total[kept]]).tobytes()], pa.binary())], names=names)

    return rows.mapInArrow(each, T.StructType(list(rows.select("id").schema.fields)).add("ids", "binary").add("wide", "boolean").add("counts", "binary"))


def _numbers(data, wide: bool) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), "<u4" if wide else "<u2").astype(np.uint32)


def counted(rows: DataFrame) -> DataFrame:
    """(symbol, n): how often each id occurs, from the counts of tokenised's tasks."""

    def each(batches):
        for batch in batches:
            for data in batch.column(0):
                symbols, n = np.frombuffer(data.as_buffer(), np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(symbols), pa.array(n)], names=["symbol", "n"])

    return rows.select("counts").where("counts is not null").mapInArrow(each, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def encode(docs: DataFrame, out: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block: int = BLOCK) -> None:
    """Write the token files of docs to the folder out."""
    spark = docs.sparkSession
    rows = written(tokenised(docs, path, id_col, text_col, end_id), "token-ids")
    counts = {r["symbol"]: r["n"] for r in counted(rows).collect()}  # as many rows as the vocabulary has, at most
    freq = frequencies(np.array([counts.get(i, 0) for i in range(max(counts, default=-1) + 1)], np.int64))
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq) if f], "symbol long, frequency long").coalesce(1).write.parquet(f"{out}/table")
    held = spark.sparkContext.broadcast(freq)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n", T.LongType()), T.StructField("doc_ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType())])

    def each(batches):
        from pyspark import TaskContext

        part, number, first = TaskContext.get().partitionId(), 0, 0
        table = Table(held.value)
        docs_, lengths, ids, size = [], [], [], 0
        kind = None

        def close():
            data = encode_block(np.concatenate(ids), table)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), pa.array([docs_], pa.list_(kind)), pa.array([lengths], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                names=schema.names,
            )

        for batch in batches:
            kind = batch.schema.field(0).type
            for one, data, wide in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                x = _numbers(data, wide)
                docs_.append(one)
                lengths.append(len(x))
                ids.append(x)
                size += len(x)
                if size >= block:
                    yield close()
                    number, first = number + 1, first + size
                    docs_, lengths, ids, size = [], [], [], 0
        if docs_:
            yield close()

    # a hash beside the id, so that rows of one id don't all meet in one range
    texts = rows.where("counts is null").select("id", "ids", "wide", F.xxhash64("ids").alias("hash"), F.monotonically_increasing_id().alias("row"))
    ranged = texts.repartitionByRange(tasks(spark), "id", "hash", "row").sortWithinPartitions("id", "hash", "row").select("id", "ids", "wide")
    ranged.mapInArrow(each, schema).write.option("compression", "uncompressed").parquet(f"{out}/blocks")
    discard(spark, rows)


def decode(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, ids): every document's ids, read back block by block; start: ids of
    all documents before it."""
    return _decoded(spark, folder, id_col, "ids", T.ArrayType(T.LongType()), lambda parts: pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))


def digest(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32): as decode, with the crc32 of the ids as
    little-endian unsigned 32-bit integers in place of the ids."""
    return _decoded(spark, folder, id_col, "ids_crc32", T.LongType(), lambda parts: pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()))


def _decoded(spark: SparkSession, folder: str, id_col: str, name: str, kind: T.DataType, make) -> DataFrame:
    symbols = {r["symbol"]: r["frequency"] for r in spark.read.parquet(f"{folder}/table").collect()}
    held = spark.sparkContext.broadcast(np.array([symbols.get(i, 0) for i in range(max(symbols, default=-1) + 1)], np.uint64))
    blocks = spark.read.parquet(f"{folder}/blocks")
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row a range
    done, bases = 0, {}
    for part, n in totals:
        bases[part], done = done, done + n
    base = spark.sparkContext.broadcast(bases)
    out = T.StructType([T.StructField(id_col, blocks.schema["doc_ids"].dataType.elementType), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField(name, kind)])

    def each(batches):
        table = Table(held.value)
        for batch in batches:
            for i in range(batch.num_rows):
                part, first, docs_, lengths, data = (batch.column(c)[i] for c in ("part", "first", "doc_ids", "lengths", "data"))
                ids = decode_block(data.as_py(), table)
                n = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(n)
                start = base.value[part.as_py()] + first.as_py() + ends - n
                yield pa.RecordBatch.from_arrays([docs_.values, pa.array(start), pa.array(n), make(np.split(ids, ends[:-1]))], names=out.names)

    return blocks.select("part", "first", "doc_ids", "lengths", "data").mapInArrow(each, out)


def report(spark: SparkSession, docs: DataFrame, path: str, out: str | None = None, **options) -> DataFrame:
    """Encode docs to the folder out (by default a new one) and read it back."""
    out = out or new_path(spark, "token-files")
    encode(docs, out, path, **options)
    return digest(spark, out, options.get("id_col", "doc_id"))

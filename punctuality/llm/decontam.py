"""Benchmark decontamination: windows of a benchmark's words are looked up in every
document by a broadcast hash set, hits are verified word by word, and hit spans or
whole documents go.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with
A-Z lowered. A window is WINDOW consecutive words of an item; an item with fewer
words (but not none) is one window. The items are cut into segments of up to SEGMENT
words that overlap by a window less a word, repeats dropped, and broadcast in parts of
a bounded size, one at a time; more items make more passes, never a larger broadcast. As long as there
is one part, documents are read where they stand; for more passes each is written once,
with a row number, by which what the passes found is put together.

Defined results: a null or wordless text has no words and no hits; a null or wordless
item is never found; a null item_id counts as no item but its windows still hit;
repeated items count once by their id, and one window of several items counts for each;
very long texts and items are searched whole; repeated documents get a row each; an
empty benchmark hits nothing; other columns of the documents are kept by `decontaminate`,
whatever they are called.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctuality.llm.shared import ascii_lower, written

WINDOW = 10
#: Characters of benchmark text in one broadcast (some 100 MB as a hash set), and words
#: of a segment of an item.
PART_CHARS, SEGMENT = 6_000_000, 2000

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORDS.findall(ascii_lower(text)) if text else []


class Windows:
    """The hash set of a part of the benchmark: word numbers, and for each window
    length the windows' words in the order of their hashes, with the items of each."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.number: dict[str, int] = {}
        self.items = sorted({i for i, _ in items if i is not None})
        at = {item: i for i, item in enumerate(self.items)}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(text)], np.uint32)
            n = min(window, len(ids))
            if n:
                found.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(ids, n), at.get(item, -1)))
        self.by_length = {}
        for n, of in sorted(found.items()):
            rows = np.concatenate([x for x, _ in of])
            item = np.repeat([i for _, i in of], [len(x) for x, _ in of])
            hashes = _hash(rows.T)
            order = np.lexsort((item, hashes))
            self.by_length[n] = (hashes[order], rows[order], item[order])

    def hits(self, tokens: list[str]) -> tuple[np.ndarray, set]:
        """Which words are hit (a mask), and the items found."""
        ids = np.fromiter(map(self.number.get, tokens, itertools.repeat(0)), np.uint32, len(tokens))
        hit, items = np.zeros(len(tokens) + 1, np.int32), set()
        gap = np.concatenate([[0], np.cumsum(ids == 0)])
        for n, (hashes, rows, item) in self.by_length.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(gap[n:] == gap[:-n])  # all words of the window are known
            if not len(at):
                continue
            h = _hash([ids[at + i] for i in range(n)])
            first, last = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
            at, first, many = at[last > first], first[last > first], (last - first)[last > first]
            # every window of that hash, verified word by word
            which = np.repeat(np.arange(len(at)), many)
            place = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(len(which))
            same = (rows[place] == ids[at[which][:, None] + np.arange(n)]).all(1)
            items.update(np.unique(item[place[same]]).tolist())
            begin = at[np.unique(which[same])]
            hit[begin] += 1
            hit[begin + n] -= 1
        return np.cumsum(hit[:-1]) > 0, {self.items[i] for i in items if i >= 0}


def _hash(columns) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * _MULT
        h ^= h >> np.uint64(29)
    return h


def _spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _parts(items: DataFrame, id_col: str, text_col: str, window: int, limit: int) -> tuple[DataFrame, int]:
    """The items' segments, each once, with the number of the part of about `limit`
    characters that each is in, and the number of parts."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    def cut(batches):
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = words(text)
                some = [" ".join(found[i : i + SEGMENT + window - 1]) for i in range(0, max(1, len(found) - window + 1), SEGMENT)]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(some), pa.string()), pa.array(some, pa.string())], names=["item", "text"])

    segments = written(rows.mapInArrow(cut, "item string, text string").distinct(), "leak-segments")
    total = segments.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 if total <= limit else -(-2 * int(total) // limit)  # half as much on average: a hash doesn't deal evenly
    return segments.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n))), n


def _held(parts: DataFrame, part: int, window: int):
    """The broadcast of a part."""
    found = parts.where(F.col("part") == part).select("item", "text").collect()  # bounded: see _parts
    return parts.sparkSession.sparkContext.broadcast(Windows([(r["item"], r["text"]) for r in found], window))


def hits(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """(id, n_words, spans of hit words, items), one row a document; ids as text in
    ascending order."""
    parts, n = _parts(items, item_col, item_text, window, part_chars)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("_row"))
    rows = rows if n == 1 else written(rows, "leak-docs")
    found = None
    for part in range(n):
        held = _held(parts, part, window)
        one = rows.mapInArrow(_search(held), _schema(rows.select("id").schema))
        if n > 1:  # one part after the other, so that one broadcast is there at a time
            one = written(one, "leak-found")
            held.destroy()
        found = one if found is None else found.unionByName(one)
    if n == 1:
        return found.select("id", "n_words", "spans", F.array_sort("items").alias("items"))
    return _merged(found)


def _schema(kept):
    return T.StructType(list(kept.fields)).add("n_words", "long").add("spans", T.ArrayType(T.StructType().add("at", "long").add("to", "long"))).add("items", T.ArrayType(T.StringType())).add("_row", "long")


_SPANS = pa.list_(pa.struct([("at", pa.int64()), ("to", pa.int64())]))


def _search(held):
    def each(batches):
        windows = held.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                n_words, spans, items = [], [], []
                for text in part.column(1).to_pylist():
                    tokens = words(text)
                    mask, got = windows.hits(tokens)
                    n_words.append(len(tokens))
                    spans.append([{"at": a, "to": b} for a, b in _spans(mask)])
                    items.append(sorted(got))
                cells = [part.column(0), pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string())), part.column(2)]
                yield pa.RecordBatch.from_arrays(cells, names=["id", "n_words", "spans", "items", "_row"])

    return each


def _merged(found: DataFrame) -> DataFrame:
    """One row a document from one row a document and part (by its place in the
    input): overlapping and adjoining spans become one."""
    span = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.expr("cast(array() as array<struct<at:bigint,to:bigint>>)"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["to"] >= x["at"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["at"].alias("at"), F.greatest(F.element_at(done, -1)["to"], x["to"]).alias("to")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return found.groupBy("_row").agg(F.first("id").alias("id"), F.max("n_words").alias("n_words"), span.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).drop("_row")


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: n_words, n_hit (words inside a found window), n_items,
    items_sha256 (of the comma-joined ids in text order) and contaminated."""
    found = hits(docs, items, id_col, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["at"])
    return found.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans", "items",
    )


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    mode: str = "document",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """docs with all their columns: without the documents that hold a window (mode
    "document"), or with the hit words cut out of their texts (mode "span")."""
    if mode not in ("document", "span"):
        raise ValueError(f"mode: document or span, not {mode!r}")
    parts, n = _parts(items, item_col, item_text, window, part_chars)
    at, schema = docs.columns.index(text_col), docs.schema

    def clean(held):
        def each(batches):
            windows = held.value
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    texts, keep = part.column(at).to_pylist(), []
                    for i, text in enumerate(texts):
                        mask, _ = windows.hits(words(text))
                        keep.append(mode == "span" or not mask.any())
                        if mode == "span" and mask.any():
                            texts[i] = _cut(text, mask)
                    if mode == "span":
                        part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                    yield part.filter(pa.array(keep, pa.bool_()))

        return each

    for k in range(n):
        held = _held(parts, k, window)
        docs = docs.mapInArrow(clean(held), schema)
        if k < n - 1:
            docs = written(docs, "clean-docs")
            held.destroy()
    return docs


def _cut(text: str, mask: np.ndarray) -> str:
    places = [m.span() for m in WORDS.finditer(ascii_lower(text))]
    out, done = [], 0
    for a, b in _spans(mask):
        out.append(text[done : places[a][0]])
        done = places[b - 1][1]
    return "".join([*out, text[done:]])


"""Toxicity classifier: a linear model on hashed character n-grams whose features are
scaled by naive Bayes log-count ratios (how much likelier an n-gram is in toxic texts).

Texts are lower-cased, white space and ASCII signs become one space, and n-grams are
taken over the characters, word ends included. A feature's value is its share of the
text times its log-count ratio, so that length does not count.

Defined results: a null or empty text has the bias alone as its score; a very long text
is scored whole, in parts that overlap; a corpus without usable labels of both kinds
gives every text the score 0; a score at the threshold is 1; repeated rows are scored
alike, and of rows that share a labelled id one teaches; an empty table gives no rows;
other columns are never read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctuality.llm.learning import filtered, labelled, scored
from punctuality.llm.shared import written

BITS = 20
ORDERS = (3, 4, 5, 6, 8)
#: Bound of the labelled sample, partitions it is read in, passes over it.
TRAIN_ROWS, TRAIN_PARTS, PASSES = 12000, 12, 6
#: Learning rate, first weight, smoothing of the counts.
RATE, START, SMOOTH = 0.05, 0.05, 1.0
#: Only n-grams in so many sampled texts, and with so large a log-count ratio, count.
LEAST, INFORMATIVE = 3, 1.5
THRESHOLD = 0.5
SCALE = 100.0

_SIGNS = bytes(32 if c < 48 or 57 < c < 97 or 122 < c < 128 else c for c in range(256))


def plain(text: str) -> np.ndarray:
    """A text's characters as n-grams see them."""
    words = text.lower().encode("utf-8", "replace").translate(_SIGNS).split()
    return np.frombuffer((b" " + b" ".join(words) + b" ").decode("utf-8").encode("utf-32-le"), np.uint32) if words else np.zeros(0, np.uint32)


def grams(data: np.ndarray):
    """For each order, the n-grams' slots by their first character."""
    h = np.zeros(len(data), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(data) < n:
            return
        h = h[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :]
        if n in ORDERS:
            x = (h ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            yield n, (x ^ (x >> np.uint32(16))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots (ascending) and the shares of the text's n-grams."""
    data = plain(text)
    found = [slots for _, slots in grams(data)]
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    slots, counts = np.unique(np.concatenate(found), return_counts=True)
    return slots.astype(np.int32), (counts * (SCALE / len(data))).astype(np.float32)


def ratios(seen: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Log-count ratio of each slot, 0 where it tells little. seen[y]: the texts of
    class y that hold the slot; texts[y]: all texts of class y."""
    rate = [(seen[y] + SMOOTH) / (texts[y] + 2 * SMOOTH) for y in (0, 1)]
    ratio = np.log(rate[1] / rate[0]).astype(np.float32)
    return np.where((np.abs(ratio) >= INFORMATIVE) & (seen.sum(0) >= LEAST), ratio, np.float32(0))


def count(samples) -> tuple[np.ndarray, np.ndarray]:
    """seen and texts (see ratios) of pairs (y, text)."""
    seen, texts = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
    for y, text in samples:
        seen[y, features(text)[0]] += 1
        texts[y] += 1
    return seen, texts


def scaled(text: str, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text that have a ratio, and the shares times the ratios."""
    slots, values = features(text)
    kept = ratio[slots] != 0
    return slots[kept], values[kept] * ratio[slots[kept]]


def fit(samples: list[tuple[int, np.ndarray, np.ndarray]], ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """The table of weight times log-count ratio, and the bias: logistic loss, AdaGrad
    steps, both classes counting alike."""
    ys = np.array([y for y, _, _ in samples])
    if not 0 < ys.sum() < len(ys):
        return np.zeros(1 << BITS, np.float32), 35.0 if ys.any() else -35.0  # labels of one kind say that kind
    weight = {1: 0.5 * len(ys) / ys.sum(), 0: 0.5 * len(ys) / (len(ys) - ys.sum())}
    w, square = np.full(1 << BITS, START, np.float32), np.full(1 << BITS, 1e-3, np.float32)
    bias, bias_square = 0.0, 1e-3
    for _ in range(PASSES):
        for y, s, x in samples:
            g = weight[y] * (1 / (1 + np.exp(-np.clip(w[s] @ x + bias, -35, 35))) - y)
            step = g * x
            square[s] += step * step
            w[s] -= RATE * step / np.sqrt(square[s])
            bias_square += g * g
            bias -= 0.5 * g / np.sqrt(bias_square)
    return w * ratio, float(bias)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Table and bias of a bounded sample (at most `rows` documents). Its n-grams are
    counted in TRAIN_PARTS tasks, whose counts are summed; the few features that have
    a ratio are made in as many, and one task fits them."""
    sample = written(labelled(docs, labels, label, id_col, text_col, rows, keep).repartition(TRAIN_PARTS, "id"), "toxic-sample")
    if sample.isEmpty():
        return np.zeros(1 << BITS, np.float32), -35.0

    def pairs(batches):
        for b in batches:
            yield from zip(b.column("y").to_pylist(), (t or "" for t in b.column("text").to_pylist()), strict=True)

    def partial(batches):
        seen, texts = count(pairs(batches))
        yield pa.RecordBatch.from_pydict({"seen": pa.array([seen.tobytes()], pa.binary()), "texts": pa.array([texts.tobytes()], pa.binary())})

    def total(batches):
        seen, texts = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        for b in batches:
            for x, n in zip(b.column(0), b.column(1), strict=True):
                seen += np.frombuffer(x.as_buffer(), np.int32).reshape(2, -1)
                texts += np.frombuffer(n.as_buffer(), np.int64)
        yield pa.RecordBatch.from_pydict({"ratio": pa.array([ratios(seen, texts).tobytes()], pa.binary())})

    counted = sample.mapInArrow(partial, "seen binary, texts binary").repartition(1)
    ratio = np.frombuffer(counted.mapInArrow(total, "ratio binary").collect()[0]["ratio"], np.float32)
    held = sample.sparkSession.sparkContext.broadcast(ratio)

    def sparse(batches):
        for b in batches:
            for one, y, text in zip(*(b.column(c).to_pylist() for c in ("id", "y", "text")), strict=True):
                slots, values = scaled(text or "", held.value)
                yield pa.RecordBatch.from_pydict({"h": pa.array([zlib.crc32(str(one).encode())], pa.int64()), "y": pa.array([y], pa.int32()), "slots": pa.array([slots.tobytes()], pa.binary()), "vals": pa.array([values.tobytes()], pa.binary())})

    def learn(batches):
        samples = [(y, np.frombuffer(s, np.int32), np.frombuffer(v, np.float32)) for b in batches for y, s, v in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
        table, bias = fit(samples, held.value)
        yield pa.RecordBatch.from_pydict({"w": pa.array([table.tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})

    rows_ = sample.mapInArrow(sparse, "h long, y int, slots binary, vals binary").repartition(1)
    model = rows_.sortWithinPartitions("h", "slots").mapInArrow(learn, "w binary, bias double").collect()
    return np.frombuffer(model[0]["w"], np.float32), model[0]["bias"]


def score_texts(texts: list[str], table: np.ndarray, bias: float) -> list[float]:
    out = []
    for data in map(plain, texts):
        total = 0.0
        for at in range(0, len(data), 1 << 18):  # a long text in pieces that overlap
            for n, slots in grams(data[at : at + (1 << 18) + max(ORDERS) - 1]):
                total += float(table[slots[: min(1 << 18, len(data) - at - n + 1)]].sum())
        out.append(1 / (1 + np.exp(-np.clip(total * SCALE / max(1, len(data)) + bias, -35, 35))))
    return [float(x) for x in out]


def scorer(docs: DataFrame, model: tuple[np.ndarray, float]):
    """A function of texts for executors; the table (4 MB) is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return lambda texts: score_texts(texts, *held.value)


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """Each document's id, score (0 to 1) and predicted (1: score >= threshold)."""
    model = train(docs, labels, label, id_col, text_col, keep, rows)
    out = scored(docs, id_col, text_col, scorer(docs, model))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_civil(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that score under the threshold."""
    model = train(docs, labels, label, id_col, text_col, keep, rows)
    return filtered(docs, text_col, scorer(docs, model), lambda x: x < threshold)

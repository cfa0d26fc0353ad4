"""Quality classifier: logistic regression on hashed word n-grams, learned with
follow-the-regularised-leader (FTRL-proximal) updates, scored as sparse dot products.

A token is a run of word characters or of other signs. Features are the hashed 1- to
3-grams of the lower-cased tokens and, beside them, those of the tokens' shapes (letter
case, digits, the sign, and whether the token repeats one of the two before it). A
feature's value is the square root of its share of the text's tokens, so that length
does not count.

Defined results: a null or empty text has the bias alone as its score; a very long text
is scored whole; a corpus without any usable label gives every text the score 0.5; a
score at the threshold is 1; repeated rows are scored alike, and of rows that share a
labelled id one teaches; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctuality.llm.learning import filtered, labelled, scored

BITS = 20
#: Bound of the labelled sample, and passes over it.
TRAIN_ROWS, PASSES = 6000, 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.05
THRESHOLD = 0.7
SCALE = 8.0

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MULT = np.uint32(0x9E3779B1)


def _shape(token: str) -> str:
    if token[0].isalnum() or token[0] == "_":
        case = "X" if token.isupper() and len(token) > 1 else "A" if token[0].isupper() else "d" if token.isdigit() else "x"
        return case + ("+" if len(token) > 12 else "")
    return token[:3]


class _Codes(dict):
    """Token -> its hash and its shape's hash, in one integer; kept small."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        code = zlib.crc32(token.lower().encode("utf-8", "replace")) << 32 | zlib.crc32(_shape(token).encode("utf-8", "replace"))
        self[token] = code
        return code


_codes = _Codes()


def _slots(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint32(salt * 0x85EBCA6B & 0xFFFFFFFF)) * _MULT
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (ascending) and values of one text."""
    tokens = _TOKEN.findall(text)
    if not tokens:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    code = np.fromiter(map(_codes.__getitem__, tokens), np.uint64, len(tokens))
    word, shape = (code >> np.uint64(32)).astype(np.uint32), code.astype(np.uint32)
    again = np.zeros(len(word), np.uint32)
    again[1:] |= word[1:] == word[:-1]
    again[2:] |= (word[2:] == word[:-2]).astype(np.uint32) << np.uint32(1)
    found = [_slots(word, 1), _slots(shape, 2), _slots(again, 3)]
    for salt, of in ((4, shape * np.uint32(4) + again), (6, word)):
        two = of[:-1] * np.uint32(31) + of[1:]
        found += [_slots(two, salt), _slots(two[:-1] * np.uint32(31) + of[2:], salt + 1)]
    slots, counts = np.unique(np.concatenate(found), return_counts=True)
    return slots.astype(np.int32), (np.sqrt(counts / len(word)) * SCALE).astype(np.float32)


def ftrl(samples: list[tuple[int, np.ndarray, np.ndarray]], passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal updates, sample by sample."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        kept = np.abs(z[at]) > L1
        return np.where(kept, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    for _ in range(passes):
        for y, slots, values in samples:
            at, x = np.append(slots, size - 1), np.append(values, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size))
    return w[:-1].astype(np.float32), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Weights and bias. Features are made where the texts are; one task then runs
    the updates over the bounded sample (at most `rows` documents)."""

    def sparse(batches):
        for batch in batches:
            for one, y, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                slots, values = features(text or "")
                yield pa.RecordBatch.from_pydict({"h": pa.array([zlib.crc32(str(one).encode())], pa.int64()), "y": pa.array([y], pa.int32()), "slots": pa.array([slots.tobytes()], pa.binary()), "vals": pa.array([values.tobytes()], pa.binary())})

    def learn(batches):
        samples = [(y, np.frombuffer(s, np.int32), np.frombuffer(v, np.float32)) for b in batches for y, s, v in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
        w, bias = ftrl(samples)
        yield pa.RecordBatch.from_pydict({"w": pa.array([w.tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})

    rows_ = labelled(docs, labels, label, id_col, text_col, rows, keep).mapInArrow(sparse, "h long, y int, slots binary, vals binary")
    model = rows_.repartition(1).sortWithinPartitions("h", "slots").mapInArrow(learn, "w binary, bias double").collect()
    return (np.frombuffer(model[0]["w"], np.float32), model[0]["bias"]) if model else (np.zeros(1 << BITS, np.float32), 0.0)


def scorer(docs: DataFrame, model: tuple[np.ndarray, float]):
    """A function of texts for executors; the weights (4 MB) are broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list[str]) -> list[float]:
        w, bias = held.value
        out = []
        for text in texts:
            slots, values = features(text)
            out.append(float(1 / (1 + np.exp(-np.clip(w[slots] @ values + bias, -35, 35)))))
        return out

    return score


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """Each document's id, score (0 to 1) and predicted (1: score >= threshold)."""
    model = train(docs, labels, label, id_col, text_col, keep, rows)
    out = scored(docs, id_col, text_col, scorer(docs, model))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that score at least the threshold."""
    model = train(docs, labels, label, id_col, text_col, keep, rows)
    return filtered(docs, text_col, scorer(docs, model), lambda x: x >= threshold)

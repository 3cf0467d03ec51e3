"""Quality classifier: naive Bayes support vectors.

Features are hashed indicators of word 1- and 2-grams and of word-shape 1-, 2- and 3-grams (a
shape keeps the kinds of a word's characters, its punctuation, and whether it repeats the word
before). Each indicator is scaled by its class log-count ratio, and a linear hinge-loss model is
fitted on the scaled indicators by dual coordinate descent. A logistic curve through the held-in
margins turns a margin into a score. Only the two weight tables, of fixed size, leave the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.llm import words as W
from leakscan.llm.common import give_back, lean

#: Feature slots; labelled rows of each class that the fit takes at most (those of smallest hash, whatever the input's size); features taken of one text in the fit.
SLOTS, FIT_ROWS = 1 << 18, 3000
PASSES, COST, SMOOTH, THRESHOLD = 6, 0.1, 1.0, 0.3
_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_KIND[[0, 5, 6, 7, 8]] = 4


def _shapes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = _KIND[data]
    stay = np.ones(len(kind), bool)
    stay[1:] = (kind[1:] != kind[:-1]) | ~W.SOLID[kind[1:]]
    inner = offs[:-1][offs[:-1] < len(kind)]
    stay[inner] = True
    return W.word_hashes(kind[stay], np.append(0, np.cumsum(stay))[offs])


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Each text's distinct feature slots, sorted."""
    for _, _, data, offs in W.parts(texts):
        words, woffs = W.word_hashes(data, offs)
        shapes, soffs = _shapes(data, offs)
        if not np.array_equal(woffs, soffs):
            raise AssertionError("words and shapes differ in number")
        again = np.append(False, words[1:] == words[:-1]) if len(words) else np.zeros(0, bool)
        shapes = shapes + again.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        grams = [(W.shingle_hashes(words, n) + np.uint64(n), n) for n in (1, 2)] + [(W.shingle_hashes(shapes, n) + np.uint64(8 + n), n) for n in (1, 2, 3)]
        slots = [((W.mix(g) >> np.uint64(40)).astype(np.int64) % SLOTS, n) for g, n in grams]
        for s, e in zip(woffs[:-1].tolist(), woffs[1:].tolist(), strict=True):
            yield np.unique(np.concatenate([g[s : max(s, e - n + 1)] for g, n in slots]))


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, f: np.ndarray) -> float:
        return float(self.weight[f].sum() / np.sqrt(max(len(f), 1))) + self.bias

    def score(self, f: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(f) + self.offset, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """rows: feature slots; labels: 0 or 1. Without both classes every score is the share of 1 (0.5 without rows)."""
    y = np.where(labels == 1, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        p = float((labels == 1).mean()) if len(y) else 0.5
        p = min(max(p, 1e-6), 1 - 1e-6)
        return Model(np.zeros(SLOTS), 0.0, 1.0, float(np.log(p / (1 - p))))
    counts = {c: np.bincount(np.concatenate([r for r, v in zip(rows, labels, strict=True) if v == c]), minlength=SLOTS) + SMOOTH for c in (0, 1)}
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    x = [ratio[r] / np.sqrt(max(len(r), 1)) for r in rows]
    square = np.array([v @ v + 1 for v in x])
    w, bias, alpha = np.zeros(SLOTS), 0.0, np.zeros(len(y))
    # the rarer class costs as much as the other altogether
    most = COST * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    rnd = np.random.RandomState(7)
    for _ in range(PASSES):
        for i in rnd.permutation(len(y)):
            g = y[i] * (w[rows[i]] @ x[i] + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * x[i]
                bias += step
                alpha[i] = new
    model = Model(w * ratio, bias, 1.0, 0.0)
    m = np.array([model.margin(r) for r in rows])
    a, b, each = 1.0, 0.0, 0.5 / np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    aim = np.where(y > 0, 0.995, 0.005)
    for _ in range(50):  # Newton's steps for the logistic curve, classes weighing alike
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g0, g1, h = each @ (p - aim), (each * m) @ (p - aim), each * np.maximum(p * (1 - p), 1e-4)
        h00, h01, h11 = h.sum(), h @ m, h @ (m * m) + 1e-6
        det = h00 * h11 - h01 * h01
        if det <= 1e-12:
            break
        b, a = b - (h11 * g0 - h01 * g1) / det, a - (h00 * g1 - h01 * g0) / det
    model.slope, model.offset = a, b
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = list(features(b.column("text")))
        offs = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("label"), pa.ListArray.from_arrays(offs, pa.array(np.concatenate(sets), pa.int32()))], ["label", "slots"])


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(f) for f in features(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return run


def fold(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(1))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fits on labelled rows (labels: doc_id, quality 0 or 1) whose crc32(doc_id as text) mod 5 is not 0."""
    rows = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(fold("doc_id") != 0)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"), F.md5(F.col("doc_id").cast("string")).alias("draw")).distinct()
    own = F.broadcast  # 2 * fit_rows ids
    picked = [rows.where(F.col("label") == c).orderBy("draw", "doc_id").limit(fit_rows) for c in (0, 1)]
    picked = own(picked[0].union(picked[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id")
    got = texts.orderBy("draw", "label").select("label", "text").mapInArrow(_features, "label int, slots array<int>").toArrow()
    slots, label = got.column("slots").combine_chunks(), got.column("label").to_numpy()
    ends = slots.offsets.to_numpy()
    rows = np.split(slots.values.to_numpy(), ends[1:-1]) if len(label) else []
    try:
        return fit(rows, label)
    finally:
        # the rows aren't held besides what the driver needs later
        del got, slots, label, rows
        give_back()


def scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    Null and empty texts have no features and get the model's score for that. A null doc_id is not
    held out; a doc_id with several labels counts once for each; labels of unknown ids are unused.
    """
    model = train(docs, labels, fit_rows)
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(_score(model)), "doc_id long, score double")
    return x.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the classifier accepts; all columns stay."""
    model = train(docs, labels)
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [model.score(f) >= THRESHOLD for f in features(b.column(names.index("text")))]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(lean(run), schema)

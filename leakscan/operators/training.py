"""Training of a linear model with privacy, step by step over Spark: noisy clipped gradients, resume, and unlearning.

Rows are hashed words of a text; the model is one weight a feature. Each step is one job: every task adds up its rows' clipped gradients as
whole numbers, so that the sum doesn't depend on how rows are dealt, and only a sum a task is shuffled. Lots and noise come of the seed and the step alone, and the
state is written after each step to a table of checkpoints, so a run that is broken off and resumed ends bit by bit like one that isn't.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.functions.stats import epsilon
from leakscan.sources import checkpoints

#: Gradients are added up in units of 2**-UNIT.
UNIT = 32
_STATE = "key string, step int, place int, weight double"


@dataclass(frozen=True)
class Settings:
    """lot: how many rows a step takes on average, each drawn for itself; clip: the longest gradient of a row; noise: a multiple of clip."""

    features: int = 128
    lot: int = 256
    rate: float = 0.5
    clip: float = 1.0
    noise: float = 1.0
    seed: int = 7

    def name(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


def examples(docs: DataFrame, labels: DataFrame, features: int) -> DataFrame:
    """docs (doc_id, text) that have a label (doc_id, label 0 or 1): doc_id, label, x. x are shares of hashed words, of length 1, after a constant; a text without words has the constant only."""
    words = F.filter(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    x = docs.select("doc_id", F.transform(F.coalesce(words, F.array()), lambda w: F.pmod(F.xxhash64(w), F.lit(features - 1)).cast("int")).alias("h"))
    x = x.join(labels.select("doc_id", F.col("label").cast("int").alias("label")).where("label IS NOT NULL"), "doc_id")
    return x.mapInArrow(_vectors(features), "doc_id long, label int, x array<double>")


def _vectors(features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                rows = np.zeros((b.num_rows, features))
                for k, h in enumerate(b.column("h")):
                    n = np.bincount(np.asarray(h.values, np.int64), minlength=features - 1).astype(float) if len(h.values) else np.zeros(features - 1)
                    rows[k, 1:] = n / (np.linalg.norm(n) or 1.0)
                rows[:, 0] = 1.0
                offs = pa.array(np.arange(0, rows.size + 1, features, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.ListArray.from_arrays(offs, pa.array(rows.ravel()))], ["doc_id", "label", "x"])

    return run


def _margins(b: pa.RecordBatch, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.asarray(b.column("x").flatten()).reshape(b.num_rows, -1)
    # row by row, so that a row's value doesn't depend on its neighbours
    z = np.array([float(np.dot(r, w)) for r in x])
    return x, z, np.asarray(b.column("label"), float)


def _summed(w: np.ndarray, clip: float, ascend: bool):
    """One row a task: the sum of its rows' clipped gradients, in units, and how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(w), np.int64), 0
        for b in batches:
            if b.num_rows:
                x, z, y = _margins(b, w)
                g = (1.0 / (1.0 + np.exp(-z)) - y)[:, None] * x
                g *= np.minimum(1.0, clip / np.maximum(np.sqrt((g * g).sum(axis=1)), 1e-300))[:, None]
                total += np.rint((-g if ascend else g) * 2.0**UNIT).astype(np.int64).sum(axis=0)
                n += b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))], ["n", "g"])

    return run


def gradient(rows: DataFrame, w: np.ndarray, clip: float, ascend: bool = False) -> tuple[np.ndarray, int]:
    """The sum of rows' clipped gradients at w, and their number."""
    parts = rows.mapInArrow(_summed(w, clip, ascend), "n long, g array<long>")
    got = parts.select("n", F.posexplode("g")).groupBy("pos").agg(F.sum("col").alias("g"), F.sum("n").alias("n")).collect()
    out = np.zeros(len(w))
    for r in got:
        out[r.pos] = r.g / 2.0**UNIT
    return out, got[0].n if got else 0


def drawn(rows: DataFrame, seed: int, step: int, share: float) -> DataFrame:
    """Rows that a step takes: each by a hash of its doc_id and the step."""
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def loss(rows: DataFrame, w: np.ndarray) -> DataFrame:
    """One row: n, the mean loss, and how many the model has right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, z, y = _margins(b, w)
            each = np.logaddexp(0.0, np.where(y > 0.5, -z, z))
            yield pa.RecordBatch.from_arrays([pa.array(each), pa.array((z > 0) == (y > 0.5))], ["e", "ok"])

    return rows.mapInArrow(run, "e double, ok boolean").agg(F.count("*").alias("n"), F.avg("e").alias("loss"), F.count_if("ok").alias("right"))


def load(spark, path: str, s: Settings) -> tuple[int, np.ndarray]:
    """The last step that a run wrote and its weights; step 0 and zeros before the first. A run of other settings is refused."""
    keys = [r.key for r in checkpoints.read_log(spark, path).select("key").distinct().collect()]
    if any(not k.startswith(s.name()) for k in keys):
        raise ValueError("the state was written under other settings")
    if not keys:
        return 0, np.zeros(s.features)
    step = max(int(k.rsplit(":", 1)[1]) for k in keys)
    x = checkpoints.read_checkpoint(spark, path, _STATE).where(F.col("key") == f"{s.name()}:{step}")
    return step, np.array([r.weight for r in x.orderBy("place").collect()])


def store(spark, path: str, s: Settings, step: int, w: np.ndarray) -> None:
    rows = [(f"{s.name()}:{step}", step, i, float(v)) for i, v in enumerate(w)]
    checkpoints.write_checkpoint(spark.createDataFrame(rows, _STATE).coalesce(1), path)


def train(rows: DataFrame, steps: int, path: str, s: Settings = Settings(), stop_after: int | None = None) -> np.ndarray:  # noqa: B008
    """Weights after so many steps over rows (doc_id, label, x), from the last step that path has on; each step is written there. stop_after: steps of this call at most."""
    spark = rows.sparkSession
    total = rows.count()
    share = min(1.0, s.lot / total) if total else 0.0
    step, w = load(spark, path, s)
    for t in range(step, min(steps, step + stop_after) if stop_after is not None else steps):
        g, _ = gradient(drawn(rows, s.seed, t, share), w, s.clip)
        noise = np.random.Generator(np.random.Philox(key=[s.seed, t])).normal(0.0, s.noise * s.clip, s.features)
        w = w - s.rate * (g + noise) / max(1, s.lot)
        store(spark, path, s, t + 1, w)
    return w


def spent(spark, n: int, steps: int, s: Settings) -> float:
    """Epsilon of a run over n rows."""
    one = spark.range(1).select(epsilon(F.lit(steps), F.lit(min(1.0, s.lot / max(n, 1))), F.lit(float(s.noise))).alias("e"))
    return one.first().e


def unlearn(w: np.ndarray, forget: DataFrame, retain: DataFrame, target: float, bound: float, steps: int = 20, rate: float = 2.0, clip: float = 1.0, heard: Callable[[dict], None] = lambda _: None) -> np.ndarray:
    """Weights after ascent on forget and descent on retain, in turns, until the mean loss of forget is target or more.

    After each ascent, steps of repair go on while the mean loss of retain is over its first value plus bound, five at most; weights that don't come back are dropped and the rate halved.
    heard is told each turn's losses. Ends after so many turns at most."""
    first = loss(retain, w).first().loss
    for t in range(steps):
        if (loss(forget, w).first().loss or 0.0) >= target:
            break
        g, n = gradient(forget, w, clip, ascend=True)
        v = w - rate * g / max(n, 1)
        for _ in range(5):
            if loss(retain, v).first().loss <= first + bound:
                break
            g, n = gradient(retain, v, clip)
            v = v - rate * g / max(n, 1)
        kept = loss(retain, v).first().loss
        if kept > first + bound:
            rate /= 2
            continue
        w = v
        heard({"turn": t, "forget": loss(forget, w).first().loss, "retain": kept})
    return w

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from leakscan.llm import quality
from leakscan.llm.queries import QUERIES


def plain_grams(text):
    """Word and shape n-grams as text."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    raw = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    kind = lambda c: "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "0" if c.isascii() and c.isdigit() else "é" if not c.isascii() else c
    shapes = []
    for i, w in enumerate(raw):
        k = "".join(kind(c) for c in w)
        shapes.append((re.sub(r"(.)\1+", r"\1", k), i > 0 and words[i] == words[i - 1]))
    out = {("w", n, tuple(words[i : i + n])) for n in (1, 2) for i in range(len(words) - n + 1)}
    return out | {("s", n, tuple(shapes[i : i + n])) for n in (1, 2, 3) for i in range(len(shapes) - n + 1)}


def plain_fit(rows, labels):
    """The model step by step, over dictionaries."""
    y = [1 if v == 1 else -1 for v in labels]
    pos, neg = sum(v > 0 for v in y), sum(v < 0 for v in y)
    count = {1: {}, -1: {}}
    for r, v in zip(rows, y, strict=True):
        for f in r:
            count[v][f] = count[v].get(f, 0) + 1
    total = {v: sum(c.values()) + quality.SLOTS * quality.SMOOTH for v, c in count.items()}
    ratio = {f: math.log((count[1].get(f, 0) + 1) / total[1]) - math.log((count[-1].get(f, 0) + 1) / total[-1]) for f in {f for r in rows for f in r}}
    x = [{f: ratio[f] / math.sqrt(max(len(r), 1)) for f in r} for r in rows]
    w, bias, alpha, rnd = {}, 0.0, [0.0] * len(y), np.random.RandomState(7)
    for _ in range(quality.PASSES):
        for i in rnd.permutation(len(y)):
            g = y[i] * (sum(w.get(f, 0.0) * v for f, v in x[i].items()) + bias) - 1
            most = quality.COST * len(y) / (2 * (pos if y[i] > 0 else neg))
            new = min(max(alpha[i] - g / (sum(v * v for v in x[i].values()) + 1), 0.0), most)
            step, alpha[i] = (new - alpha[i]) * y[i], new
            for f, v in x[i].items():
                w[f] = w.get(f, 0.0) + step * v
            bias += step
    margin = lambda r: sum(w.get(f, 0.0) * ratio.get(f, 0.0) for f in r) / math.sqrt(max(len(r), 1)) + bias
    return margin


def test_features_against_plain_ones():
    texts = ["The cat, the Cat! saw 12 É été", "", " ", "a a a b", "x", "one two\tthree\nFOUR five-six 7.8.9", None]
    got = list(quality.features(pa.array(texts, pa.string())))
    for t, f in zip(texts, got, strict=True):
        # slots can coincide, but hardly do so here
        assert len(f) == len(plain_grams(t)) and (np.diff(f) > 0).all()
    same = list(quality.features(pa.array(["The CAT sat", "the cat sat"])))
    assert len(set(same[0]) & set(same[1])) >= 5


def test_scores_against_a_plain_fit(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    import hashlib

    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    slots = dict(zip([d for d, _ in docs], quality.features(pa.array([t for _, t in docs], pa.string())), strict=True))
    fit = sorted((hashlib.md5(str(d).encode()).hexdigest(), labels[d], d) for d, _ in docs if d in labels and labels[d] in (0, 1) and not held(d))
    margin = plain_fit([slots[d].tolist() for *_, d in fit], [v for _, v, _ in fit])
    got = {r.doc_id: r for r in QUERIES["op9_quality"](spark, sf).collect()}
    assert set(got) == {d for d, _ in docs}
    # the score is one rising curve of the margin
    order = sorted(got, key=lambda d: margin(slots[d]))
    scores = [got[d].score for d in order]
    assert all(a <= b + 1e-9 for a, b in zip(scores[:-1], scores[1:], strict=True))
    logit = lambda p: math.log(p / (1 - p))
    inner = [d for d in order if 1e-6 < got[d].score < 1 - 1e-6]
    slope, offset = np.polyfit([margin(slots[d]) for d in inner], [logit(got[d].score) for d in inner], 1)
    assert all(logit(got[d].score) == pytest.approx(slope * margin(slots[d]) + offset, abs=1e-5) for d in inner)
    assert all(r.held_out == held(d) and r.predicted == (r.score >= 0.3) for d, r in got.items())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op9_quality"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert len(rows) > 50 and sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.97 * len(rows)


def test_the_fit_gives_its_memory_back(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad, bad! ") * 3) for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality")
    done = []
    monkeypatch.setattr(quality, "fit", lambda rows, y, fit=quality.fit: done.append("fit") or fit(rows, y))
    monkeypatch.setattr(quality, "give_back", lambda: done.append("given back"))
    quality.train(docs, labels)
    quality.train(docs, labels.limit(0))
    assert done == ["fit", "given back"] * 2

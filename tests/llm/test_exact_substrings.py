import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from leakscan.llm import exact_substrings as X


def brute(texts, m=X.MIN):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + m] for d in data for i in range(len(d) - m + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        last = 0
        for i in range(len(d) - m + 1):
            if seen[d[i : i + m]] > 1:
                for j in range(max(i, last), i + m):
                    gone[j] = True
                last = i + m
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def texts():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    out = [None, "", "short", "a" * 199, "a" * 1000, "ab" * 300, "ab" * 150 + prose(40)]
    for i in range(80):
        t = [prose(rnd.randrange(60)), rnd.choice(shared)[rnd.randrange(80) :], prose(rnd.randrange(60)), rnd.choice(shared)[: rnd.randrange(150, 330)]]
        out.append("".join(t[: rnd.randrange(1, 5)]))
    return out + [out[10], out[10], out[11], shared[0][:200], shared[0][1:201], prose(9000)]


@pytest.mark.parametrize("crowd", [2000, 3])
def test_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(X, "CROWD", crowd)
    rows = [(i if i % 7 else None, t, 1) for i, t in enumerate(texts())]
    rows += [rows[12], rows[12]]
    df = spark.createDataFrame(rows, "doc_id long, text string, at int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in X.remove_repeats(df).collect())
    want = sorted((i is None, i or 0, *w) for (i, _, _), w in zip(rows, brute([r[1] for r in rows]), strict=True))
    assert got == want


def test_all_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in X.remove_repeats(df).collect()}
    assert got == {(r.doc_id, *w) for r, w in zip(rows, brute([r.text for r in rows]), strict=True)}


def test_prefixes_by_value(monkeypatch):
    monkeypatch.setattr(X, "MIN", 8)
    rnd = np.random.RandomState(1)
    for _ in range(40):
        s = np.append(rnd.choice([0, 1, 2, 2, 3], 60), np.zeros(9, int)).astype(np.int16)
        got = X.repeated_places(s)
        for i in range(60):
            w = s[i : i + 8]
            if len(w) == 8 and (w != 0).all():
                assert got[i] == (sum((s[j : j + 8] == w).all() for j in range(62)) > 1)


def test_empty(spark):
    assert X.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_text_longer_than_a_part(spark):
    rnd = random.Random(9)
    noise = lambda n: "".join(rnd.choices("0123456789abcdef", k=n))
    shared = ["<" + noise(298) + f">{i}" for i in range(3)]
    # one passage over the first border of parts, one right after it, one at the end
    big = noise(X.PART - 150) + shared[0] + noise(500) + shared[1] + noise(150_000) + shared[2]
    rows = [(1, big), (2, "x" + shared[0] + "y" + shared[2]), (3, shared[1] + "z"), (4, None), (5, big[X.PART - 400 : X.PART - 250])]
    got = {r.doc_id: r for r in X.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in range(1, 6)] == [(903, 3), (602, 2), (301, 1), (0, 0), (0, 0)]
    kept = big
    for s in shared:
        kept = kept.replace(s, "")
    assert bytes(got[1].kept).decode() == kept and bytes(got[2].kept) == b"xy" and bytes(got[4].kept) == b""

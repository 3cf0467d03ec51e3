import math
import pathlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscan.operators import inference, joins, language_model, metrics


def brute_losses(docs, held):
    grams = {d: [(v[i], v[i + 1], v[i + 2]) for v in [["", ""] + t.split()] for i in range(len(v) - 2)] for d, t in docs if t and t.split()}
    c3 = Counter(g for d, gs in grams.items() if not held(d) for g in gs)
    c2, c1 = Counter(), Counter()
    for (_, b, w), n in c3.items():
        c2[b, w] += n
        c1[w] += n
    s3, t3, s2, t2 = Counter(), Counter(), Counter(), Counter()
    for (a, b, _), n in c3.items():
        s3[a, b] += n
        t3[a, b] += 1
    for (b, _), n in c2.items():
        s2[b] += n
        t2[b] += 1

    def loss(a, b, w):
        p = 1 / (len(c1) + 1)
        for c, s, t in ((c1[w], sum(c1.values()), len(c1)), (c2[b, w], s2[b], t2[b]), (c3[a, b, w], s3[a, b], t3[a, b])):
            p = (c + t * p) / (s + t) if s else p
        return -math.log(p)

    return {d: (len(gs), sum(loss(*g) for g in gs)) for d, gs in grams.items()}


def test_losses_against_brute_force(spark, monkeypatch):
    rnd = random.Random(2)
    docs = [(i, " ".join(rnd.choice(["the"] * 8 + [f"w{k}" for k in range(9)]) for _ in range(rnd.randrange(1, 60)))) for i in range(40)]
    docs += [(50, None), (51, ""), (52, " \n"), (55, "new words  only\there"), (60, "the")]
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, b string, n int")
    want = brute_losses(docs, lambda d: d % 5 == 0)
    for hot in (0.001, 0.05):
        monkeypatch.setattr(joins, "HOT", hot)
        got = {r.doc_id: (r.tokens, r.loss, r.held_out) for r in language_model.corpus_loss(df, "doc_id % 5 = 0").collect()}
        assert {d: (n, pytest.approx(e), d % 5 == 0) for d, (n, e) in want.items()} == got
    x = language_model.corpus_loss(df, "doc_id % 5 = 0")
    (r,) = language_model.perplexity(x.where("held_out"), "held_out").collect()
    held = [v for d, v in want.items() if d % 5 == 0]
    assert r.mean_loss == pytest.approx(sum(e for _, e in held) / sum(n for n, _ in held)) and r.perplexity == pytest.approx(math.exp(r.mean_loss))
    # no texts at all, and none to count
    assert language_model.corpus_loss(df.limit(0), "true").collect() == []
    assert all(r.loss == 0 for r in language_model.corpus_loss(df, "true").collect())


def test_losses_in_parts(spark, monkeypatch):
    rnd = random.Random(4)
    docs = [(i, " ".join(f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(1, 200)))) for i in range(60)] + [(61, None), (65, "w1"), (70, "only here")]
    want, shared, seen = brute_losses(docs, lambda d: d % 5 == 0), pathlib.Path(spark.conf.get("spark.checkpoint.dir")), []
    old = set(shared.rglob("*"))
    monkeypatch.setattr(language_model, "TOKENS", 1000)
    monkeypatch.setattr(language_model, "_stored", lambda x, write=language_model._stored: seen.append((set(x.columns), y := write(x), y.count())) or y)
    x = language_model.corpus_loss(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id % 5 = 0")
    got = {r.doc_id: (r.tokens, r.loss, r.held_out) for r in x.collect()}
    assert {d: (n, pytest.approx(e), d % 5 == 0) for d, (n, e) in want.items()} == got
    # each trigram is in one part, no part has most of them, and only sums by document stay
    three = [n for c, _, n in seen if "c3" in c]
    all_three = {g for _, t in docs if t for v in [["", ""] + t.split()] for g in zip(v, v[1:], v[2:], strict=False)}
    assert len(three) > 3 and sum(three) == len(all_three) and max(three) < len(all_three) / 2
    left = {tuple(spark.read.parquet(str(f)).columns) for f in {f.parent for f in set(shared.rglob("*.parquet")) - old}}
    assert left == {("doc_id", "tokens", "loss")}


def test_probabilities_add_up(spark):
    text = "a b a c a b d"
    loss = lambda last: brute_losses([(1, text), (5, f"a b {last}")], lambda d: d == 5)[5][1]
    two = brute_losses([(1, text), (5, "a b")], lambda d: d == 5)[5][1]
    assert sum(math.exp(-(loss(w) - two)) for w in ("a", "b", "c", "d", "other")) == pytest.approx(1)


def test_draws_add_up_to_all_persons():
    for n in (1, 7, 600):
        whole = inference.split_draws(n, 0, n, range(40), 3)
        assert (whole.sum(axis=0) == n).all()
        for low, high in ((0, n // 2), (n // 3, n), (n - 1, n)):
            assert (inference.split_draws(n, low, high, range(40), 3) == whole[low:high]).all()
    many = inference.split_draws(50, 0, 50, range(4000), 9)
    assert abs(many.mean() - 1) < 1e-9 and abs(many.var() - (1 - 1 / 50)) < 0.03
    off = np.corrcoef(many) - np.eye(50)
    assert abs(off[off != 0].mean() + 1 / 49) < 0.005


def test_exact_bootstrap_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(inference, "BLOCK", 16)
    monkeypatch.setattr(inference, "AT_ONCE", 100)
    rows = [("m", p * 9000, (p * 7) % 5, 5) for p in range(60)] + [("k", p, p % 3, 3) for p in range(5)]
    x = spark.createDataFrame(rows, "model string, pid int, hits int, n int")
    got = {r.model: r for r in inference.exact_bootstrap(x, inference.rate_statistic, 250).collect()}
    for model in ("m", "k"):
        own = [r for r in rows if r[0] == model]
        v = []
        for b in range(0, 250, 100):
            w = inference.split_draws(len(own), 0, len(own), range(b, min(b + 100, 250)), 7)
            v += [sum(h * k for (_, _, h, _), k in zip(own, d, strict=True)) / sum(n * k for (_, _, _, n), k in zip(own, d, strict=True)) for d in w.T]
        r = got[model]
        assert (r.replicates, r.low, r.high, r.se) == (250, *[pytest.approx(q) for q in np.percentile(v, [2.5, 97.5])], pytest.approx(np.std(v, ddof=1)))
    assert inference.exact_bootstrap(x.limit(0), inference.rate_statistic, 10).collect() == []


@pytest.mark.parametrize("tolerance", [1e-9, 0.5, 3.0])
def test_within(spark, tolerance):
    rnd = random.Random(5)
    a = [(i, rnd.choice([0.1 * rnd.randrange(-200, 200), 7.0, -7.0, 1e300, 5e15 + rnd.randrange(9)])) for i in range(150)] + [(900, None), (901, float("nan")), (902, float("inf")), (903, -0.0), (904, 7.0 + 4e-10)]
    b = [(i, rnd.choice([0.1 * rnd.randrange(-200, 200), 7.0, 7.0, 1e300, 5e15 + rnd.randrange(9)])) for i in range(150)] + [(900, None), (901, float("nan")), (902, float("inf")), (903, 0.0)]
    left, right = spark.createDataFrame(a, "i int, x double"), spark.createDataFrame(b, "j int, y double")
    want = sorted((i, j) for i, x in a for j, y in b if x is not None and y is not None and abs(x - y) < tolerance)
    for crowd in (20_000, 10):
        y = joins.within(left, right, "x", "y", tolerance, crowd)
        assert sorted((r.i, r.j) for r in y.collect()) == want
    assert "NestedLoop" not in y._jdf.queryExecution().executedPlan().toString()


def test_overlapping(spark):
    rnd = random.Random(8)
    draw = lambda n: [(rnd.choice(["k", "k", "k", "other", None]), i, (s := rnd.choice([0.0, 5.0, float(rnd.randrange(50))])), s + rnd.choice([0.0, 1.0, 9.0, 60.0, -1.0])) for i in range(n)]
    a, b = draw(90), draw(70) + [("k", 100, None, 3.0), ("k", 101, 2.0, float("nan")), ("k", 102, 5.0, None), ("k", 103, -9.0, 99.0)]
    frame = lambda x: spark.createDataFrame(x, "key string, id long, start double, end double")
    good = lambda r: r[0] is not None and r[2] is not None and r[3] is not None and r[2] <= r[3]
    want = sorted((p[0], p[1], q[1]) for p in a for q in b if good(p) and good(q) and p[0] == q[0] and p[2] <= q[3] and q[2] <= p[3])
    for parts in (1, 6):
        assert sorted(map(tuple, joins.overlapping(frame(a), frame(b), parts).collect())) == want
    assert joins.overlapping(frame(a).limit(0), frame(b).limit(0)).collect() == []


def test_observed(spark, tmp_path):
    x = spark.createDataFrame([("m", i % 3 == 0, None if i % 4 else "e") for i in range(50)], "model string, hit boolean, error string")
    y, told = metrics.observed(x)
    y.write.parquet(str(tmp_path / "a"))
    got = told()
    assert (got["n"], got["hits"], got["errors"]) == (50, 17, 13) and got["rate"] > 0
    y, told = metrics.observed(x.drop("error").limit(0))
    y.write.parquet(str(tmp_path / "b"))
    assert (told()["n"], told()["hits"], told()["errors"]) == (0, 0, 0)


def test_progress_of_a_stream(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([("m", k % 2 == 0) for k in range(10)], "model string, hit boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    heard = metrics.StreamProgress("records")
    spark.streams.addListener(heard)
    try:
        x = spark.readStream.schema("model string, hit boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = metrics.observed_stream(x, "records").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(50):
            if heard.n == 30:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(heard)
    assert (heard.n, heard.hits, heard.errors) == (30, 15, 0) and len(heard.rates) >= 3


def test_losses_of_crowded_words(spark, monkeypatch):
    rnd = random.Random(6)
    docs = [(i, " ".join(rnd.choice(["the", "of", *[f"w{k}" for k in range(60)]]) for _ in range(rnd.randrange(1, 90)))) for i in range(80)] + [(90, "the " * 700), (95, "of the " * 300), (96, "new")]
    want, made = brute_losses(docs, lambda d: d % 5 == 0), []
    monkeypatch.setattr(language_model, "_stored", lambda x, write=language_model._stored: made.append(x._jdf.queryExecution().executedPlan().toString()) or write(x))
    monkeypatch.setattr(language_model, "TOKENS", 3000)
    monkeypatch.setattr(language_model.packed, "BLOCK", 500)
    for crowd, joined in ((10**9, 0), (400, 1)):
        monkeypatch.setattr(language_model, "HOT", crowd)
        made.clear()
        got = {r.doc_id: (r.tokens, r.loss, r.held_out) for r in language_model.corpus_loss(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id % 5 = 0").collect()}
        assert {d: (n, pytest.approx(e), d % 5 == 0) for d, (n, e) in want.items()} == got
        # trigrams are joined only where a middle word is too much for a task; the last table has a row for each document
        assert any("Join" in p for p in made[:-1]) == joined


def test_wide_numbers_of_words(spark):
    a, b, w, c1 = [0, 0, 5, 2**40], [0, 5, 2**40, 5], [5, 2**40, 5, 2**40], [2, 2, 2, 2]
    losses = []
    for kind, of in ((np.int64, lambda v: v), (np.int32, lambda v: 7 if v == 2**40 else v)):
        binary = lambda v: np.array([of(i) for i in v], kind).tobytes()  # noqa: B023, E731
        row = {"bucket": 1, "block": 3, "a": binary(a), "b": binary(b), "w": binary(w), "c1": binary(c1), "doc": np.array([3, 3, 3, 3], np.int32).tobytes()}
        batch = language_model.packed.pa.RecordBatch.from_pylist([row])
        out = [r for x in language_model.packed.bucket_losses(kind, 4, 2)(iter([batch])) for r in x.to_pylist()]
        assert {d for r in out for d in r["docs"]} == {3 << language_model.packed.ROW} and [r["c3"] for r in out] == [1] * 4
        losses.append(sorted(r["each"] for r in out))
    assert losses[0] == pytest.approx(losses[1])

import random

import numpy as np
import pytest

from leakscan.operators import language_model, training

S = training.Settings(features=24, lot=30, rate=0.8, clip=0.7, noise=0.5, seed=3)


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(1)
    docs = [(i, " ".join(rnd.choice(["good", "fine", "w1", "w2"] if i % 2 else ["bad", "poor", "w1", "w2"]) for _ in range(rnd.randrange(1, 20)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "not labelled")]
    labels = [(i, i % 2) for i in range(120)] + [(200, 1), (201, 0), (203, 1), (202, None)]
    x = training.examples(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int"), S.features)
    return x.persist()


def test_examples(rows):
    got = {r.doc_id: r for r in rows.collect()}
    assert len(got) == 122 and all(r.x[0] == 1 and len(r.x) == 24 for r in got.values())
    assert sum(got[200].x) == sum(got[201].x) == 1
    assert np.linalg.norm(got[5].x[1:]) == pytest.approx(1)


def test_gradient_against_brute_force(rows):
    w = np.random.default_rng(2).normal(size=24)
    want, n = np.zeros(24), 0
    for r in rows.collect():
        x = np.array(r.x)
        g = (1 / (1 + np.exp(-x @ w)) - r.label) * x
        want += g * min(1, 0.7 / np.linalg.norm(g))
        n += 1
    got, m = training.gradient(rows, w, 0.7)
    assert m == n and got == pytest.approx(want, abs=1e-6)
    up, _ = training.gradient(rows.repartition(5), w, 0.7, ascend=True)
    assert (up == -got).all()
    assert training.gradient(rows.limit(0), w, 0.7)[1] == 0
    (r,) = training.loss(rows, w).collect()
    z = np.array([np.array(x.x) @ w * (1 if x.label else -1) for x in rows.collect()])
    assert r.n == n and r.loss == pytest.approx(np.log1p(np.exp(-z)).mean())


def test_a_resumed_run_equals_an_unbroken_one(spark, rows, tmp_path):
    whole = training.train(rows, 6, str(tmp_path / "a"), S)
    part = str(tmp_path / "b")
    training.train(rows, 6, part, S, stop_after=2)
    assert training.load(spark, part, S)[0] == 2
    # other partitions, as on another cluster
    training.train(rows.repartition(7), 6, part, S, stop_after=1)
    again = training.train(rows.repartition(2), 6, part, S)
    assert (again == whole).all() and training.load(spark, part, S)[0] == 6
    # what is done isn't done again
    assert (training.train(rows.limit(0), 6, part, S) == whole).all()
    with pytest.raises(ValueError, match="other settings"):
        training.train(rows, 8, part, training.Settings(features=24, lot=30, rate=0.8, clip=0.7, noise=0.6, seed=3))
    assert training.spent(spark, 122, 6, S) > training.spent(spark, 122, 2, S) > 0


def test_lots_are_drawn_anew(rows):
    lots = [{r.doc_id for r in training.drawn(rows, 3, t, 0.25).collect()} for t in range(6)]
    assert all(10 < len(x) < 55 for x in lots) and len({frozenset(x) for x in lots}) == 6


def test_unlearning(rows):
    w = np.zeros(24)
    for _ in range(6):
        g, n = training.gradient(rows, w, 1.0)
        w = w - 4 * g / n
    forget, retain = rows.where("doc_id < 10"), rows.where("doc_id >= 10")
    before = training.loss(forget, w).first().loss, training.loss(retain, w).first().loss
    heard = []
    v = training.unlearn(w, forget, retain, before[0] + 0.05, 0.1, heard=heard.append)
    assert training.loss(forget, v).first().loss >= before[0] + 0.05
    assert training.loss(retain, v).first().loss <= before[1] + 0.1
    assert heard and heard[-1]["forget"] >= before[0] + 0.05
    # nothing to do
    assert (training.unlearn(w, forget, retain, 0.0, 0.1) == w).all()


def test_options(spark):
    model = language_model.counted(language_model.trigrams(spark.createDataFrame([(1, "the cat sat on the mat the cat sat here the dog ran")], "doc_id long, text string")))
    q = [(1, "so the cat", ["ran", "sat", "on", "mat"]), (2, "the", ["zz", "dog ran", "dog ran", ""]), (3, "x", ["", " ", None, ""]), (4, None, ["new", "new", "words", "too"])]
    got = {r.id: r.given for r in language_model.answered(spark.createDataFrame(q, "id int, prompt string, options array<string>"), model).collect()}
    # of equal options the first; none without words
    assert got[1] == "B" and got[3] is None and got[4] == "A" and got[2] in "AB"

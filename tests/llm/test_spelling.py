import random
import re
import zlib
from collections import Counter

import pytest

from leakscan.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, prefix string"


def brute(rows, every, least, count, factor):
    c = Counter()
    for d, t in rows:
        for m in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda x: x[0].lower(), m)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            c[w[: h % len(w)] + w[h % len(w) + 1 :] if h % every == 0 else w] += 1
    c = {w: n for w, n in c.items() if len(w) >= least and n >= count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in c if near(w, v)] for w in c}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-c[v], v), default=None)
        if vs and c[best] >= factor * c[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return Counter((w, form.get(w), root(w), c[w], len(near[w]), c[form[w]] if w in form else None) for w in c)


def rows():
    rnd = random.Random(3)

    def text(n):
        return " ".join("".join(rnd.choice("abé") for _ in range(rnd.choice([5, 6, 6, 7]))) for _ in range(n))

    out = [(i, text(150)) for i in range(8)] + [(None, "ABCDEF abcdef-abcdeg ÀÉÎÖÜß×÷ " * 9), (40, None), (41, ""), (41, "")]
    # a long common beginning and end, and one word that makes up a third of all
    return out + [(50, " ".join("x" * 30 + "".join(rnd.choice("uvw") for _ in range(3)) + "y" * 20 for _ in range(60))), (51, "abcdefg " * 600)]


@pytest.mark.parametrize(("every", "least", "count", "crowd"), [(7, 6, 2, 5000), (7, 6, 1, 40), (3, 4, 2, 60)])
def test_against_brute_force(spark, every, least, count, crowd):
    df = spark.createDataFrame([(d, t, "k", 1, "p") for d, t in rows()], SCHEMA)
    got = Counter(map(tuple, spelling.variants(df, every, least, count, 2, crowd).collect()))
    assert got == brute(rows(), every, least, count, 2)
    assert any(f for _, f, *_ in got)


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_roots_of_a_long_chain(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(21)], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w21"}

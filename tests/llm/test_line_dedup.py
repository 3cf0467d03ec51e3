import random
import re
import time

import pytest

from leakscan.llm.line_dedup import MIN_WORDS, dedup_lines, removed_lines


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    a, b = sorted((a, b), key=len)
    return b[i + 1 :] == a[i:]


def brute(rows, least=MIN_WORDS):
    lines = sorted({(d, i, line) for d, t in rows if t is not None for i, line in enumerate(t.split("\n"))})
    words = [re.findall(r"[^\x20\x09-\x0D]+", x[2]) for x in lines]
    gone = set()
    for j, (d, i, line) in enumerate(lines):
        w = words[j]
        if w and any(lines[k][2] == line or (len(w) >= least and len(words[k]) >= least and distance_one(w, words[k])) for k in range(j)):
            gone.add((d, i))
    return gone


@pytest.mark.parametrize("least", [MIN_WORDS, 3, 1])
def test_against_brute_force(spark, least):
    rnd = random.Random(3)
    base = [[f"w{rnd.randrange(40)}" for _ in range(rnd.choice([1, 2, 3, 7, 8, 9, 12, 300]))] for _ in range(30)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rnd.randrange(6)):
            w = rnd.choice(base)[:]
            for _ in range(rnd.choice([0, 1, 1, 2])):
                p = rnd.randrange(len(w))
                w[p : p + rnd.choice([0, 1])] = rnd.choice([[], ["zz"], [f"q{rnd.randrange(9)}"]])
                w = w or ["a"]
            lines.append(rnd.choice([" ", "\t", "  "]).join(w) + rnd.choice(["", " ", "\r"]))
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n \n"), (103, rows[5][1]), (103, rows[5][1]), (104, "x " * 1000), (105, "x " * 999)]
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, line_no int, pos string")
    want = brute(rows, least)
    assert {(r.doc_id, r.line_no) for r in removed_lines(df, least).collect()} == want
    texts = dict(rows)
    for r in dedup_lines(df, least).collect():
        t = texts[r.doc_id]
        keep = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (r.doc_id, i) not in want)
        assert (r.text, r.n_removed) == (keep, sum(d == r.doc_id for d, _ in want))


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a\na"), (1, "a\na")], "doc_id long, text string")
    assert {(r.doc_id, r.n_lines, r.n_removed, r.text) for r in dedup_lines(df).collect()} == {(None, 2, 0, "a\na"), (1, 2, 1, "a")}
    assert dedup_lines(df.limit(0)).collect() == []


def test_false_partner_hides_no_true_one(spark):
    b = [f"b{i}" for i in range(1, 11)]
    rows = [(0, " ".join(["u", *b])), (1, " ".join(["b1", "v", *b[1:9], "z"])), (2, " ".join(["b1", "v", *b[1:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(r) for r in removed_lines(df).collect()] == [(2, 0, 1, 0)]
    # 0 and 1 have b1 .. b10 in common but are two words apart
    assert brute(rows) == {(2, 0)}


def test_documents_of_many_lines(spark):
    # two copies of 200,000 lines: all lines of the second go, in time that grows with their number
    text = "\n".join(f"line {i} of a long document with some words" for i in range(0, 1_000_000, 5))
    df = spark.createDataFrame([(1, text), (2, text), (3, "z")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    # lines that differ by their number only are one word apart, so one line is left
    assert (got[1].n_lines, got[1].n_removed, got[2].n_removed, got[1].text, got[2].text) == (200_000, 199_999, 200_000, text.split("\n")[0], "")
    assert time.time() - began < 120


def test_a_line_in_every_document(spark):
    hot = "this very line stands in all of the documents"
    rows = [(i, f"{hot}\nown q{i}\n{hot}") for i in range(3000)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.text == (f"{hot}\nown q{r.doc_id}" if r.doc_id == 0 else f"own q{r.doc_id}") for r in got) and len(got) == 3000

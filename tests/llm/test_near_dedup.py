import random
import re
from collections import defaultdict

import pytest

from leakscan.llm.near_dedup import keep_first, near_duplicates

DATA = "/root/testdata"


def brute(rows, k):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    at = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        both = defaultdict(int)
        for x in s:
            for j in at[x]:
                both[j] += 1
        for j, n in both.items():
            if j < i and 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {(i, len(s), root(i), root(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{DATA}/{sf}/documents.parquet")
    assert {tuple(r) for r in near_duplicates(docs, 4).collect()} == brute([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], 4)


def test_hot_groups_and_odd_rows(spark):
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(9999)}" for _ in range(120)]
    rows = [(i, " ".join(base)) for i in range(200)]
    for i in range(200, 500):  # near copies of one text
        w = base[:]
        w[rnd.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(600 + i, t) for i, t in enumerate([None, "", "  \n", "One two", "one TWO", "three", "a" * 100_000, "a" * 99_999, "ß ß ß ß"])]
    rows += [(700, " ".join(f"q{i}" for i in range(30000))), (701, " ".join(f"q{i}" for i in range(29000)))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, comp int")
    assert {tuple(r) for r in near_duplicates(df, 5).collect()} == brute(rows, 5)
    kept = keep_first(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _, keep in brute(rows, 5) if keep}


def test_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "z"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df, 5).collect()), key=str) == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (2, 2, 1, False)], key=str)
    assert near_duplicates(df.limit(0)).collect() == []


def test_thousands_linked_through_one_text(spark):
    # copies with 4 own words are 0.815 like the hub and 0.68 like each other
    rnd = random.Random(6)
    hub = [f"w{i}" for i in range(200)]
    rows = [(3000, " ".join(hub))]
    for i in range(3000):
        w = hub[:]
        for p in rnd.sample(range(5, 195), 4):
            w[p] = f"x{i}p{p}"
        rows.append((i, " ".join(w)))
    got = {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}

    def shingles(t):
        w = t.split()
        return {tuple(w[j : j + 5]) for j in range(196)}

    h = shingles(rows[0][1])
    linked = [i for i, t in rows if 100 * len(h & (s := shingles(t))) >= 80 * len(h | s)]
    assert len(linked) > 2900 and {i for i, c in got if c == min(linked)} >= set(linked)


def test_a_crowd_of_unlike_pairs(spark):
    # all share 170 shingles and are 0.773 alike or less; pairs among them are 0.814 alike
    common = [f"c{i}" for i in range(174)]
    rows = []
    for i in range(1200):
        own = [f"o{i // 2}n{j}" for j in range(14)]
        rows.append((i, " ".join(common + own + [f"e{i}n{j}" for j in range(14 + i % 2)])))
    got = {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for _, t in rows]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert alike(0, 1) >= 0.8 > 0.775 > alike(0, 2)
    assert got == {(i, i // 2 * 2) for i in range(1200)}


def test_no_pair_is_parted_by_a_partition(spark):
    # more partitions than regions: pairs just over the threshold, each of which must be found
    rnd = random.Random(8)
    rows = []
    for i in range(600):
        w = [f"w{rnd.randrange(10**9)}" for _ in range(104)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:50] + [f"z{i}a"] + w[51:70] + [f"z{i}b"] + w[71:]))]
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == {(i, i // 2 * 2) for i in range(1200)}


def test_pairs_just_above_the_threshold_are_found(spark):
    """In regions that aren't crowded: 400 pairs of similarity 0.802 to 0.83 among texts that are otherwise unlike."""
    rnd = random.Random(12)
    rows = []
    for i in range(400):
        w = [f"p{i}w{j}" for j in range(rnd.randrange(150, 400))]
        v = w[:]
        # words replaced far from each other: 5 shingles of each side go for one
        most = max(n for n in range(1, 40) if (len(w) - 4 - 5 * n) / (len(w) - 4 + 5 * n) >= 0.8)
        for j in range(most):
            v[3 + j * (len(w) // (most + 1))] = f"q{i}x{j}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    rnd.shuffle(rows)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=5, percent=80).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(400)) == 400

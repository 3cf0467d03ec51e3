import hashlib
import math
import random
import zlib

import pytest

from leakscan.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, owner string, len int"


def brute(rows, splice=True):
    own: dict = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [v[3:] for v in sorted(vs)] for c, vs in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9 if splice else 0
        built[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])
    node, kids, sums = {}, {}, {}
    for c, b in built.items():
        for d in range(len(b) + 1):
            node.setdefault(b[:d], []).append(c)
    for p in sorted(node, key=len, reverse=True):
        below = [sums[k] for k in kids.get(p, [])]
        size = len(p[-1][1].encode()) if p else 0
        sums[p] = (sum(x for x, _ in below) or 1, sum(y for _, y in below) + (len(node[p]) - 1) * size)
        if p:
            kids.setdefault(p[:-1], []).append(p)
    return sorted((min(m), len(p), min(node[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *sums[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == p).encode()).hexdigest()) for p, m in node.items())


def rows():
    rnd = random.Random(5)
    out = [(c, rnd.choice([None, 0, 1, 2, 3, 4]), rnd.choice(["u", None, "a", ""]), rnd.choice(["x", "yé", None, "", "zz"])) for c in [*range(-8, 30), None] for _ in range(rnd.randrange(1, 9))]
    # a third of all conversations alike, and long ones that part late
    return out + [(c, i, "u", "alike") for c in range(100, 120) for i in range(3)] + [(500 + 5 * k, i, "u", "long") for k in range(4) for i in range(50 + k)]


def trie(spark, x, **how):
    df = spark.createDataFrame([(*r, 0, "o", 1) for r in x], SCHEMA)
    return sorted(map(tuple, prefix_trie.conversation_trie(df, **how).collect()))


@pytest.mark.parametrize("span", [4096, 7])
def test_against_brute_force(spark, monkeypatch, span):
    monkeypatch.setattr(prefix_trie, "SPAN", span)
    key = lambda r: r[:2]
    assert sorted(trie(spark, rows(), family=5, most=9), key=key) == sorted(brute(rows()), key=key)


def test_without_splicing_and_repeated_rows(spark):
    x = [(7, 0, "u", "a"), (7, 0, "u", "a"), (3, None, None, None), (9, 0, "u", "a"), (9, 1, "u", "a"), (9, 2, "u", "b")]
    assert trie(spark, x) == sorted(brute(x, splice=False))


def test_empty(spark):
    assert trie(spark, [], family=5, most=9) == []
    assert trie(spark, [(None, 0, "u", "a")], family=5, most=9) == []


def test_ends_in_pieces(spark):
    members = spark.createDataFrame([(1, 0, i) for i in range(120_000)] + [(2, 3, 5)], "owner long, depth long, conv_id long")
    got = {(r.owner, r.depth): r.ends_sha256 for r in prefix_trie._ends(members).collect()}
    assert got == {(1, 0): hashlib.sha256(",".join(map(str, range(120_000))).encode()).hexdigest(), (2, 3): hashlib.sha256(b"5").hexdigest()}

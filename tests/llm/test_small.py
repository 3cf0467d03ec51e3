import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from leakscan.llm import decontaminate, embedding_dedup, id_coder, mixing, piece_tokenizer, quality, sharding, token_output, url_filter
from leakscan.llm.queries import tokenizer_path

TEXT = "doc_id long, text string, item_id int, key string"


def test_contained_items(spark):
    item = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"z{i}" for i in range(20000))
    docs = spark.createDataFrame([(1, f"{long} {item.upper()} {long}", 1, "x"), (2, item.replace("w20", "q"), 1, "x"), (3, " ".join(item.split()[:30]), 1, "x"), (4, None, 1, "x"), (5, "", 1, "x"), (6, "a b", 1, "x"), (None, item, 1, "x"), (7, item, 1, "x"), (7, item, 1, "x")], TEXT)
    items = spark.createDataFrame([(10, item), (11, None), (12, " "), (13, "A b"), (None, item)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.contained_items(docs, items).collect())
    want = Counter()
    for i in (10, None):
        want.update([(1, i, 36, 36), (2, i, 36, 31), (None, i, 36, 36), (7, i, 36, 36), (7, i, 36, 36)])
    want[(6, 13, 1, 1)] = 1
    assert got == want
    assert decontaminate.contained_items(docs, items.limit(0)).collect() == [] == decontaminate.contained_items(docs.limit(0), items).collect()
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == {3, 4, 5, None} and decontaminate.clean(docs, items).columns == docs.columns


def test_items_of_few_words(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, "THREE four"), (3, "four three"), (4, "three\tfour five six"), (5, ""), (6, "eight")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "three four five six"), (2, "Three  four"), (3, "eight"), (4, "one two three four five"), (5, "seven nine")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, items).collect()}
    assert got == {(1, 1), (4, 1), (1, 2), (2, 2), (4, 2), (1, 3), (6, 3), (1, 4)}


def test_more_items_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 60)
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{j}" for j in range(40))) for i in range(5)], "item_id long, text string")
    assert decontaminate.contained_items(items.withColumnRenamed("item_id", "doc_id"), items).count() == 5


def test_urls_against_every_rule(spark):
    rnd = random.Random(2)
    hosts = ["net", "org", "a.net", "b.a.net", "xnet", "a-b.net", "A.NET", "net:80", ""]
    rules = [(h.lower(), p, rnd.choice(["allow", "block"])) for h in hosts[:6] for p in rnd.sample(["", "/", "/en/", "/en/x"], 2)]
    urls = [None, "", "no scheme", "http://", "http://net", "http://a.net/en/x?u=http://b", "http://a.net#/en/"] + [f"{rnd.choice(['http', 'x'])}://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en/', '/en/xy', '/e', '/EN/'])}{rnd.choice(['', '?q', '#f'])}" for _ in range(400)]
    pages = spark.createDataFrame([(i % 390, u, "h", "k") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    want = Counter()
    for i, u in enumerate(urls):
        rest = (u or "").partition("://")[2]
        host = re.match("[^/?#]*", rest)[0]
        path, host = re.match("[^?#]*", rest[len(host) :])[0], host.lower()
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = min(fit, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2]), default=None)
        want[(i % 390, host, path, best and best[0] + best[1], best[2] if best else "allow")] += 1
    assert Counter(map(tuple, got)) == want


def test_tokens_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [(5, "Hello  world\n\n x"), (1, None), (2, ""), (3, "it's <|endoftext|> é　 ٣"), (None, "null id"), (5, "Hello  world\n\n x"), (4, "ab " * 9000)]
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], TEXT)
    tok, at, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_output.token_table(token_output.write_tokens(df, tokenizer_path())).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_output.token_table(token_output.write_tokens(df.limit(0), tokenizer_path())).collect() == []


def test_start_follows_the_file(spark, monkeypatch):
    monkeypatch.setattr(token_output, "LANES", 1)
    monkeypatch.setattr(token_output, "TEXTS", 1)
    df = spark.createDataFrame([(5, t) for t in ("a b c", "a", "a b c d e f", "a b")] + [(6, "x"), (6, "x y"), (None, "q r")], "doc_id long, text string")
    chunks = token_output.write_tokens(df, tokenizer_path())
    rows = sorted(chunks.collect(), key=lambda r: (r.part, r.seq))
    assert [d for r in rows for d in r.docs] == [None, 5, 5, 5, 5, 6, 6]
    at, want = 0, []
    for r in rows:
        for d, ids in zip(*token_output.read_ids(r.asDict()), strict=True):
            want.append((d, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            at += len(ids)
    assert sorted(map(tuple, token_output.token_table(chunks).collect()), key=lambda r: r[1]) == want


def test_blocks_round_trip():
    rng = np.random.RandomState(3)
    words = [rng.randint(0, 65536, rng.randint(1, 6)) for _ in range(400)]
    text = np.concatenate([words[i] for i in (rng.zipf(1.3, 30000) % 400)]).astype(np.int32)
    blocks = [text[i : i + id_coder.BLOCK] for i in range(0, len(text), id_coder.BLOCK)]
    n = id_coder.BLOCK
    blocks += [np.full(n, 65535, np.int32), rng.randint(0, 65536, n).astype(np.int32), np.arange(1, dtype=np.int32), np.arange(n, dtype=np.int32) % 3]
    for some in (blocks, blocks[-2:-1], [np.arange(9, dtype=np.int32)]):
        data = id_coder.encode_blocks(some)
        assert all((a == b).all() for a, b in zip(id_coder.decode_blocks(data, np.array([len(b) for b in some])), some, strict=True))
        # a block is decoded alone just as well
        (x,) = id_coder.decode_blocks(data[-1:], np.array([len(some[-1])])) if len(some[-1]) == len(some[0]) else [some[-1]]
        assert (x == some[-1]).all()
    assert sum(map(len, id_coder.encode_blocks(blocks[: len(text) // id_coder.BLOCK]))) < len(text)


def test_damaged_block():
    ids = np.arange(300, dtype=np.int32) * 7 % 50000
    row = {"lens": [300], **token_output.pack([1], [300], ids)}
    assert (token_output.read_ids(row)[1][0] == ids).all()
    b = row["blocks"][0]
    # the last bytes of a stream say more than its end needs
    for at in range(6, len(b) // 2, 17):
        row["blocks"] = [b[:at] + bytes([b[at] ^ 1]) + b[at + 1 :]]
        with pytest.raises(ValueError, match="checksum"):
            token_output.read_ids(row)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 50, 1000])
def test_shards(spark, n):
    rnd = random.Random(n)
    rows = [(rnd.choice([None, 4, *range(2 * n)]), rnd.choice([None, "", "é", "x" * 50]), 1, "k") for _ in range(n)]
    df = spark.createDataFrame(rows, TEXT)
    got = sharding.shards(df).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    slots = [sorted(r.slot for r in got if r.shard == s) for s in range(8)]
    assert all(s == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1
    again = sharding.shards(df.repartition(3)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_permutation_is_scattered(spark):
    n = 1000
    from pyspark.sql import functions as F

    p = [r[0] for r in spark.range(n).coalesce(1).select(sharding.permuted(F.col("id"), n)).collect()]
    assert sorted(p) == list(range(n)) and sum(abs(a - b) == 1 for a, b in zip(p, p[1:], strict=False)) < 20


def test_mix(spark):
    rnd = random.Random(4)
    rows = [(i % 700, rnd.choice([None, "", "a b\tc", "w " * rnd.randrange(60)]), 1, rnd.choice([None, "hot", "hot", "b", "c", "Z"])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, taken int, source string")
    got = mixing.mix(df).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    took, goal = Counter(), {}
    for r in got:
        took[r.source] += r.taken
        goal[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size == sizes[r.source]
    assert sum(goal.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(abs(took[s] - goal[s]) <= 60 and goal[s] <= 2 * sizes[s] for s in sizes)
    assert mixing.mix(df.limit(0)).collect() == []
    assert mixing.mixed(df).columns == df.columns
    odd = df.selectExpr("doc_id", "text", "source", "taken AS times", "'a' AS _times", "1 AS row", "2 AS `size`", "3 AS `target`")
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd).count() == mixing.mixed(df).count()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    assert quality.scores(docs, labels).collect() == [] and mixing.mixed(docs).collect() == []
    assert url_filter.judge_urls(pages.limit(0), rules).collect() == []
    assert [tuple(r) for r in url_filter.judge_urls(pages, rules.limit(0)).collect()] == [(1, "a.net", "/x", None, "allow")]


def test_quality_odd_rows(spark):
    rows = [(i, ("GOOD " if i % 2 else "bad### ") * (i % 9 + 1), 1, "k") for i in range(100)] + [(None, "x", 1, "k"), (200, None, 1, "k"), (201, "", 1, "k"), (201, "", 1, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, label string")
    labels = spark.createDataFrame([(i, i % 2 if i % 10 else None, 1) for i in range(100)] + [(None, 1, 1), (999, 1, 1)], "doc_id long, quality int, text int")
    got = quality.scores(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 100)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert {r.score for r in quality.scores(df, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(df, labels).columns == df.columns


def test_vectors(spark):
    rnd = np.random.RandomState(0)
    base = rnd.randn(20, 16)
    rows = [(i, [float(v) for v in base[i % 20] + rnd.randn(16) * 0.2]) for i in range(300)]
    rows += [(400 + i, rows[3][1]) for i in range(30)] + [(500, None), (501, [0.0] * 16), (502, [math.nan] * 16), (503, [1.0, None]), (None, rows[3][1]), (504, []), (505, [1.0, 2.0])]
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, id int")).collect()}
    ids = [i for i, v in rows if i is not None and v and len(v) == 16 and np.isfinite(v).all() and any(v)]
    x = np.array([dict(rows)[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    found = sum(got[i].n_links for i in ids)
    assert all(got[i].n_links <= near[k].sum() for k, i in enumerate(ids)) and found >= 0.97 * near.sum()
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (500, 501, 502, 503, None, 504, 505))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values() if r.vec_id is not None)


def vectors_by_brute_force(rows):
    """(vec_id, n_links, component_id, kept) of valid vectors of one length."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    up = {i: i for i in ids.tolist()}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in zip(*np.nonzero(near), strict=True):
        p, q = sorted((root(int(ids[a])), root(int(ids[b]))))
        up[q] = p
    return sorted((int(i), int(n), root(int(i)), root(int(i)) == i) for i, n in zip(ids, near.sum(axis=1), strict=True))


@pytest.mark.parametrize("sizes", [(8192, 8192), (40, 25)])
def test_vector_components(spark, monkeypatch, sizes):
    monkeypatch.setattr(embedding_dedup, "TILE", sizes[0])
    monkeypatch.setattr(embedding_dedup, "BLOCK", sizes[1])
    rnd = np.random.RandomState(7)
    turn = lambda a: [math.cos(math.radians(a)), math.sin(math.radians(a)), 0.0]
    # linked through a third of a greater id; a chain round the circle in a random order; stars in a space of more dimensions
    star = rnd.randn(6, 3) * 40
    small = [(1, turn(0)), (2, turn(48)), (5, turn(24))]
    chain = [(int(i), [*turn(k * 1.7)[:2], 5.0]) for k, i in enumerate(rnd.permutation(200) + 10)]
    stars = [(300 + i, [float(v) for v in star[i % 6] + rnd.randn(3) * 9]) for i in range(300)]
    repeats = [(300, stars[7][1]), (300, stars[8][1]), (11, stars[0][1])]
    for rows in (small, small + chain + stars):
        df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, comp string")
        assert sorted(map(tuple, embedding_dedup.near_vectors(df).collect())) == vectors_by_brute_force(rows)
    df = spark.createDataFrame(small + repeats, "vec_id long, embedding array<double>")
    got = embedding_dedup.near_vectors(df).collect()
    # rows of one id are one vector to the components
    assert sorted((r.vec_id, r.component_id) for r in got)[:3] == [(1, 1), (2, 1), (5, 1)] and len(got) == 6
    assert len({r.component_id for r in got if r.vec_id == 300}) == 1
    assert embedding_dedup.near_vectors(df.limit(0)).collect() == []


def test_vectors_near_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 200, raising=False)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 300)
    rnd = np.random.RandomState(1)
    x = rnd.randn(3000, 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rnd.randn(3000, 64)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.902 * x + (1 - 0.902**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    v = np.concatenate([x, y])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect()}
    assert ((v @ v.T >= 0.9).sum(axis=1) == 2).all()
    assert got == {(i, 1, i % 3000) for i in range(6000)}


def test_tokenizer_cuts_where_the_library_does():
    tok = piece_tokenizer.PieceTokenizer(tokenizer_path())
    tok.KEPT = 300
    rng = random.Random(5)
    parts = [*"abzAéßÀÿ×÷µªĀα漢ー١½ ,.%&#\n\t\r\x0b\x1c\x1f\x85\xa0᠎\u2003\u3000\u2028́'!_0s😀\x00", "'s", "'ll", " the", "  ", "\n\n", "\n ", " \n", "<|endoftext|>", "<|", "a" * 60]
    for _ in range(300):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(20)]
        want = [tok.tok.encode(t, add_special_tokens=False).ids for t in texts]
        raw = [t.encode() for t in texts]
        ids, counts = tok.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_vectors_of_one_id(spark):
    a, b, c = [1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (5, a), (8, None)]
    got = sorted(map(tuple, embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    # 3, 5 and 7 hang together over the two vectors of 5
    assert got == [(3, 2, 3, True), (5, 1, 3, False), (5, 2, 3, False), (5, 2, 3, False), (7, 1, 3, False), (8, 0, 8, True), (9, 0, 9, True)]


def test_vectors_with_links_against_brute_force(spark):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(12, 8))
    rows = [(int(i), (base[i % 12] + rnd.normal(size=8) * 0.25).tolist()) for i in rnd.permutation(150)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    ids, up = [i for i, _ in rows], list(range(150))
    for _ in range(150):
        up = [min((up[j] for j in np.flatnonzero(near[i])), key=lambda r: ids[r]) for i in range(150)]
    want = sorted((ids[i], int(near[i].sum()) - 1, ids[up[i]], ids[up[i]] == ids[i]) for i in range(150))
    got = sorted(map(tuple, embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == want and sum(n for _, n, _, _ in got) > 100


def test_every_byte_of_a_block_is_checked():
    ids = np.arange(300, dtype=np.int32) * 7 % 50000
    row = {"lens": [300], **token_output.pack([1], [300], ids)}
    b = row["blocks"][0]
    for at in range(len(b)):
        row["blocks"] = [b[:at] + bytes([b[at] ^ 1]) + b[at + 1 :]]
        with pytest.raises(ValueError, match="checksum"):
            token_output.read_ids(row)


def test_blocks_are_decoded_in_fewer_steps_than_ids(monkeypatch):
    steps, get = [], id_coder._Decoder.get
    monkeypatch.setattr(id_coder._Decoder, "get", lambda self, m: steps.append(m) or get(self, m))
    ids = np.arange(2 * id_coder.BLOCK, dtype=np.int32) % 50
    blocks = [ids[: id_coder.BLOCK], ids[id_coder.BLOCK :]]
    got = id_coder.decode_blocks(id_coder.encode_blocks(blocks), np.array([id_coder.BLOCK] * 2))
    assert all((a == b).all() for a, b in zip(got, blocks, strict=True))
    assert len(steps) < id_coder.BLOCK / 4


def test_tokenizer_keeps_the_latest_pieces(monkeypatch):
    tok = piece_tokenizer.PieceTokenizer(tokenizer_path())
    tok.KEPT = 10
    raw = ("Ça va, naïve café × ÷ it's 12ab" + "".join(f" w{chr(97 + i)}é{chr(97 + i)}" for i in range(20))).encode()
    text = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    want = tok.tok.encode(raw.decode(), add_special_tokens=False).ids
    assert tok.encode(*text)[0].tolist() == want
    new, add = [], tok.add
    monkeypatch.setattr(tok, "add", lambda x: new.append(len(x)) or add(x))
    assert tok.encode(*text)[0].tolist() == want and len(tok.known) > tok.KEPT
    assert sum(new) == 0

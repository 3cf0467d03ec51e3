import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from leakscan.llm.queries import tokenizer_path

from .test_near_dedup import brute as near_brute

SF = "/root/testdata/sf0.01"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(docs.collect())
        if i < 4:
            assert docs.columns == columns
    raw, good, single, clean, mixed, tokens = seen
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r.doc_id for r in raw if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    kept = {r.doc_id for r in good}
    assert sum((d in kept) == (labels[d] == 1) for d in held) >= 0.97 * len(held)
    assert {r.doc_id for r in single} == {i for i, _, _, keep in near_brute([(r.doc_id, r.text) for r in good], 5) if keep}
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r.doc_id for r in single if not any(100 * len(s & shingles(r.text)) >= 80 * len(s) for s in items)}
    assert {r.doc_id for r in clean} == want and len(clean) == len(want) < len(single)
    sizes, took = defaultdict(int), defaultdict(int)
    for r in clean:
        sizes[r.source] += len(words(r.text))
    for r in mixed:
        took[r.source] += len(words(r.text))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    left, goal, live = 1.5 * sum(sizes.values()), {}, set(sizes)
    while live:
        unit = left / sum(weight[s] for s in live)
        full = {s for s in live if unit * weight[s] > 2 * sizes[s]}
        for s in full or live:
            goal[s] = 2 * sizes[s] if full else unit * weight[s]
            left -= goal[s] if full else 0
        live -= full or live
    longest = max(len(words(r.text)) for r in clean)
    assert all(abs(took[s] - goal[s]) <= longest / 2 + 1 for s in sizes)
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2
    tok, at = Tokenizer.from_file(tokenizer_path()), 0
    got = sorted(map(tuple, tokens))
    for r, g in zip(sorted(mixed, key=lambda r: r.doc_id), got, strict=True):
        ids = [*tok.encode(r.text, add_special_tokens=False).ids, 2]
        assert g == (r.doc_id, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        at += len(ids)


def test_run_on_odd_rows_and_an_empty_table(spark, tmp_path):
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = docs.orderBy("doc_id").first().text
    odd = [(None, "null id " * 30), (None, None), (900001, None), (900002, ""), (900003, " \n\t"), (900004, text), (900004, text), (900005, "x" * 300_000), (900005, "other text of the same id")]
    odd = spark.createDataFrame([(d, t, "en", None, None) for d, t in odd], docs.schema)
    own = docs.unionByName(odd).selectExpr("*", "1 AS size", "'k' AS key", "0.5D AS score", "doc_id AS component_id", "array(1) AS ids", "'w' AS words")
    for name, x in (("full", own), ("none", own.limit(0))):
        x.write.parquet(str(tmp_path / name / "documents.parquet"))
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(tmp_path / name / f"{t}.parquet"))
    got = sorted(corpus_pipeline.run(spark, str(tmp_path / "full")).collect(), key=lambda r: r.start)
    tok, texts = Tokenizer.from_file(tokenizer_path()), defaultdict(set)
    for r in own.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        texts[r.doc_id].add((len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in texts[r.doc_id]
        at += r.n_tokens
    # the copy of the first document goes, and no document is there more often than twice a row
    ids = Counter(r.doc_id for r in got)
    assert 900004 not in ids and len(ids) > 50 and max(n for d, n in ids.items() if d is not None and d < 900000) <= 2
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []

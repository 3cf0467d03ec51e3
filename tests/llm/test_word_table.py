import hashlib
from collections import Counter

import pytest

from leakscan.llm import word_table
from leakscan.llm.queries import QUERIES, word_tokenizer_path

ROWS = [
    (-1, None),
    (-2, ""),
    (-3, "a<|startoftext|>b <|ENDOFTEXT|> x,y <|endoftext|>."),
    (-4, "İİ ß ﬁ é é, don't 'S l'été 's\x00\x85 x　٣ 1⃣ × ÷."),
    (-5, "日本語、テスト。"),
    (-6, "  \n"),
    (None, "null id, x"),
    (-7, "ab! " * 20000),
    (-8, "x" * 100000 + " y"),
    (-8, "≠ ́a ̸, Σας ΣΑΣ, ΑΣ'"),
    (-8, "≠ ́a ̸, Σας ΣΑΣ, ΑΣ'"),
]
SCHEMA = "doc_id long, text string, ids string, block int, words string"


@pytest.fixture
def docs(spark):
    more = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    return spark.createDataFrame([(d, t, "k", 1, "w") for d, t in ROWS + more], SCHEMA)


def library(rows):
    from tokenizers import Tokenizer

    tok, out = Tokenizer.from_file(word_tokenizer_path()), Counter()
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        out[(d, tuple(ids), tok.decode(ids, skip_special_tokens=False))] += 1
    return out


@pytest.mark.parametrize("block", [word_table.BLOCK, 30_000])
def test_equals_the_library(spark, docs, monkeypatch, block):
    monkeypatch.setattr(word_table, "BLOCK", block)
    monkeypatch.setattr(word_table, "TEXTS", min(block, word_table.TEXTS))
    monkeypatch.setattr(word_table, "LOOKUP", min(block, word_table.LOOKUP))
    got = word_table.decode(word_table.encode(docs, word_tokenizer_path()), word_tokenizer_path()).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in got) == library([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table_and_odd_ids(spark, docs):
    path = word_tokenizer_path()
    assert word_table.decode(word_table.encode(docs.limit(0), path), path).collect() == []
    odd = spark.createDataFrame([(1, [320, None, -5, 999999, 49407], "x"), (2, None, "x"), (3, [], "x")], "doc_id long, ids array<int>, text string")
    assert sorted((r.doc_id, r.text) for r in word_table.decode(odd, path).collect()) == [(1, "a</w> <|endoftext|>"), (2, ""), (3, "")]


def test_other_tokenizers_are_refused(spark, docs):
    import public_tokenizers

    with pytest.raises(ValueError, match="across words"):
        word_table.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    want = Counter()
    for (d, ids, text), n in library([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]).items():
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want[(d, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += n
    assert Counter(map(tuple, QUERIES["op11_word_bpe"](spark, sf).collect())) == want

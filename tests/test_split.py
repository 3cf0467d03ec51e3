import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from leakscan.sources import split
from leakscan.sources.split import read_csv_split, read_json_split

RND = random.Random(1)
VALUES = ["", "x", 'say "hi"', "a,b", "l1\nl2", "l1\r\nl2\n\n", 'é}{][\\"\\', "\n", '"', "z" * 40, '[{"a":1}]']
ROWS = [(i, RND.choice(VALUES), RND.choice(VALUES)) for i in range(120)]
RECORDS = [{"a": i, "b": RND.choice(VALUES), "n": {"x": [{"y": RND.choice(VALUES)}]}} for i in range(60)]
OBJECT = "a int, b string, n struct<x: array<struct<y: string>>>"
key = lambda r: tuple(map(str, r))


@pytest.fixture
def ranges(spark):
    """Sets how long ranges are."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def put(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield put
    for n, v in before.items():
        spark.conf.set(n, v)


def write(path, rows, head=("a", "b", "c"), bom="", end="\r\n", strip=False):
    s = io.StringIO()
    w = csv.writer(s, lineterminator=end)
    w.writerows([head, *rows] if head else rows)
    text = bom + s.getvalue()
    path.write_bytes((text.rstrip("\r\n") if strip else text).encode())


@pytest.mark.parametrize("size", [61, 500, 1 << 20])
def test_csv(spark, tmp_path, ranges, size):
    write(tmp_path / "a.csv", ROWS[:80], bom="﻿")
    write(tmp_path / "b.csv", [(y, x) for x, y, _ in ROWS[80:]], head=("b", "a"), end="\n")
    write(tmp_path / "c.csv", [(*r, "unused") for r in ROWS[:3]], head=("a", "b", "c", "d"), strip=True)
    ranges(size)
    want = [(i, b or None, c or None) for i, b, c in ROWS[:80]] + [(i, b or None, None) for i, b, _ in ROWS[80:]] + [(i, b or None, c or None) for i, b, c in ROWS[:3]]
    got = read_csv_split(spark, str(tmp_path), "a int, b string, c string", file="f")
    assert got.rdd.getNumPartitions() > (10 if size == 61 else 2)
    got = got.collect()
    assert sorted([tuple(r)[:3] for r in got], key=key) == sorted(want, key=key)
    assert sum(r.f.endswith("b.csv") for r in got) == 40


def test_csv_equals_the_single_task_reader(spark, tmp_path, ranges):
    x = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    x.repartition(1).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(str(tmp_path / "c"))
    schema = "conv_id long, turn long, role string, text string"
    want = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c")).collect()
    ranges(20_000)
    got = read_csv_split(spark, str(tmp_path / "c"), schema)
    assert sorted(got.collect()) == sorted(want) == sorted(x.collect())


def test_csv_without_header_and_odd_files(spark, tmp_path):
    write(tmp_path / "a.csv", ROWS[:5], head=None)
    assert read_csv_split(spark, str(tmp_path / "a.csv"), "a int, b string, c string", header=False).count() == 5
    for name, text in (("empty", ""), ("head", "a,b\r\n"), ("blank", "\n\na,b\n\n")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    for name in ("empty", "head"):
        assert read_csv_split(spark, str(tmp_path / f"{name}.csv"), "a int, b string").collect() == []
    (tmp_path / "bad.csv").write_text('a\n"x\n')
    with pytest.raises(ValueError, match="quoted"):
        read_csv_split(spark, str(tmp_path / "bad.csv"), "a string")


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("size", [211, 1 << 20])
def test_json(spark, tmp_path, ranges, indent, size):
    docs = {
        "array": RECORDS,
        "map": {f'k}}{i}"': r for i, r in enumerate(RECORDS)},
        "doc": {"meta": {"n": 1, "o": {"a": -1}, "s": '}"', "persons": [{"a": -2}]}, "note": "}persons", "list": [{"a": -3}], "persons": RECORDS, "after": {"z": [{"a": -4}]}, "m": {"q}": RECORDS[0], "r": RECORDS[1]}, "k": 5},
    }
    for name, d in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(d, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
    ranges(size)
    plain = [(r["a"], r["b"], r["n"]["x"][0]["y"]) for r in RECORDS]

    def rows(name, **how):
        x = read_json_split(spark, str(tmp_path / f"{name}.json"), OBJECT, **how)
        return sorted(map(tuple, x.select(*(["key"] if "key" in x.columns else []), "a", "b", F.col("n.x")[0]["y"]).collect()), key=key)

    assert rows("array") == sorted(plain, key=key)
    assert rows("map", key="key") == sorted([(k, *p) for k, p in zip(docs["map"], plain, strict=True)], key=key)
    assert rows("doc", field="persons") == sorted(plain, key=key)
    assert rows("doc", field="m", key="key") == sorted([("q}", *plain[0]), ("r", *plain[1])], key=key)
    assert rows("doc", field="absent") == []


def test_json_that_breaks_off(spark, tmp_path):
    for text in ('[{"a":1},{"a":2', '[{"a":1}', '{"x":"'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(ValueError, match="ends inside"):
            read_json_split(spark, str(tmp_path / "bad.json"), "a int")
    (tmp_path / "none.json").write_text("[]")
    assert read_json_split(spark, str(tmp_path / "none.json"), "a int").collect() == []


def test_many_ranges_by_a_shuffle(spark, tmp_path, ranges, monkeypatch):
    monkeypatch.setattr(split, "RANGES", 1)
    write(tmp_path / "a.csv", ROWS[:40])
    (tmp_path / "a.json").write_text(json.dumps({"n": {"o": 1}, "p": RECORDS}))
    ranges(300)
    got = read_csv_split(spark, str(tmp_path / "a.csv"), "a int, b string, c string").collect()
    assert sorted(map(tuple, got), key=key) == sorted([(i, b or None, c or None) for i, b, c in ROWS[:40]], key=key)
    assert sorted(r.a for r in read_json_split(spark, str(tmp_path / "a.json"), OBJECT, field="p").collect()) == list(range(60))


def test_files_of_plain_lines_are_parsed_by_column(spark, tmp_path, ranges):
    rows = [(i, RND.choice(["", "x", 'say "hi"', "a,b", "é}{", '"', " y "]), "a,b,c") for i in range(300)]
    for d in ("plain", "model=x", "cr", "blank", "mixed", "same"):
        (tmp_path / d).mkdir()
    for d in ("plain", "model=x", "mixed"):
        write(tmp_path / d / "a.csv", rows[:200], bom="﻿", end="\n")
    write(tmp_path / "plain" / "b.csv", rows[200:], bom="﻿", end="\n", strip=True)
    write(tmp_path / "mixed" / "b.csv", [(b, a, c) for a, b, c in rows[200:]], head=("b", "a", "c"), end="\n")
    write(tmp_path / "cr" / "a.csv", [(1, "x", "y\rz"), (2, "u", "v")], end="\n")
    (tmp_path / "blank" / "a.csv").write_text("a,b,c\n  \n1,2,3\n\n")
    # a row like the header is a row
    (tmp_path / "same" / "a.csv").write_text("b,a,b,model\nb,a,b,model\nx,3,y,z\n")
    read = lambda d, s="a int, b string, c string": read_csv_split(spark, str(tmp_path / d), s, file="f")
    python = lambda x: "MapInArrow" in x._jdf.queryExecution().executedPlan().toString()
    want = sorted([(a, b or None, c) for a, b, c in rows], key=key)
    for size in (200, 1 << 20):
        ranges(size)
        for d, slow in (("plain", False), ("mixed", True)):
            x = read(d)
            assert python(x) == slow and sorted([tuple(r)[:3] for r in x.collect()], key=key) == want
        x = read("plain")
        assert x.rdd.getNumPartitions() > 20 or size > 200
        assert {r.f.rsplit("/", 1)[1] for r in x.select("f").distinct().collect()} == {"a.csv", "b.csv"}
        assert "ReadSchema: struct<_column1:string>" in x.groupBy("b").count()._jdf.queryExecution().toString()
    assert read("model=x", "a int, model string").where("model IS NULL").count() == 200
    assert python(x := read("cr")) and sorted(tuple(r)[:3] for r in x.collect()) == [(1, "x", "y\rz"), (2, "u", "v")]
    assert python(x := read("blank")) and x.count() == 2
    assert not python(x := read("same", "a int, b string")) and sorted([tuple(r)[:2] for r in x.collect()], key=key) == [(3, "x"), (None, "b")]

import os
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from leakscan import dims as D
from leakscan.functions.text import hashed
from leakscan.operators import answers, corpus, heldout, metrics, probes, sweeps, views
from leakscan.plans import queries as audit
from leakscan.plans import sql
from leakscan.sources import records, reports
from leakscan.streaming import incremental

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def plain(x: pd.DataFrame) -> list:
    def one(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA:
            return "null"
        return v if isinstance(v, str) else str(round(float(v), 9))

    return sorted(tuple(one(v) for v in r) for r in x[sorted(x.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_against_sql(spark, duck, name):
    got, want = audit.QUERIES[name](spark, SF).toPandas(), duck.sql(sql.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_aggregate_rule(spark):
    rates = dict(zip(D.CATEGORIES, (0.9, 0.1, 0.7, 0.3, 0.6, 0.2, 0.5), strict=True))
    rows = [("m", c, k, i < r * 100 and k == "zh2zh") for c, r in rates.items() for k in ("zh2zh", "en2zh") for i in range(100)]
    x = spark.createDataFrame(rows, "model string, category string, condition string, hit boolean")
    (r,) = metrics.summary(x).collect()
    assert r.aggregate_rwmer == pytest.approx(sum(rates[c] * D.RISK[c] for c in rates) / 7)
    assert metrics.summary(x.withColumn("hit", F.lit(False))).first().aggregate_rwmer == 0


def test_resume_and_remote(spark):
    p = audit.matrix(spark, SF).where("pid <= 3")

    def complete(batch):
        if any(r["template_id"] == "B4" and r["pid"] == 2 for r in batch):
            raise RuntimeError("no answer\nmore")
        return [r["expected"] for r in batch]

    x = answers.detect(answers.remote(p, "mine", complete, batch=12))
    got = x.groupBy("error").agg(F.count("*"), F.sum(F.col("hit").cast("int"))).collect()
    assert {r[0] for r in got} == {None, "no answer"} and sum(r[1] for r in got) == p.count()
    assert all(r[2] == (0 if r[0] else r[1]) for r in got)
    done = x.where("error IS NULL")
    left = probes.todo(p.withColumn("model", F.lit("mine")), done)
    assert left.count() == p.count() - done.count()


def test_readers_and_sinks(spark, tmp_path):
    csv = tmp_path / "a" / "records_x.csv"
    csv.parent.mkdir()
    csv.write_text('﻿model,category,condition,type,template_id,pid,hit,match_method,expected,output\nm,full_name,zh2zh,A,A1,1,True,exact,王伟,"two\nlines ""q"""\nm,full_name,zh2zh,A,A2,1,0,none,王伟,\n', encoding="utf-8")
    x = records.read_csv(spark, str(tmp_path), recursive=True)
    assert [(r.model, r.hit, r.output) for r in x.orderBy("template_id").collect()] == [("m", True, 'two\nlines "q"'), ("m", False, None)]
    assert records.read_csv(spark, str(tmp_path / "none.csv")).count() == 0
    found = reports.bundle(audit.records(spark, SF))
    assert [r["risk_band"] for r in found["summary"]] and len(found["per_category"]) == 14
    (path, *_) = reports.write_csvs(found, str(tmp_path / "out"))
    assert open(path, "rb").read(3) == b"\xef\xbb\xbf"
    reports.write_json(found, str(tmp_path / "out" / "results.json"))
    assert re.search("<table>", reports.page(found))
    x = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    assert {r.key for r in records.renamed_key(x, "a", "c").collect()} == {"b", "c"}
    with pytest.raises(Exception, match="exists"):
        records.renamed_key(x, "a", "b").collect()


def test_stream_equals_batch(spark, tmp_path):
    x = answers.simulate(audit.matrix(spark, SF), audit.MODELS).select("model", F.col("pid").cast("long").alias("pid"), "category", "condition", "template_id", "expected", "output")
    x.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        incremental.score_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {tuple(r) for r in incremental.rates(spark, str(tmp_path / "out")).select("model", "category", "condition", "mer", "n").collect()}
    assert got == {tuple(r) for r in metrics.mer_long(answers.detect(x)).collect()}


def test_sweeps_edges(spark):
    done = spark.createDataFrame([(1, 2)], "a int, b int")
    grid = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    assert [tuple(r) for r in sweeps.missing_cells(grid, done, ["a", "b"]).collect()] == [(1, 3)]


def test_views_on_odd_rows(spark):
    runs = spark.createDataFrame([("base", 0.5), ("top", 0.5), ("x", 0.7)], "key string, value double")
    (r,) = views.recovery(runs, "base", "top").collect()
    assert r.recovered is None and r.reading == "nothing to recover"
    rows = spark.createDataFrame([("m1", 3, True), ("m2", 1, False), (None, 2, True)], "model string, ordinal int, hit boolean")
    assert [x.model for x in views.matching(rows, "M1").collect()] == ["m1"]
    assert [x.model for x in views.matching(rows, "none").collect()] == ["m2"]
    assert views.matching(rows.limit(0), "m").count() == 0
    assert views.inspected(rows).count() == 3 and views.inspected(rows, hit=False).count() == 1
    with pytest.raises(ValueError):
        D.risk_index("full_name", [1.0])


def test_stratified_counts(spark):
    x = spark.range(1000).selectExpr("id", "CASE WHEN id < 700 THEN 'a' WHEN id < 999 THEN NULL ELSE 'c' END AS g")
    n = {r.g: r["count"] for r in probes.stratified(x, ["g"], F.col("id").cast("string"), fraction=0.1).groupBy("g").count().collect()}
    assert n == {"a": 70, None: 29, "c": 1}
    assert probes.stratified(x, ["g"], F.col("id").cast("string"), quota=5).count() == 11
    assert probes.stratified(x.limit(0), ["g"], F.col("id").cast("string"), quota=5).count() == 0


def test_dense_persons(spark):
    x = corpus.persons(spark.range(30).withColumnRenamed("id", "key"), "key").where("pid % 3 <> 1")
    assert sorted(r.pid for r in corpus.dense_persons(x, 15).collect()) == list(range(15))
    with pytest.raises(Exception, match="fewer than 40 persons"):
        corpus.dense_persons(x, 40).collect()
    with pytest.raises(Exception, match="check digit"):
        corpus.dense_persons(x.withColumn("unionpay_card", F.concat("unionpay_card", F.lit("1"))), 15).collect()


def test_pivot_ranks_and_verbatim(spark):
    x = spark.createDataFrame([("a", "c1", True), ("a", "c1", False), ("b", "c2", True)], "model string, category string, valid boolean")
    assert sorted(map(tuple, views.validity_pivot(x, ["a", "b", "c"]).collect())) == [("c1", 0.5, None, None), ("c2", None, 1.0, None)]
    x = spark.createDataFrame([("b", 0.3, None, "High"), ("a", 0.3, -0.01, "High"), ("c", 0.01, 0.0, "Low")], "model string, aggregate_rwmer double, mean_clmd double, risk_band string")
    got = sorted(map(tuple, views.ranked(x).collect()))
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(1, "a", "0.300", "-0.0100"), (2, "b", "0.300", "—"), (3, "c", "0.010", "+0.0000")]
    x = spark.createDataFrame([("m", "v1", "is v1"), ("m", "v1", None), ("m", "", "x")], "model string, expected string, output string")
    assert [tuple(r) for r in metrics.verbatim(x, "model").collect()] == [("m", 3, 1, 1 / 3)]


def test_values_of_two_corpora_flag_an_answer_once(spark):
    x = spark.createDataFrame([(1, "mobile_phone", "13912345678"), (2, "mobile_phone", "13912345670")], "pid long, category string, output string")
    train = spark.createDataFrame([("mobile_phone", "13912345678")] * 2, "category string, value string")
    got = heldout.flags(x, train.union(train))
    assert sorted((r.pid, r.leaks_training) for r in got.collect()) == [(1, True), (2, False)]
    assert heldout.rollup(got).where("category IS NULL").first().n == 2


@pytest.mark.parametrize("name", ["case_sample", "stratified_sample", "size_sensitivity", "replayed_answers", "quota_sample"])
def test_answers_are_not_broadcast(spark, name):
    plan = audit.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan()
    sent = [line for line in plan.toString().split("\n") if "BroadcastExchange" in line]
    # the places of the first persons alone, which are 140 at most
    assert len(sent) == (name == "size_sensitivity")


def test_quota_in_one_pass(spark):
    """Equal to a ranking of whole strata, of more rows than the quota in a slice and of fewer."""
    x = spark.range(3000).selectExpr("id", "CASE WHEN id < 2900 THEN 'a' WHEN id < 2999 THEN NULL ELSE 'c' END AS g")
    y = probes.stratified(x, ["g"], F.col("id").cast("string"), quota=40)
    whole = Window.partitionBy("g").orderBy(hashed(D.SEED, "draw", F.col("id").cast("string")), F.col("id").cast("string"))
    want = x.withColumn("r", F.row_number().over(whole)).where("r <= 40")
    assert sorted(r.id for r in y.collect()) == sorted(r.id for r in want.collect()) and y.columns == x.columns
    assert y._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_rates_of_a_tally_are_those_of_records(spark):
    r = audit.records(spark, SF).where("pid < 12 AND NOT (category = 'full_name' AND condition = 'en2zh')").withColumn("hit", F.when(F.col("ordinal") % 11 > 0, F.col("hit")))
    for of in (metrics.summary, metrics.scope_rates, metrics.paired_overall, metrics.per_category):
        assert plain(of(metrics.tally(r)).toPandas()) == plain(of(r).toPandas())
    # records are made for their tally, which is kept, and for their outputs
    made = views.profile(r)._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("customer.parquet") + made.count("c_custkey#") <= audit.records(spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("c_custkey#") + 1


def test_compressed_csv_is_read_whole(spark, tmp_path):
    x = spark.createDataFrame([("m", "two\nlines \"q\", and more", "True"), ("n", None, "False")] * 50, "model string, output string, hit string")
    records.write_csv(x, str(tmp_path / "x"), "gzip")
    assert any(f.name.endswith(".csv.gz") for f in (tmp_path / "x").iterdir())
    got = records.read_csv(spark, str(tmp_path / "x")).groupBy("model", "output", "hit").count().collect()
    assert sorted((r.model, r.output, r.hit, r["count"]) for r in got) == [("m", 'two\nlines "q", and more', True, 50), ("n", None, False, 50)]

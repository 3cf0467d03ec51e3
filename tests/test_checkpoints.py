import threading

import pytest
from pyspark.sql import functions as F

from leakscan.sources import checkpoints, stored

S = "key string, v int"


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def rows(spark, path, schema=S):
    return sorted(map(tuple, checkpoints.read_checkpoint(spark, path, schema).collect()), key=str)


def test_conditions_are_replaced(spark, path):
    put = lambda x, **how: checkpoints.write_checkpoint(spark.createDataFrame(x, S), path, **how)
    assert rows(spark, path) == []
    put([("a", 1), ("a", 2), ("b", 1), (None, 7), ("", 8), ("x/y=z", 9)])
    put([("a", 3)], conditions=["b"])
    assert rows(spark, path) == [("", 8), ("a", 3), ("x/y=z", 9), (None, 7)]
    put([("b", 5)])
    assert ("b", 5) in rows(spark, path)
    asked = spark.createDataFrame([("a", 0), ("b", 0), ("new", 0), (None, 0)], S)
    assert [r.key for r in checkpoints.todo(asked, path).collect()] == ["new"]


def test_a_write_that_breaks_off(spark, path):
    checkpoints.write_checkpoint(spark.createDataFrame([("a", 1)], S), path)
    bad = spark.createDataFrame([("a", 2), ("q", 1)], S).withColumn("v", F.when(F.col("key") == "q", F.raise_error(F.lit("stop")).cast("int")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="stop"):
        checkpoints.write_checkpoint(bad, path)
    assert rows(spark, path) == [("a", 1)]
    # rows without their log, as after a loss of the driver before the commit
    x = spark.createDataFrame([("a", 3)], S).withColumn("_slot", checkpoints._slot(F.col("key")))
    x.write.partitionBy("_slot").parquet(f"{path}/data/_write=lost")
    assert rows(spark, path) == [("a", 1)]


def test_writers_do_not_mix(spark, path):
    def one(i):
        checkpoints.write_checkpoint(spark.createDataFrame([("a", i)] * 3 + [(f"own{i}", i)], S), path)

    threads = [threading.Thread(target=one, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = rows(spark, path)
    assert len(got) == 7 and len({v for k, v in got if k == "a"}) == 1
    # writes of one number: the same one stands for all readers
    assert checkpoints.current(checkpoints.read_log(spark, path)).where("key = 'a'").count() == 1


def test_columns_of_several_writes(spark, path):
    checkpoints.write_checkpoint(spark.createDataFrame([("a", 1)], S), path)
    checkpoints.write_checkpoint(spark.createDataFrame([("b", "t")], "key string, w string"), path)
    got = checkpoints.read_checkpoint(spark, path)
    assert sorted((r.key, r.v, r.w) for r in got.collect()) == [("a", 1, None), ("b", None, "t")]


A = "model string, category string, pid long, hit boolean"


def test_data_source_pushes_filters_down(spark, path):
    x = spark.createDataFrame([(m, c, i, i % 2 == 0) for m in ("m1", "m2", None) for c in ("c1", "c2", None) for i in range(5)], A)
    checkpoints.write_checkpoint(x, path, "model")
    checkpoints.write_checkpoint(x.where("model = 'm1'").limit(7), path, "model")
    stored.register(spark)
    y = spark.read.format(stored.FORMAT).option("key", "model").option("schema", A).load(path)
    assert y.count() == 7 + 15 + 15
    z = y.where("model = 'm2' AND category IN ('c1', 'c2') AND pid > 1")
    assert sorted(map(tuple, z.collect())) == sorted(("m2", c, i, i % 2 == 0) for c in ("c1", "c2") for i in (2, 3, 4))
    plan = z._jdf.queryExecution().executedPlan().toString()
    kept = [line for line in plan.splitlines() if " Filter (" in line]
    assert all("model" not in k and "category" not in k for k in kept) and any("pid" in k for k in kept)
    reader = stored._Batch({"path": path, "key": "model"}, y.schema)
    every = len(reader.partitions())
    reader.slots = {stored._slot("m2")}
    assert 0 < len(reader.partitions()) < every
    assert y.where("category IS NULL AND model IS NULL").count() == 5


def test_stream_goes_on_at_its_offset(spark, path, tmp_path):
    stored.register(spark)

    def run():
        x = spark.readStream.format(stored.FORMAT).option("key", "model").option("schema", A).load(path)
        q = x.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.model, r.pid) for r in spark.read.schema(A).parquet(str(tmp_path / "out")).collect())

    put = lambda m, n: checkpoints.write_checkpoint(spark.createDataFrame([(m, "c", i, True) for i in range(n)], A), path, "model")
    put("a", 2)
    assert run() == [("a", 0), ("a", 1)]
    assert run() == [("a", 0), ("a", 1)]
    put("b", 1)
    put("a", 1)
    assert run() == [("a", 0), ("a", 0), ("a", 1), ("b", 0)]


def test_a_large_condition_is_written_by_many_tasks(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        x = spark.range(0, 60_000, 1, 8).selectExpr("id", "'a' AS key", "sha2(CAST(id AS STRING), 256) AS v")
        checkpoints.write_checkpoint(x, str(tmp_path / "t"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    y = checkpoints.read_checkpoint(spark, str(tmp_path / "t"))
    assert y.count() == 60_000 and len(y.inputFiles()) > 4

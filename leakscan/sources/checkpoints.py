"""Checkpoints of conditions that are replaced whole.

A table is a folder: data/ holds the rows, by write and by condition (a digest of the key), and log/ a small file
for each write that is complete, which names the conditions it wrote. That file, the only one of its job, appears when Spark commits the
job: before it a write has no effect, so one that breaks off leaves the old rows, and after it its conditions are
replaced. Of several writes of a condition the latest stands, whole, whoever else wrote meanwhile; writes do not share files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A condition's place in the log: the write, its number (later ones are greater; of one number the greater write stands), and its rows.
LOG = "version long, write string, key string, slot string, rows long"
#: Conditions up to this many (some 100 bytes each) are sent to each executor to pick their rows, and writes up to WRITES named to the scan.
CONDITIONS, WRITES = 500_000, 2000


def _slot(key: Column) -> Column:
    return F.coalesce(F.md5(key.cast("string").cast("binary")), F.lit("null"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Every complete write's conditions (LOG); no rows for a table that isn't there."""
    try:
        return spark.read.schema(LOG).option("recursiveFileLookup", True).json(f"{path}/log")
    except Exception as e:  # an absent folder is told by its class alone over either kind of session
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], LOG)
        raise


def current(log: DataFrame) -> DataFrame:
    """The log's rows that stand: the latest write of each condition."""
    w = Window.partitionBy("slot").orderBy(F.col("version").desc(), F.col("write").desc())
    return log.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def write_checkpoint(rows: DataFrame, path: str, key: str = "key", conditions: list | None = None) -> str:
    """Writes rows, which replace all earlier rows of their conditions (values of key); returns the write's name.

    conditions: replaced too if rows has none of theirs. Keys are told apart as text; null is a condition of its own.
    """
    spark, write = rows.sparkSession, uuid.uuid4().hex
    folder = f"{path}/data/_write={write}"
    slots = rows.withColumn("_slot", _slot(F.col(key)))
    # a condition's rows go to one task, a large one's to as many as its size asks for
    slots.hint("rebalance", "_slot").write.partitionBy("_slot").mode("error").parquet(folder)
    done = spark.read.schema(f"{_ddl(rows)}, _slot string").parquet(folder).groupBy(F.col(key).cast("string").alias("key"), F.col("_slot").alias("slot")).agg(F.count("*").alias("rows"))
    if conditions:
        named = spark.createDataFrame([(c,) for c in conditions], "key string").withColumn("slot", _slot(F.col("key"))).withColumn("rows", F.lit(0).cast("long"))
        done = named.unionByName(done).groupBy("key", "slot").agg(F.max("rows").alias("rows"))
    commit(done, path, write)
    return write


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema)


def commit(done: DataFrame, path: str, write: str) -> None:
    """Makes a write's conditions (key, slot, rows) stand: one file, named when the job is committed."""
    log = read_log(done.sparkSession, path)
    version = (log.agg(F.max("version")).first()[0] or 0) + 1
    x = done.select(F.lit(version).cast("long").alias("version"), F.lit(write).alias("write"), "key", "slot", "rows")
    # a folder of its own, as jobs that write to one folder at once clear away each other's files
    x.coalesce(1).write.mode("error").option("ignoreNullFields", False).json(f"{path}/log/{write}")


def read_checkpoint(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows that stand, in the columns of schema (or of all writes together); columns that a write lacks are null."""
    stand = current(read_log(spark, path)).where("rows > 0").select(F.col("write").alias("_write"), F.col("slot").alias("_slot"))
    writes = [r._write for r in stand.select("_write").distinct().limit(WRITES + 1).collect()]
    if schema is None:
        every = spark.read.option("mergeSchema", True).parquet(f"{path}/data")
        schema = _ddl(every.drop("_write", "_slot"))
    if not writes:
        return spark.createDataFrame([], schema)
    x = spark.read.schema(f"{schema}, _write string, _slot string").parquet(f"{path}/data")
    x = x.where(F.col("_write").isin(writes)) if len(writes) <= WRITES else x
    few = F.broadcast(stand) if stand.count() <= CONDITIONS else stand
    return x.join(few, ["_write", "_slot"], "left_semi").drop("_write", "_slot")


def todo(asked: DataFrame, path: str, key: str = "key") -> DataFrame:
    """Rows of asked whose condition has not been written."""
    done = current(read_log(asked.sparkSession, path)).select(F.col("slot").alias("_slot"))
    return asked.withColumn("_slot", _slot(F.col(key))).join(done, "_slot", "left_anti").drop("_slot")

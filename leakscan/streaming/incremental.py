"""Incremental scoring: record files as a stream, scored once each, into additive counts. An extension of the batch audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leakscan.operators.answers import detect
from leakscan.operators.probes import KEYS

ANSWERS = "model string, pid long, category string, condition string, template_id string, expected string, output string"


def score_stream(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Answers (parquet files below source) -> hits and n by cell and batch (parquet below sink). A probe counts once, as in resuming."""
    x = spark.readStream.schema(ANSWERS).parquet(source).dropDuplicates(KEYS)
    x = detect(x)

    def put(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("model", "category", "condition").agg(F.sum(F.col("hit").cast("int")).alias("hits"), F.count("*").alias("n"))
        # the batch's number is its folder, so a repeated batch replaces itself
        counts.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return x.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rates(spark: SparkSession, sink: str) -> DataFrame:
    x = spark.read.parquet(sink).groupBy("model", "category", "condition").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    return x.withColumn("mer", F.col("hits") / F.col("n"))

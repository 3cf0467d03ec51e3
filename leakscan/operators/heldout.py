"""Held-out probes: what is emitted, whether it is valid, recited from the corpus or new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan import dims as D
from leakscan.functions.checks import valid
from leakscan.functions.text import shape_of
from leakscan.operators.corpus import long


def train_values(people: DataFrame) -> DataFrame:
    return long(people, D.STRUCTURED).select("category", F.col("expected").alias("value")).distinct()


def shared_values(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values and names that two corpora share; must be empty for a held-out set."""
    return long(a).select("category", "expected").intersect(long(b).select("category", "expected"))


def flags(answers: DataFrame, train: DataFrame) -> DataFrame:
    """answers (category, output, ...) with extracted, well_formed, valid, recited, novel_valid, leaks_training. train (category, value) may repeat values."""
    c = F.col("category")
    got = F.coalesce(*[F.when(c == k, shape_of(k, F.col("output"))) for k in D.STRUCTURED])
    x = answers.withColumn("extracted", got)
    # a value that stands in two corpora must meet its answer once
    seen = train.select(F.col("category").alias("_c"), F.col("value").alias("_v")).distinct()
    x = x.join(seen, (c == F.col("_c")) & (F.col("extracted") == F.col("_v")), "left")
    known, good = F.col("_v").isNotNull(), F.coalesce(F.col("extracted").isNotNull() & valid(c, F.col("extracted")), F.lit(False))
    x = x.withColumn("well_formed", F.col("extracted").isNotNull()).withColumn("valid", good)
    return x.withColumn("recited", good & known).withColumn("novel_valid", good & ~known).withColumn("leaks_training", known).drop("_c", "_v")


def rollup(flagged: DataFrame) -> DataFrame:
    """By category and overall (category null): n, and the shares of well-formed, valid, recited, new and leaking answers."""
    share = lambda f: F.avg(F.col(f).cast("int")).alias(f"{f}_rate")
    useful = F.avg((F.col("valid") & ~F.col("leaks_training")).cast("int")).alias("valid_and_new_rate")
    return flagged.rollup("category").agg(F.count("*").alias("n"), F.sum(F.col("recited").cast("int")).alias("recited"), F.sum(F.col("novel_valid").cast("int")).alias("novel"), *map(share, ("well_formed", "valid", "recited", "novel_valid", "leaks_training")), useful)

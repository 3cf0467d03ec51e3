"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents are put in a random order by a hash of their id. The order is cut into
ranges by the leading hash digits; words are summed by range, the ranges' sums are accumulated
per source, and a running sum inside each range completes the distributed prefix sum. The mix takes every document as
often as its source's target goes whole into it, and then documents in that order up to the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscan.llm.common import WHITE, save

#: Weights of the sources in code point order, repeating; what the mix takes of all words; how often a source is taken at most.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sizes (source, source_size), one row a source: adds target, in words.

    The smallest level L such that the sum of min(L * weight, epochs * size) is the words asked for:
    sources are sorted by the level at which they are full, and the level is solved on the running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    x = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1))
    x = x.withColumn("most", F.col("source_size") * epochs)
    full = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    x = x.withColumn("before", F.sum("most").over(full.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("open", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
    x = x.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) * share - F.coalesce("before", F.lit(0))) / F.col("open"))
    # the level at the first source that is not full; where all are, the targets are the sizes times epochs
    x = x.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("level").alias("level")))).over(Window.partitionBy())["level"])
    target = F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("most").cast("double")), F.col("most").cast("double"))
    return x.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """What the mix takes of every row of docs (doc_id, text, source):
    doc_id, size, source_size, target, taken.

    Null texts have size 0; a null source is a source of its own, last in order. Repeated rows and
    rows of one doc_id and size are interchangeable; each counts. Targets are met to half a document.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    x = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), key.alias("key"))
    x = save(x.withColumn("range", F.substring("key", 1, 2)), "sizes", few=False)
    ranges = x.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    goal = targets(ranges.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, share, epochs)
    ranges = ranges.select("source", "range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    ranges = ranges.join(goal, ranges.source.eqNullSafe(goal.source)).select(ranges.source, "range", "start", "source_size", "target")
    ranges = save(ranges, "ranges")
    # each range of a source is sorted by itself
    within = Window.partitionBy("source", "range").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("run", F.coalesce(F.sum("size").over(within), F.lit(0)))
    x = x.join(ranges.withColumnsRenamed({"source": "s", "range": "r"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - rounds * F.col("source_size")
    one_more = F.col("start") + F.col("run") + F.col("size") / 2 <= rest
    times = (rounds + F.when(one_more & (rounds < epochs), 1).otherwise(0)).cast("long")
    return x.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), "source", "key", times.alias("times"))


def mixed(docs: DataFrame, **params) -> DataFrame:
    """docs with every row as often as the mix takes it; all columns stay. Rows of one doc_id are taken alike."""
    times = mix(docs, **params).groupBy("doc_id").agg(F.max("times").alias("times"))
    times = save(times.where("times > 0"), "times")
    # the columns travel as one, so that their names don't matter
    row = docs.select("doc_id", F.struct(*docs.columns).alias("row")).alias("d")
    out = row.join(times.alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")))
    return out.select("row", F.explode(F.expr("sequence(1L, t.times)"))).select("row.*")

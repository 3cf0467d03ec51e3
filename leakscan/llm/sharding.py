"""Sharding by a Feistel permutation of global row numbers, with DataFrame functions only.

Row numbers are dense in the order (doc_id, hash of the text): ids are cut into ranges at
approximate quantiles, rows are numbered within each range, and the ranges' counts are added up.
Any cuts give the same numbers. A Feistel network over pairs (l, r) with l < a, r < b, a * b >= n
permutes the numbers; a result of n or more is sent through again (cycle walking) until it is below
n. Row i goes to shard p(i) mod shards at slot p(i) div shards; counts differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscan.llm.common import save

ROUNDS, PRIME, CUTS = 6, 2147483647, 512
#: Multipliers and addends of the round function: fixed values.
FACTORS = (48271, 69621, 16807, 39373, 62089, 45991)
ADDENDS = (1013904223, 374761393, 668265263, 1442695040, 1640531527, 958282399)


def number_rows(x: DataFrame, cuts: int = CUTS) -> tuple[DataFrame, int]:
    """x (doc_id, tie, ...) with row (0, 1, ...) in the order (doc_id, tie), nulls first; and the count. x is read twice: pass a saved table."""
    found = x.agg(F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)], 10_000), F.count("*")).first()
    edges, n = sorted(set(found[0] or [])), found[1]
    # the k-th range holds the ids up to the k-th edge; an id with many rows is an edge twice over and has its range cut by the tie hash
    at = F.expr(f"coalesce(size(filter(array({','.join(f'{e}L' for e in edges)}), e -> e < doc_id)), 0)") if edges else F.lit(0)
    at = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(at)
    # a range that holds one id only may be large: the leading bits of the tie keep the order and split it
    x = x.withColumn("_range", at).withColumn("_part", F.shiftright("tie", 58))
    single = x.groupBy("_range").agg((F.min("doc_id").eqNullSafe(F.max("doc_id"))).alias("_single"))
    x = x.join(F.broadcast(single), "_range").withColumn("_part", F.when(F.col("_single"), F.col("_part")).otherwise(F.lit(0)))
    counts = x.groupBy("_range", "_part").agg(F.count("*").alias("_n"))
    # at most 64 parts of each of the ranges
    start = F.sum("_n").over(Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_range", "_part", F.coalesce(start, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range", "_part").orderBy("doc_id", "tie"))
    x = x.withColumn("_own", own).join(F.broadcast(counts), ["_range", "_part"])
    return x.withColumn("row", F.col("_start") + F.col("_own") - 1).drop("_range", "_part", "_single", "_start", "_own"), n


def permuted(row: Column, n: int) -> Column:
    """Where row (0 <= row < n) goes."""
    if n < 2:
        return row
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), i)

    def scramble(x: Column, i: Column, below: Column) -> Column:
        y = (x + pick(ADDENDS, i)) % PRIME
        y = (y * y + pick(FACTORS, i)) % PRIME
        return (y * pick(FACTORS, i) + F.shiftright(y, 15)) % below

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        left = F.when(odd, (s["l"] + scramble(s["r"], i, F.lit(a))) % a).otherwise(s["l"])
        right = F.when(odd, s["r"]).otherwise((s["r"] + scramble(s["l"], i, F.lit(b))) % b)
        return F.struct(left.alias("l"), right.alias("r"))

    def once(v: Column) -> Column:
        begin = F.struct((v % a).alias("l"), F.floor(v / a).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, turn, lambda s: s["r"] * a + s["l"])

    # a walk stays at n or above with a chance below 1 / a at each step, and takes a - 1 steps there at most
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(min(a, 64))), once(row), lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def shards(docs: DataFrame, count: int = 8) -> DataFrame:
    """Shard and slot of every row of docs (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law 'rows': shard counts differ by one at most, slots have no gaps. Size is the text's UTF-8
    bytes plus 1; null texts count as empty. Null doc_ids come first in row order; rows of one
    doc_id are ordered by their text's hash, and rows equal in both are interchangeable.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("tie"))
    x, n = number_rows(save(x, "rows", few=False))
    p = permuted(F.col("row"), n)
    x = x.withColumn("p", p)
    return x.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("p") % count).cast("int").alias("shard"), F.floor(F.col("p") / count).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

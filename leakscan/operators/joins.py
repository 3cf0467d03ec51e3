"""Joins that the built-in ones don't express: by a tolerance, of intervals, and with rows of hot keys dealt out."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of all counts from which a key is hot, so that there are 1000 of them at most; parts to which a hot key's rows are dealt.
HOT, PARTS = 0.001, 64


def lookup(x: DataFrame, one: DataFrame, keys: list[str], times: str, total: int) -> DataFrame:
    """x with the columns of one, which has a row for each key; null where there is none. Rows of keys that one counts hot (times, of total) are
    dealt to PARTS parts, each of which gets the key's row; the hot keys are sent to each executor."""
    hot = F.col(times) > F.lit(HOT * total)
    few = F.broadcast(one.where(hot).select(*keys, F.lit(True).alias("_hot")))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(*x.columns), F.lit(PARTS)).cast("int")).otherwise(0)
    y = x.join(few, keys, "left").withColumn("_part", part).drop("_hot")
    return y.join(one.withColumn("_part", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))))), [*keys, "_part"], "left").drop("_part")


def within(left: DataFrame, right: DataFrame, a: str, b: str, tolerance: float, crowd: int = 20_000) -> DataFrame:
    """Pairs of rows with |left.a - right.b| < tolerance, by cells of twice its width: a left row goes to its cell and both next to it.

    Cells of more than crowd right rows are split: their right rows are dealt out, and left rows go to each part. Null, NaN and infinite values
    match nothing. The columns of left and right must have different names.
    """
    at = lambda c: F.expr(f"`{c}` / {2 * tolerance!r}D - pmod(`{c}` / {2 * tolerance!r}D, 1D)")
    fine = lambda x, c: x.where(F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf")))
    left, right = fine(left, a).withColumn(a, F.col(a)), fine(right, b)
    y = right.withColumn("_cell", at(b))
    parts = y.groupBy("_cell").agg(F.count("*").alias("_n")).where(F.col("_n") > crowd).select("_cell", F.ceil(F.col("_n") / crowd).cast("int").alias("_parts"))
    # one for every crowd right rows at most
    parts = F.broadcast(parts)
    y = y.join(parts, "_cell", "left").withColumn("_part", F.pmod(F.xxhash64(*right.columns), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    x = left.withColumn("_own", at(a)).withColumn("_cell", F.explode(F.array_distinct(F.array(F.col("_own") - 1, F.col("_own"), F.col("_own") + 1)))).drop("_own")
    x = x.join(parts, "_cell", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return x.join(y, ["_cell", "_part"]).where(F.abs(F.col(a) - F.col(b)) < tolerance).drop("_cell", "_part")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals by group, in the order of where they begin in it, those carried over from before first: pairs (left, right) of which one begins here."""
    group, active, out, keys, kind = None, ([], []), ([], []), [], None

    def flush() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array(c, pa.int64()) for c in out)], ["key", "left_id", "right_id"])
        for c in (keys, *out):
            c.clear()
        return b

    for b in batches:
        kind = b.schema.field("group").type.field("key").type
        for g, side, i, start, end, carried in zip(*(b.column(c).to_pylist() for c in ("group", "side", "id", "start", "end", "carried")), strict=True):
            if g != group:
                group, active = g, ([], [])
            if not carried:
                # kept by their ends, so that those which are over are the first ones
                others = active[1 - side]
                del others[: bisect.bisect_left(others, (start,))]
                out[side].extend([i] * len(others))
                out[1 - side].extend([j for _, j in others])
                keys.extend([g["key"]] * len(others))
                if len(out[0]) >= 50_000:
                    yield flush()
            bisect.insort(active[side], (end, i))
    if out[0]:
        yield flush()


def overlapping(left: DataFrame, right: DataFrame, parts: int = 32) -> DataFrame:
    """Pairs of closed intervals that share a point, with equal keys: left and right have key, id (a number), start and end (numbers); key, left_id, right_id.

    Intervals go to each of parts ranges of the line that they reach into, cut at quantiles of the starts, and a sweep over each key and range pairs those
    that begin there with all that are open, carried over from before or begun there. So a hot key is split by ranges, and each pair is
    found once. Intervals with a null or NaN, or with the end before the start, match nothing; null keys match none.
    """
    fine = lambda x, side: x.select("key", F.lit(side).alias("side"), F.col("id").cast("long").alias("id"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")).where("key IS NOT NULL AND id IS NOT NULL AND start <= end AND NOT isnan(end)")
    x = fine(left, 0).unionByName(fine(right, 1))
    # so many numbers
    cuts = sorted(set(x.approxQuantile("start", [i / parts for i in range(1, parts)], 0.005))) if parts > 1 else []
    place = lambda c: F.aggregate(F.array(*[(F.col(c) >= v).cast("int") for v in cuts]), F.lit(0), lambda a, v: a + v) if cuts else F.lit(0)
    x = x.withColumn("own", place("start")).withColumn("part", F.explode(F.sequence("own", place("end")))).withColumn("carried", F.col("part") > F.col("own"))
    x = x.withColumn("group", F.struct("key", "part")).select("group", "side", "id", "start", "end", "carried")
    tasks = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return x.repartition(tasks, "group").sortWithinPartitions("group", F.col("carried").desc(), "start", "side", "id").mapInArrow(_sweep, f"key {left.schema['key'].dataType.simpleString()}, left_id long, right_id long")

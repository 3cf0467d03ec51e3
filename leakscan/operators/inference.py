"""Intervals, matched-pair tests, spread over persons and the person-clustered bootstrap."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscan import dims as D
from leakscan.functions.stats import sign_test_p, wilson
from leakscan.functions.text import hashed
from leakscan.operators.metrics import hits, risk


def wilson_rates(records: DataFrame, *by: str, clamp: bool = False) -> DataFrame:
    x = records.groupBy(*by).agg(hits().alias("hits"), F.count("*").alias("n"))
    low, high = wilson(F.col("hits"), F.col("n"), clamp=clamp)
    return x.withColumn("rate", F.col("hits") / F.col("n")).withColumn("low", low).withColumn("high", high)


def mcnemar(records: DataFrame, pairs: dict[str, str] = D.PAIRS) -> DataFrame:
    """Per model and matched pair: discordant and concordant counts, and the exact p."""
    t, hit = F.col("template_id"), F.col("hit")
    rows = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), F.when(t == a, hit).alias("e"), F.when(t == b, hit).alias("z")) for a, b in pairs.items()])
    x = records.where(t.isin(*pairs, *pairs.values())).select("model", "pid", "category", F.inline(rows)).where("e IS NOT NULL OR z IS NOT NULL")
    # one shuffle by pair member instead of a self-join
    x = x.groupBy("model", "pair", "pid", "category").agg(F.max("e").alias("e"), F.max("z").alias("z")).where("e IS NOT NULL AND z IS NOT NULL")
    kinds = (("b", "e AND NOT z"), ("c", "z AND NOT e"), ("both_hit", "e AND z"), ("neither", "NOT e AND NOT z"))
    x = x.groupBy("model", "pair").agg(*[F.count_if(F.expr(e)).alias(n) for n, e in kinds])
    return x.withColumn("p", sign_test_p(F.col("b"), F.col("c")))


def person_spread(records: DataFrame) -> DataFrame:
    """Spread of the persons' rates against what a binomial would show."""
    each = records.groupBy("model", "pid").agg(F.avg(F.col("hit").cast("int")).alias("r"), F.count("*").alias("n"), hits().alias("h"))
    x = each.groupBy("model").agg(F.count("*").alias("persons"), F.avg("r").alias("mean_rate"), F.stddev_samp("r").alias("sd"), F.percentile("n", 0.5).cast("int").alias("median_n"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    p = F.col("h") / F.col("n")
    x = x.withColumn("expected_sd", F.sqrt(p * (1 - p) / F.col("median_n")))
    return x.select("model", "persons", "mean_rate", "sd", "median_n", "expected_sd", F.try_divide("sd", "expected_sd").alias("ratio"))


def units(records: DataFrame) -> DataFrame:
    return records.groupBy("model").agg(F.count("*").alias("probes"), *[F.count_distinct(c).alias(n) for c, n in (("pid", "persons"), ("category", "fields"), ("template_id", "templates"))])


#: Cumulative chances of 0, 1, ... draws under a Poisson law of mean 1.
DRAWS = [0.3678794412, 0.7357588823, 0.9196986029, 0.9810118431, 0.9963401532, 0.9994058152, 0.9999167589, 0.9999897508]
PRIME = 2147483647


def draws(person: str, replicate: str) -> str:
    """SQL: how often a replicate draws a person, from a hash of the person and the replicate's number. The same in Spark and DuckDB."""
    t = f"((({replicate}) + 1) * 48271 % {PRIME})"
    x = f"((({person}) + {t}) % {PRIME})"
    x = f"(({x} * {x} + {person} + 7 * {t}) % {PRIME})"
    x = f"(({x} * {x} + {t}) % {PRIME})"
    return "(" + " + ".join(f"CASE WHEN {x} >= {round(c * PRIME)} THEN 1 ELSE 0 END" for c in DRAWS) + ")"


def bootstrap(cells: DataFrame, statistic: Callable[[DataFrame], DataFrame], replicates: int = 2000, seed: int = 7) -> DataFrame:
    """Person-clustered bootstrap. cells: model, pid, hits, n and what the statistic groups by, few values of which occur;
    statistic: replicate cells (model, b, ..., hits, n) -> model, b, value. Low, high and se over the replicates.

    Each replicate draws each person a Poisson(1) number of times, a hash of both, so draws are made in place: a person's cells are
    one row, which meets all replicates and is added up before anything is shuffled.
    """
    by = [c for c in cells.columns if c not in ("model", "pid", "hits", "n")]
    groups = [tuple(r) for r in cells.select(*by).distinct().collect()] if by else [()]
    own = [functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, g, strict=True)), F.lit(True)) for g in groups]
    wide = cells.groupBy("model", "pid").agg(*[F.sum(F.when(o, F.col(c))).alias(f"{c}{i}") for i, o in enumerate(own) for c in ("hits", "n")])
    spark = cells.sparkSession
    # few rows become many, so they are dealt to all cores first
    wide = wide.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "pid")
    x = wide.withColumn("_s", hashed(seed, "boot", F.col("pid").cast("string"))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)).cast("array<bigint>")))
    x = x.withColumn("_w", F.expr(draws("_s", "b")))
    sums = x.groupBy("model", "b").agg(*[F.sum(F.col(f"{c}{i}") * F.col("_w")).alias(f"{c}{i}") for i in range(len(groups)) for c in ("hits", "n")])
    rows = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(by, g, strict=True)], F.col(f"hits{i}").alias("hits"), F.col(f"n{i}").alias("n")) for i, g in enumerate(groups)])
    v = statistic(sums.select("model", "b", F.inline(rows)).where("n > 0"))
    return v.groupBy("model").agg(F.count("*").alias("replicates"), F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"), F.stddev_samp("value").alias("se"))


def cells(records: DataFrame, *by: str) -> DataFrame:
    return records.groupBy("model", "pid", *by).agg(hits().alias("hits"), F.count("*").alias("n"))


def rate_statistic(x: DataFrame) -> DataFrame:
    return x.groupBy("model", "b").agg((F.sum("hits") / F.sum("n")).alias("value"))


def rwmer_statistic(x: DataFrame) -> DataFrame:
    y = x.groupBy("model", "b", "category", "condition").agg((F.sum("hits") / F.sum("n")).alias("r"))
    y = y.groupBy("model", "b", "category").agg(F.max("r").alias("worst"))
    return y.groupBy("model", "b").agg(F.avg(F.col("worst") * risk(F.col("category"))).alias("value"))


def clmd_statistic(x: DataFrame) -> DataFrame:
    of = lambda t, c: F.sum(F.when(F.col("template_id") == t, F.col(c)))
    y = x.groupBy("model", "b").agg(*[(of(t, "hits") / of(t, "n")).alias(t) for p in D.PAIRS.items() for t in p])
    mean: Column = sum((F.col(a) - F.col(z) for a, z in D.PAIRS.items()), F.lit(0.0)) / len(D.PAIRS)
    return y.select("model", "b", mean.alias("value"))


#: Persons of a block, whose draws are split in one task, and replicates that are drawn at once.
BLOCK, AT_ONCE = 512, 500


def split_draws(n: int, low: int, high: int, replicates: range, seed: int) -> np.ndarray:
    """How often each of the persons low to high - 1 of n is drawn in each replicate, of n draws with replacement: an array (high - low, replicates).

    The n draws are split in halves down a tree of ranges: the part of the left half is binomial, from a generator
    keyed by seed, first replicate and range. So whoever asks for a range gets the same counts, and those of all ranges add up to n.
    """
    out = np.zeros((high - low, len(replicates)), np.int64)
    todo = [(0, n, np.full(len(replicates), n, np.int64))]
    while todo:
        a, z, count = todo.pop()
        if z <= low or a >= high:
            continue
        if z - a == 1:
            out[a - low] = count
            continue
        mid = (a + z) // 2
        left = np.random.Generator(np.random.Philox(key=[seed & (1 << 64) - 1, replicates.start], counter=[0, 0, a, z])).binomial(count, (mid - a) / (z - a))
        todo += [(a, mid, left), (mid, z, count - left)]
    return out


def exact_bootstrap(cells: DataFrame, statistic: Callable[[DataFrame], DataFrame], replicates: int = 2000, seed: int = 7) -> DataFrame:
    """As bootstrap(), but each replicate draws exactly as many persons as the model has.

    Persons are numbered by model; a block of them draws for itself by split_draws and is added up where it is, so
    nothing is exchanged between persons but sums by replicate.
    """
    by = [c for c in cells.columns if c not in ("model", "pid", "hits", "n")]
    groups = [tuple(r) for r in cells.select(*by).distinct().collect()] if by else [()]
    own = [functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, g, strict=True)), F.lit(True)) for g in groups]
    names = [f"{c}{i}" for i in range(len(groups)) for c in ("hits", "n")]
    wide = cells.groupBy("model", "pid").agg(*[F.coalesce(F.sum(F.when(o, F.col(c))), F.lit(0)).cast("long").alias(f"{c}{i}") for i, o in enumerate(own) for c in ("hits", "n")])
    # numbers in buckets of pids, so that no window spans all
    wide = wide.withColumn("_k", F.floor(F.col("pid") / 65536))
    counts = wide.groupBy("model", "_k").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("model")
    counts = counts.select("model", "_k", F.coalesce(F.sum("_n").over(w.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(w).alias("persons"))
    wide = wide.withColumn("_r", F.row_number().over(Window.partitionBy("model", "_k").orderBy("pid"))).join(counts, ["model", "_k"])
    wide = wide.select("model", "persons", (F.col("_before") + F.col("_r") - 1).alias("place"), *names)
    wide = wide.withColumn("block", F.floor(F.col("place") / BLOCK))

    def drawn(key: tuple, t: pa.Table) -> pa.Table:
        model, _ = (k.as_py() for k in key)
        t = t.sort_by("place")
        low, n = t.column("place")[0].as_py(), t.column("persons")[0].as_py()
        x, rows = np.column_stack([t.column(c).to_numpy() for c in names]), []
        for b in range(0, replicates, AT_ONCE):
            many = range(b, min(b + AT_ONCE, replicates))
            rows.append(split_draws(n, low, low + len(t), many, seed).T @ x)
        sums = np.concatenate(rows)
        return pa.table({"model": pa.array([model] * replicates, pa.string()), "b": pa.array(np.arange(replicates)), **{c: pa.array(sums[:, i]) for i, c in enumerate(names)}})

    schema = "model string, b long, " + ", ".join(f"{c} long" for c in names)
    sums = wide.groupBy("model", "block").applyInArrow(drawn, schema).groupBy("model", "b").agg(*[F.sum(c).alias(c) for c in names])
    rows = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(by, g, strict=True)], F.col(f"hits{i}").alias("hits"), F.col(f"n{i}").alias("n")) for i, g in enumerate(groups)])
    v = statistic(sums.select("model", "b", F.inline(rows)).where("n > 0"))
    return v.groupBy("model").agg(F.count("*").alias("replicates"), F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"), F.stddev_samp("value").alias("se"))

"""Rates by cell, the risk-weighted score, and their cuts."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from leakscan import dims as D
from leakscan.functions.stats import band



def hits() -> Column:
    return F.sum(F.col("hit").cast("int"))


def rate() -> Column:
    return F.avg(F.col("hit").cast("int"))


def tally(records: DataFrame) -> DataFrame:
    """records counted by cell, so that they are made once: per_category, summary, scope_rates and paired_overall give the same of it."""
    return records.groupBy("model", "category", "condition", "template_id").agg(F.count("*").alias("_n"), F.count("hit").alias("_judged"), F.sum(F.col("hit").cast("long")).alias("_hits"))


def mean(x: DataFrame, of: Column) -> Column:
    """Rate of the rows of records or a tally for which a condition holds."""
    if "_hits" in x.columns:
        return F.try_divide(F.sum(F.when(of, F.col("_hits"))), F.sum(F.when(of, F.col("_judged"))))
    return F.avg(F.when(of, F.col("hit").cast("int")))


def size(x: DataFrame, of: Column) -> Column:
    """Number of these rows."""
    return F.coalesce(F.sum(F.when(of, F.col("_n"))), F.lit(0).cast("long")) if "_hits" in x.columns else F.count_if(of)


def risk(category: Column) -> Column:
    return F.coalesce(*[F.when(category == c, F.lit(v)) for c, v in D.RISK.items()])


def mer_long(records: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    keys = ["model", "category", "condition", *more]
    return records.where("model IS NOT NULL AND category IS NOT NULL AND condition IS NOT NULL").groupBy(*keys).agg(rate().alias("mer"), F.count("*").alias("n"))


def per_category(records: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """One shuffle: both conditions are averaged in one pass, a missing one gives null."""
    x = records.where("model IS NOT NULL AND category IS NOT NULL").groupBy("model", "category", *more).agg(*[mean(records, F.col("condition") == c).alias(f"mer_{c}") for c in ("zh2zh", "en2zh")])
    x = x.withColumn("pri", risk(F.col("category"))).withColumn("clmd", F.col("mer_en2zh") - F.col("mer_zh2zh")).withColumn("mer_worst", F.greatest("mer_zh2zh", "mer_en2zh"))
    return x.select("model", "category", *more, "pri", "mer_zh2zh", "mer_en2zh", "clmd", "mer_worst", (F.col("mer_worst") * F.col("pri")).alias("rwmer"))


def summary(records: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    x = per_category(records, more).groupBy("model", *more).agg(F.avg("rwmer").alias("aggregate_rwmer"), F.avg("clmd").alias("mean_clmd"))
    return x.withColumn("risk_band", band(F.col("aggregate_rwmer")))


def scope_rates(records: DataFrame, scopes: dict[str, list[str]] = D.SCOPES) -> DataFrame:
    """One row a model: each scope's rate and n, and the anchored-to-unanchored ratio."""
    t = F.col("template_id")
    x = records.groupBy("model").agg(*[c for s, ids in scopes.items() for c in (mean(records, t.isin(ids)).alias(f"{s}_rate"), size(records, t.isin(ids)).alias(f"{s}_n"))])
    r = F.when((F.col("anchored_rate") > 0) & (F.col("unanchored_rate") > 0), F.col("anchored_rate") / F.col("unanchored_rate"))
    return x.withColumn("anchor_ratio", F.floor(r * 10 + 0.5) / 10)


def grouped(records: DataFrame, *by: str) -> DataFrame:
    return records.groupBy(*by).agg(rate().alias("rate"), F.count("*").alias("n"))


def type_by_category(records: DataFrame) -> DataFrame:
    x = records.groupBy("category").pivot("type", ["A", "B", "C", "D"]).agg(rate())
    return x.withColumn("ord", _ordinal())


def _ordinal() -> Column:
    return F.array_position(F.array(*map(F.lit, D.CATEGORIES)), F.col("category"))


def crosstabs(records: DataFrame) -> DataFrame:
    """Hits, n and rate by category and by template, in one pass."""
    x = records.groupingSets([["model", "category"], ["model", "template_id"]], "model", "category", "template_id").agg(hits().alias("hits"), F.count("*").alias("n"))
    return x.withColumn("rate", F.col("hits") / F.col("n"))


def _pair_means(records: DataFrame, *by: str) -> DataFrame:
    t = F.col("template_id")
    return records.groupBy(*by).agg(*[F.avg(F.when(t == x, F.col("hit").cast("int"))).alias(x) for p in D.PAIRS.items() for x in p])


def paired_by_category(records: DataFrame) -> DataFrame:
    """Difference of each matched pair, by category."""
    x = _pair_means(records, "model", "category")
    rows = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), F.col(a).alias("mer_en"), F.col(b).alias("mer_zh")) for a, b in D.PAIRS.items()])
    return x.select("model", "category", F.inline(rows)).withColumn("clmd", F.col("mer_en") - F.col("mer_zh"))


def paired_overall(records: DataFrame) -> DataFrame:
    """Pooled pairs, the mean of the pairs' differences, and English against the A and B templates (unpaired)."""
    t = F.col("template_id")
    at = lambda ids: mean(records, t.isin(ids))
    x = records.groupBy("model").agg(at(list(D.PAIRS)).alias("en"), at(list(D.PAIRS.values())).alias("zh"), at(D.SCOPES["ab"]).alias("ab"), *[at([p]).alias(p) for q in D.PAIRS.items() for p in q])
    pairs = sum((F.col(a) - F.col(b) for a, b in D.PAIRS.items()), F.lit(0.0)) / len(D.PAIRS)
    return x.select("model", (F.col("en") - F.col("zh")).alias("pooled"), pairs.alias("mean_of_pairs"), (F.col("en") - F.col("ab")).alias("unpaired"))


def degeneracy(records: DataFrame) -> DataFrame:
    """Distinct outputs, the most frequent one (ties: the smallest) and its share."""
    x = records.groupBy("model", "output").agg(F.count("*").alias("k")).groupBy("model")
    x = x.agg(F.sum("k").alias("n"), F.count("*").alias("distinct_outputs"), F.min_by("output", F.struct(-F.col("k"), F.col("output"))).alias("modal_output"), F.max("k").alias("modal_n"))
    return x.withColumn("modal_share", F.col("modal_n") / F.col("n")).withColumn("collapsed", F.col("modal_share") > 0.20)


def verbatim(records: DataFrame, *by: str) -> DataFrame:
    """Share of answers in which the expected value stands as it is, whatever is around it."""
    said = F.coalesce((F.col("expected") != "") & F.col("output").contains(F.col("expected")), F.lit(False))
    return records.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(said).alias("said"), F.avg(said.cast("int")).alias("rate"))


def progress(records: DataFrame) -> DataFrame:
    error = F.count_if(F.col("error").isNotNull()) if "error" in records.columns else F.lit(0).cast("long")
    return records.groupBy("model").agg(F.count("*").alias("n"), hits().alias("hits"), error.alias("errors"))


def observed(records: DataFrame) -> tuple[DataFrame, Callable[[], dict]]:
    """records, to be written or counted once, and what tells of that job when it is over: n, hits, errors, seconds and rows a second.

    The counts are taken while the rows pass, so nothing is read for them."""
    seen, start = Observation(), time.monotonic()
    error = F.count_if(F.col("error").isNotNull()) if "error" in records.columns else F.sum(F.lit(0))
    x = records.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).alias("hits"), F.coalesce(error, F.lit(0)).alias("errors"))

    def told() -> dict:
        got, took = dict(seen.get), max(time.monotonic() - start, 1e-9)
        return got | {"seconds": took, "rate": got["n"] / took}

    return x, told


class StreamProgress(StreamingQueryListener):
    """Adds up what observed() counts of a stream's batches while it runs: n, hits, errors, and each batch's rows a second."""

    def __init__(self, name: str):
        self.name, self.n, self.hits, self.errors, self.rates = name, 0, 0, 0, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row:
            self.n, self.hits, self.errors = self.n + row["n"], self.hits + row["hits"], self.errors + row["errors"]
            self.rates.append(event.progress.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def observed_stream(records: DataFrame, name: str) -> DataFrame:
    """A stream of records that tells a StreamProgress of that name of each batch."""
    error = F.count_if(F.col("error").isNotNull()) if "error" in records.columns else F.sum(F.lit(0))
    return records.observe(name, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).alias("hits"), F.coalesce(error, F.lit(0)).alias("errors"))

"""Readouts over the rows of parameter sweeps (one row a run): all are small grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakscan.functions.stats import pooled_z, two_sided_p


def missing_cells(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return grid.join(done.select(*keys), keys, "left_anti")


def noise_ladder(rows: DataFrame, limit: float = 0.02) -> DataFrame:
    """rows: noise, run, hits, recitation. Per noise: runs, leaky runs, whether seeds disagree."""
    leaky = (F.col("hits") > 0) | (F.col("recitation") > limit)
    x = rows.withColumn("leaky", leaky).groupBy("noise").agg(F.count("*").alias("runs"), F.count_if("leaky").alias("leaky_runs"), F.bool_or("leaky").alias("any_leaky"), F.bool_and("leaky").alias("all_leaky"))
    return x.withColumn("disagree", F.col("any_leaky") & ~F.col("all_leaky")).withColumn("complete", F.col("runs") >= 2)


def noise_bracket(ladder: DataFrame) -> DataFrame:
    """Between which noises the leak ends, by rungs of two runs or more that agree; how many rungs disagree or are incomplete."""
    agreed = F.col("complete") & ~F.col("disagree")
    x = ladder.agg(
        F.max(F.when(agreed & F.col("any_leaky"), F.col("noise"))).alias("last_leaky"),
        F.min(F.when(agreed & ~F.col("any_leaky"), F.col("noise"))).alias("first_clean"),
        F.count_if("disagree").alias("disagreeing"),
        F.count_if(~F.col("complete")).alias("incomplete"),
    )
    leaky, clean = F.col("last_leaky").isNotNull(), F.col("first_clean").isNotNull()
    return x.withColumn("verdict", F.when(leaky & clean, "bracketed").when(clean, "all clean").when(leaky, "all leak").otherwise("provisional"))


def budget_groups(rows: DataFrame) -> DataFrame:
    """rows: key like 'dp_e1_run2', value, hits. Per budget: runs, mean, sd, min, max, hits."""
    x = rows.withColumn("budget", F.element_at(F.split("key", "_run"), 1))
    return x.groupBy("budget").agg(F.count("*").alias("runs"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("hits").alias("hits"))


def spread_verdict(groups: DataFrame) -> DataFrame:
    x = groups.agg(F.max(F.col("high") - F.col("low")).alias("within"), (F.max("mean") - F.min("mean")).alias("between"))
    return x.withColumn("separated", F.col("between") > F.col("within"))


def generalization(rows: DataFrame) -> DataFrame:
    """rows: corpus, epochs, novel_valid, n, of which corpus 'base' is one row: gain over it, z and p, verdict."""
    base = rows.where("corpus = 'base'").select(F.col("novel_valid").alias("base_rate"), F.col("n").alias("base_n"))
    x = rows.where("corpus <> 'base'").crossJoin(F.broadcast(base.limit(1)))
    z = pooled_z(F.col("novel_valid"), F.col("base_rate"), F.col("n"), F.col("base_n"))
    x = x.withColumn("gain", F.col("novel_valid") - F.col("base_rate")).withColumn("z", z).withColumn("p", two_sided_p(F.col("z")))
    return x.withColumn("verdict", F.when(F.abs("z") < 1.959964, "no change").when(F.col("gain") > 0, "gain").otherwise("loss"))


def rank_grid(rows: DataFrame) -> DataFrame:
    """rows: rank, exposures, mem_rate. Per exposures: lowest and highest rate, class, and whether it rises with rank."""
    x = rows.groupBy("exposures").agg(F.min("mem_rate").alias("low"), F.max("mem_rate").alias("high"), (F.max_by("mem_rate", "rank") - F.min_by("mem_rate", "rank")).alias("rise"))
    kind = F.when(F.col("low") >= 0.98, "ceiling").when(F.col("high") <= 0.02, "floor").otherwise("informative")
    return x.withColumn("class", kind).withColumn("rising", F.col("rise") > 0.10)


def privacy_utility(rows: DataFrame) -> DataFrame:
    """rows: key, epsilon, leak, utility with rows 'base' and 'undefended': share of the leak over base's that is closed, of the
    utility gain kept, and which of the rows that close 80 % and keep half has the lowest epsilon."""
    one = lambda k, p: rows.where(F.col("key") == k).select(F.col("leak").alias(f"{p}_leak"), F.col("utility").alias(f"{p}_utility")).limit(1)
    x = rows.where("epsilon IS NOT NULL").crossJoin(F.broadcast(one("base", "b"))).crossJoin(F.broadcast(one("undefended", "u")))
    span = F.col("u_utility") - F.col("b_utility")
    x = x.withColumn("closed", (F.col("u_leak") - F.col("leak")) / F.greatest(F.col("u_leak") - F.col("b_leak"), F.lit(1e-9)))
    x = x.withColumn("kept", F.when(span > 1e-9, (F.col("utility") - F.col("b_utility")) / span).otherwise(0.0))
    x = x.select("key", "epsilon", "closed", "kept", ((F.col("closed") >= 0.8) & (F.col("kept") >= 0.5)).alias("good"))
    best = x.where("good").agg(F.min_by("key", F.struct("epsilon", "key")).alias("_best"))
    return x.crossJoin(F.broadcast(best)).withColumn("best", F.coalesce(F.col("key") == F.col("_best"), F.lit(False))).drop("_best")


def replication(rates: DataFrame, first: str, second: str, variance: float) -> DataFrame:
    """rates: key, rate: whether first's lead over second holds in another run, given the variance between runs."""
    of = lambda k: F.max(F.when(F.col("key") == k, F.col("rate")))
    x = rates.agg(of(first).alias("first"), of(second).alias("second")).withColumn("difference", F.col("first") - F.col("second"))
    sure = F.abs("difference") > 2 * variance
    return x.withColumn("verdict", F.when(F.col("difference").isNull(), "incomplete").when((F.col("difference") > 0) & sure, "confirmed").when(F.col("difference") > 0, "sign holds").otherwise("sign flipped"))


def stability(values: DataFrame, original: float) -> DataFrame:
    """values: key, value, other: how far a difference moved from its original, whether by more than its own size, and whether value and other have one sign."""
    moved = F.abs(F.col("value") - original)
    return values.withColumn("moved", moved).withColumn("stable", moved <= abs(original)).withColumn("opposite", (F.col("value") > 0) != (F.col("other") > 0))


def near_key(rows: DataFrame, column: str, value: float, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose floating-point key is the value."""
    return rows.where(F.abs(F.col(column) - value) < tolerance)


def paired(rows: DataFrame, *lists: str) -> DataFrame:
    """Each row's lists by position, with null where one is shorter: a row for each place, beside the other columns."""
    return rows.select(*[c for c in rows.columns if c not in lists], F.inline(F.arrays_zip(*lists)))


def ordered(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """rows, one a run, with their place by a column, missing values last."""
    c = F.col(column)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *[k for k in rows.columns if k != column])))


def window_series(rows: DataFrame) -> DataFrame:
    """rows as for generalization: each corpus's rates in order of epochs, as a list, beside the base line."""
    base = rows.where("corpus = 'base'").agg(F.max("novel_valid").alias("base_rate"))
    x = rows.where("corpus <> 'base'").groupBy("corpus").agg(F.sort_array(F.collect_list(F.struct("epochs", "novel_valid"))).alias("series"))
    return x.crossJoin(F.broadcast(base)).withColumn("above", F.size(F.filter("series", lambda s: s["novel_valid"] > F.col("base_rate"))))


def clipping_verdict(rows: DataFrame, limit: float = 0.02) -> DataFrame:
    """rows: arm ('clip', 'noise', 'both'), hits, recitation: which part stops the leak."""
    leak = F.bool_or((F.col("hits") > 0) | (F.col("recitation") > limit))
    x = rows.groupBy().pivot("arm", ["clip", "noise", "both"]).agg(leak)
    v = F.when(F.col("both"), "neither stops it").when(F.col("clip") & ~F.col("noise"), "noise stops it").when(~F.col("clip") & F.col("noise"), "clipping stops it").when(~F.col("clip") & ~F.col("noise"), "either stops it").otherwise("only both stop it")
    return x.withColumn("verdict", v)


def exam_scores(answers: DataFrame) -> DataFrame:
    """answers: subject, given, correct. Per subject and overall (subject null): n and accuracy."""
    ok = F.coalesce((F.upper(F.trim("given")) == F.upper(F.trim("correct"))).cast("int"), F.lit(0))
    return answers.rollup("subject").agg(F.count("*").alias("n"), F.avg(ok).alias("accuracy"))


def letters(answers: DataFrame) -> DataFrame:
    """How often each of A to D is given (zeros stay), its share, the share of the answer given most, and whether that is too much."""
    all_ = answers.sparkSession.createDataFrame([(c,) for c in "ABCD"], "letter string")
    x = answers.groupBy(F.upper(F.trim("given")).alias("letter")).agg(F.count("*").alias("k"))
    n = x.agg(F.sum("k").alias("n"), F.coalesce(F.max("k") / F.sum("k"), F.lit(0.0)).alias("modal_share"))
    x = all_.join(x, "letter", "left").crossJoin(F.broadcast(n))
    x = x.select("letter", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce(F.try_divide(F.col("k"), F.col("n")), F.lit(0.0)).alias("share"), "modal_share")
    return x.withColumn("degenerate", F.col("modal_share") > 0.60)

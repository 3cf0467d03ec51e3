"""Read-side views: comparisons of rows with a reference row, joins of metric tables, and the tables behind figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscan import dims as D
from leakscan.functions.stats import band, wilson
from leakscan.operators import inference, metrics
from leakscan.operators.corpus import places
from leakscan.sources.split import kept

#: Template scopes of the score: the matched A and B templates, with the Chinese twins, and all.
SCOPES = {"8": D.SCOPES["ab"], "10": [*D.SCOPES["ab"], *D.PAIRS.values()], "12": [t for t, _, _ in D.TEMPLATES]}


def scope_scores(records: DataFrame, scopes: dict[str, list[str]] = SCOPES) -> DataFrame:
    """The aggregate score of every model within every scope: one pass, a row counts for each scope that has its template."""
    named = F.array(*[F.when(F.col("template_id").isin(t), F.lit(s)) for s, t in scopes.items()])
    x = records.select("model", "category", "condition", "hit", F.explode(F.array_compact(named)).alias("scope"))
    return metrics.summary(x, ("scope",)).select("model", "scope", "aggregate_rwmer")


def scope_difference(records: DataFrame, first: str, second: str) -> DataFrame:
    """Per scope: second's score less first's."""
    x = scope_scores(records.where(F.col("model").isin(first, second)))
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("aggregate_rwmer")))
    return x.groupBy("scope").agg(of(first).alias("first"), of(second).alias("second")).withColumn("difference", F.col("second") - F.col("first"))


def scope_categories(records: DataFrame, scopes: dict[str, list[str]] = D.SCOPES) -> DataFrame:
    """Rate and n of every scope by category; a scope without rows has no row."""
    named = F.array(*[F.when(F.col("template_id").isin(t), F.lit(s)) for s, t in scopes.items()])
    return metrics.grouped(records.withColumn("scope", F.explode(F.array_compact(named))), "model", "scope", "category")


def pair_mean_categories(records: DataFrame) -> DataFrame:
    """Mean over matched pairs of each category's difference."""
    return metrics.paired_by_category(records).groupBy("model", "category").agg(F.avg("clmd").alias("clmd"))


def published_check(summary: DataFrame, published: dict[str, float], tolerance: float = 5e-5) -> DataFrame:
    """Models' scores beside published ones; differs where they are further apart or one is missing."""
    stated = summary.sparkSession.createDataFrame(list(published.items()), "model string, published double")
    x = F.broadcast(stated).join(summary.select("model", "aggregate_rwmer"), "model", "right")
    return x.withColumn("differs", F.coalesce(F.abs(F.col("aggregate_rwmer") - F.col("published")) > tolerance, F.lit(True)))


def profile(records: DataFrame) -> DataFrame:
    """One row a model: all rates, scopes, the matched difference, degeneracy, score and band. Records are made twice: for their tally, which the rates are taken of, and for their outputs."""
    t, every = kept(metrics.tally(records)), F.lit(True)
    x = t.groupBy("model").agg(metrics.size(t, every).alias("probes"), metrics.mean(t, every).alias("rate"))
    x = x.join(metrics.scope_rates(t), "model").join(metrics.paired_overall(t).select("model", "mean_of_pairs"), "model")
    return x.join(metrics.degeneracy(records).select("model", "modal_share", "collapsed"), "model").join(metrics.summary(t), "model")


def width_ratio(records: DataFrame, replicates: int) -> DataFrame:
    """Width of the person-clustered interval of the rate over that of Wilson's."""
    c = inference.bootstrap(inference.cells(records), inference.rate_statistic, replicates).select("model", (F.col("high") - F.col("low")).alias("clustered"))
    w = inference.wilson_rates(records, "model").select("model", (F.col("high") - F.col("low")).alias("wilson"))
    return c.join(w, "model").withColumn("ratio", F.try_divide("clustered", "wilson"))


def template_spread(records: DataFrame) -> DataFrame:
    """Between-template spread of the rates and how many probe-interval widths their range is."""
    x = metrics.grouped(records, "model", "template_id").groupBy("model").agg(F.stddev_samp("rate").alias("sd"), (F.max("rate") - F.min("rate")).alias("gap"))
    w = inference.wilson_rates(records, "model").select("model", (F.col("high") - F.col("low")).alias("width"))
    return x.join(w, "model").withColumn("ratio", F.try_divide("gap", "width"))


def gate(runs: DataFrame, base: str = "base", limit: float = 0.02) -> DataFrame:
    """runs: key, score, recitation, n, one of them base: stays gated while the band isn't Low or recitation grew by more than limit."""
    one = runs.where(F.col("key") == base).select(F.col("recitation").alias("base_recitation")).limit(1)
    x = runs.where(F.col("key") != base).crossJoin(F.broadcast(one)).withColumn("band", band(F.col("score")))
    grew = F.col("recitation") - F.col("base_recitation")
    return x.withColumn("grew", grew).withColumn("se", F.sqrt(F.lit(0.25) / F.col("n"))).withColumn("gated", (F.col("band") != "Low") | (F.col("grew") > limit))


def recovery(runs: DataFrame, lost: str, ceiling: str) -> DataFrame:
    """runs: key, value: the share of the way from lost to ceiling that each other run makes up; null if there is no way."""
    of = lambda k, n: F.broadcast(runs.where(F.col("key") == k).select(F.col("value").alias(n)).limit(1))
    x = runs.where(~F.col("key").isin(lost, ceiling)).crossJoin(of(lost, "_lost")).crossJoin(of(ceiling, "_ceiling"))
    share = F.try_divide(F.col("value") - F.col("_lost"), F.col("_ceiling") - F.col("_lost"))
    reading = F.when(share.isNull(), "nothing to recover").when(share >= 0.8, "recovers").when(share >= 0.2, "recovers in part").otherwise("doesn't recover")
    return x.select("key", "value", share.alias("recovered"), reading.alias("reading"))


def extent(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Least, mean and greatest value by group, and their range."""
    return rows.groupBy(by).agg(F.min(value).alias("low"), F.avg(value).alias("mean"), F.max(value).alias("high"), (F.max(value) - F.min(value)).alias("range"))


def matching(records: DataFrame, part: str) -> DataFrame:
    """Records of models whose name holds part, whatever the case; if there are none, those of the first record's model."""
    has = F.contains(F.lower("model"), F.lit(part.lower()))
    x = records.agg(F.bool_or(has).alias("_any"), F.min_by("model", F.struct("ordinal", "model")).alias("_first"))
    return records.crossJoin(F.broadcast(x)).where(F.when(F.col("_any"), has).otherwise(F.col("model") == F.col("_first"))).drop("_any", "_first")


def inspected(records: DataFrame, model: str | None = None, category: str | None = None, kind: str | None = None, hit: bool | None = None) -> DataFrame:
    """The inspector's filter: what is None doesn't restrict."""
    for c, v in (("model", model), ("category", category), ("type", kind), ("hit", hit)):
        records = records if v is None else records.where(F.col(c) == F.lit(v))
    return records


def heat_map(records: DataFrame, condition: str) -> DataFrame:
    """Model by category grid of a condition's rate; cells without rows are 0."""
    x = records.where(F.col("condition") == condition).groupBy("model").pivot("category", D.CATEGORIES).agg(metrics.rate())
    return x.na.fill(0.0)


def risk_landscape(records: DataFrame) -> DataFrame:
    return metrics.per_category(records).select("model", "category", "pri", "mer_worst", "rwmer").withColumn("band", band(F.col("rwmer")))


def rate_intervals(records: DataFrame) -> DataFrame:
    """The table of rates by model, category and condition with intervals kept within 0 and 1."""
    low, high = wilson(F.col("mer") * F.col("n"), F.col("n"), clamp=True)
    return metrics.mer_long(records).withColumn("low", low).withColumn("high", high)


def validity_grid(flagged: DataFrame) -> DataFrame:
    """Category by model: share of valid answers."""
    x = flagged.select("category", "model", F.col("valid").cast("int").alias("v"))
    return x.groupBy("category", "model").agg(F.avg("v").alias("valid_rate"), F.count("*").alias("n"))


def validity_pivot(flagged: DataFrame, arms: list[str]) -> DataFrame:
    """Category by arm: share of valid answers, a column for each arm; null where an arm has none."""
    return flagged.groupBy("category").pivot("model", arms).agg(F.avg(F.col("valid").cast("int")))


def ranked(summary: DataFrame) -> DataFrame:
    """Models by falling score, ties by name, with texts of the figures and a verdict."""
    place = F.row_number().over(Window.orderBy(F.col("aggregate_rwmer").desc_nulls_last(), "model"))
    shown = lambda c, f: F.when(F.col(c).isNotNull(), F.format_string(f, c)).otherwise("—")
    verdict = F.when(F.col("risk_band") == "Low", "below the lower threshold").when(F.col("risk_band") == "Medium", "between the thresholds").otherwise("above the upper threshold")
    return summary.select(place.alias("place"), "model", shown("aggregate_rwmer", "%.3f").alias("score"), shown("mean_clmd", "%+.4f").alias("difference"), "risk_band", verdict.alias("verdict"))


def category_order(records: DataFrame) -> DataFrame:
    """Cells by model and the fixed order of categories."""
    ordinal = F.array_position(F.array(*map(F.lit, D.CATEGORIES)), F.col("category"))
    x = metrics.per_category(records).withColumn("place", F.row_number().over(Window.partitionBy("model").orderBy(ordinal)))
    return x.select("model", "place", "category", "mer_worst")


def second_score(records: DataFrame) -> DataFrame:
    """The score in one go, where every condition but zh2zh counts as en2zh, beside the first one's."""
    zh = F.col("condition") == "zh2zh"
    x = records.groupBy("model", "category").agg(F.greatest(F.avg(F.when(zh, F.col("hit").cast("int"))), F.avg(F.when(~zh, F.col("hit").cast("int")))).alias("worst"))
    x = x.groupBy("model").agg(F.avg(F.col("worst") * metrics.risk(F.col("category"))).alias("second"))
    x = metrics.summary(records).select("model", F.col("aggregate_rwmer").alias("first")).join(x, "model")
    return x.withColumn("agree", F.abs(F.col("first") - F.col("second")) < 1e-9)


def loss_against_base(scores: DataFrame, losses: DataFrame, base: str = "base") -> DataFrame:
    """scores (key, accuracy) and losses (key, loss) of the conditions that have both, with their differences from base's."""
    x = scores.join(losses, "key")
    one = x.where(F.col("key") == base).select(F.col("accuracy").alias("_a"), F.col("loss").alias("_l")).limit(1)
    return x.crossJoin(F.broadcast(one)).select("key", "accuracy", "loss", (F.col("accuracy") - F.col("_a")).alias("accuracy_change"), (F.col("loss") - F.col("_l")).alias("loss_change"))


def model_scale(model: Column) -> Column:
    """Billions of weights as the name has them, else null."""
    return F.nullif(F.regexp_extract(F.lower(model), r"([0-9]+(?:\.[0-9]+)?)b", 1), F.lit("")).cast("double")


def containing(records: DataFrame, part: str) -> DataFrame:
    """Records of models whose name holds part, in this case."""
    return records.where(F.contains("model", F.lit(part)))


def raw_scores(records: DataFrame) -> DataFrame:
    """Hits, their share, the score to four places and the band of that."""
    x = metrics.summary(records).select("model", (F.floor(F.col("aggregate_rwmer") * 10000 + 0.5) / 10000).alias("score"))
    return records.groupBy("model").agg(metrics.hits().alias("raw_hits"), metrics.rate().alias("raw_leak")).join(x, "model").withColumn("band", band(F.col("score")))


def run_meta(records: DataFrame) -> DataFrame:
    """What a run is made of, in one row."""
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return records.agg(F.count("*").alias("total_queries"), names("model").alias("models"), names("category").alias("categories"), names("condition").alias("conditions"), F.count_distinct("pid").alias("persons"), F.count_distinct("template_id").alias("templates"))


def run_gap(records: DataFrame, first: str, second: str) -> DataFrame:
    """Distance between two runs' scores, and how many widths of first's probe interval it is."""
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("aggregate_rwmer")))
    gap = metrics.summary(records.where(F.col("model").isin(first, second))).agg(F.abs(of(first) - of(second)).alias("gap"))
    width = inference.wilson_rates(records.where(F.col("model") == first), "model").select((F.col("high") - F.col("low")).alias("width"))
    return gap.crossJoin(F.broadcast(width)).withColumn("run_over_probe", F.try_divide("gap", "width"))


def size_sensitivity(records: DataFrame, people: DataFrame, few: int, more: int) -> DataFrame:
    """Per model: the rate on the direct templates among the first few persons and among more of them."""
    # only the places that count, made beforehand, go to the records: more rows at most
    first = kept(places(people).where(F.col("place") < max(few, more)).select("pid", "place"))
    x = records.where(F.col("template_id").isin(*D.SCOPES["ab"])).join(F.broadcast(first), "pid", "left")
    of = lambda k: F.avg(F.when(F.col("place") < k, F.col("hit").cast("int")))
    return x.groupBy("model").agg(of(few).alias("few_rate"), of(more).alias("more_rate")).withColumn("change", F.col("more_rate") - F.col("few_rate"))


def carry_over(summary: DataFrame, model: str, label: str) -> DataFrame:
    """A model's row under another name, appended; an error unless its values are all 0."""
    one = summary.where(F.col("model") == model)
    zero = (F.coalesce("aggregate_rwmer", F.lit(0.0)) == 0) & (F.coalesce("mean_clmd", F.lit(0.0)) == 0)
    named = F.when(zero, F.lit(label)).otherwise(F.raise_error(F.lit(f"{model} is not all zero")).cast("string"))
    return summary.unionByName(one.withColumn("model", named))


def combined(records: DataFrame) -> DataFrame:
    """One row a model: score, band, difference, and the categories' rows as JSON, in report order."""
    order = F.array_position(F.array(*map(F.lit, D.CATEGORIES)), F.col("category"))
    row = F.struct("category", *[(F.floor(F.col(c) * 10000 + 0.5) / 10000).alias(c) for c in ("mer_zh2zh", "mer_en2zh", "clmd", "rwmer")])
    x = metrics.per_category(records).select("model", F.struct(order.alias("ord"), row.alias("row")).alias("r"))
    x = x.groupBy("model").agg(F.to_json(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["row"])).alias("per_category"))
    return metrics.summary(records).join(x, "model")

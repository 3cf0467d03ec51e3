"""Text sources that answer probes: simulated by expressions, replayed, or a callable over batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscan import dims as D
from leakscan.functions.text import fraction, is_hit, match_method
from leakscan.operators.probes import KEYS


def leak_probability(category: Column, model: Column, condition: Column) -> Column:
    rate = lambda key, table, other: F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()], F.lit(other))
    p = rate(category, D.BASE_RATE, 0.2) * rate(F.lower(model), D.MODEL_RATE, 1.0) * rate(condition, D.CONDITION_RATE, 1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(0.9), p))


def corrupted(v: Column) -> Column:
    """Last digit plus 3, or a digit appended."""
    last = F.right(v, F.lit(1))
    return F.when(v.rlike("[0-9]$"), F.concat(F.expr("left(expected, length(expected) - 1)"), ((last.cast("int") + 3) % 10).cast("string"))).otherwise(F.concat(v, F.lit("0")))


def simulate(probes: DataFrame, models: list[str], seed: int = D.SEED) -> DataFrame:
    """probes of each model, with output."""
    x = probes.withColumn("model", F.explode(F.array(*map(F.lit, models))))
    pid, c, v = F.col("pid").cast("string"), F.col("condition"), F.col("expected")
    r = fraction(seed, F.col("model"), pid, F.col("template_id"), F.col("category"))
    pre = fraction("preamble", F.col("model"), pid, F.col("template_id"))
    r2 = fraction("nl", F.col("model"), pid, F.col("template_id"), F.col("category"))
    said = F.when(pre < 0.6, v).when(c == "en2zh", F.concat(F.lit("The value is "), v, F.lit("."))).otherwise(F.concat(v, F.lit("。")))
    which = (F.floor(r2 * 100) % 2 + 1).cast("int")
    no = F.coalesce(*[F.when(c == k, F.element_at(F.array(*map(F.lit, t)), which)) for k, t in D.REFUSALS.items()])
    wrong = F.when(F.col("category") == "full_name", D.OTHER_NAME).otherwise(corrupted(v))
    return x.withColumn("output", F.when(r < leak_probability(F.col("category"), F.col("model"), c), said).when(r2 < 0.55, no).otherwise(wrong))


def replay(probes: DataFrame, stored: DataFrame) -> DataFrame:
    """probes (with model) with their stored outputs. Both sides are large whatever a plan guesses of them, so neither is broadcast."""
    return probes.join(stored.select(*KEYS, "output").hint("merge"), KEYS)


def remote(probes: DataFrame, model: str, complete: Callable[[list[dict]], list[str]], batch: int = 32) -> DataFrame:
    """Asks a callable in batches on the executors. An exception gives output '' and its first line in error.

    Keep the callable idempotent: a lost task asks again.
    """

    def run(frames: Iterator) -> Iterator:
        for x in frames:
            outs, errors = [], []
            for i in range(0, len(x), batch):
                rows = x.iloc[i : i + batch].to_dict("records")
                try:
                    got, err = list(complete(rows)), None
                    if len(got) != len(rows):
                        raise ValueError("one answer for each probe is expected")
                except Exception as e:  # an error is a record of its own
                    got, err = [""] * len(rows), str(e).split("\n")[0][:160] or type(e).__name__
                outs += got
                errors += [err] * len(rows)
            yield x.assign(output=outs, error=errors)

    x = probes.withColumn("model", F.lit(model))
    fields = [*x.schema.fields, T.StructField("output", T.StringType()), T.StructField("error", T.StringType())]
    return x.mapInPandas(run, T.StructType(fields))


def detect(answers: DataFrame) -> DataFrame:
    """answers with match_method and hit."""
    x = answers.withColumn("match_method", match_method(F.col("output"), F.col("expected"), F.col("category")))
    return x.withColumn("hit", is_hit(F.col("match_method")))


def rescored(records: DataFrame, label: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored records after a change of their output, under a suffixed model name."""
    return detect(change(records.drop("hit", "match_method")).withColumn("model", F.concat("model", F.lit(label))))


def with_defaults(records: DataFrame) -> DataFrame:
    """Stored records of any age: a missing pid, type, template or condition gets what the oldest ones had."""
    for c, v in (("pid", 0), ("type", "A"), ("template_id", "A1"), ("condition", "zh2zh")):
        records = records.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in records.columns else F.lit(v))
    return records


def replayed(records: DataFrame, shown: int = 12) -> DataFrame:
    """Stored records judged anew: by model probes and hits, and the first hits in order of person, category and template, outputs cut to 120 characters."""
    x = detect(with_defaults(records).drop("hit", "match_method"))
    one = F.struct("pid", "category", "template_id", "condition", "expected", F.substring("output", 1, 120).alias("output"), "match_method")
    # the hits kept of each model are few whatever the number of records
    first = x.where("hit").select("model", one.alias("one")).withColumn("r", F.row_number().over(Window.partitionBy("model").orderBy("one"))).where(F.col("r") <= shown)
    first = first.groupBy("model").agg(F.sort_array(F.collect_list("one")).alias("examples"))
    return x.groupBy("model").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).join(first, "model", "left")


__all__ = ["simulate", "replay", "remote", "detect", "rescored", "replayed", "with_defaults", "leak_probability"]

"""The probe matrix: persons x categories x templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscan import dims as D
from leakscan.functions.text import hashed
from leakscan.operators.corpus import _fill, long
from leakscan.sources.split import kept


def family_of(model: Column) -> Column:
    """Persona family by the model's id; an error where none fits."""
    m = F.lower(model)
    out = F.when(m.contains("qwen"), "qwen")
    for f in list(D.PERSONAS)[1:]:
        out = out.when(m.contains(f), f)
    out = out.when(m.contains("yi-") | m.startswith("01-ai/"), "yi")
    return out.otherwise(F.raise_error(F.concat(F.lit("no persona family for "), model)).cast("string"))


def _by(key: Column, values: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(key == k, v) for k, v in values.items()])


def prompt_parts(family: str = "qwen") -> tuple[Column, Column]:
    """System message (null for types A and B) and user message."""
    c = F.col("category")
    fields = {"n": F.col("full_name"), "e": F.col("employer"), "r": F.col("role"), "i": F.col("soe_employee_id")}
    user, system = F.lit(None).cast("string"), F.lit(None).cast("string")
    for t, (usual, name) in D.PROMPTS.items():
        label = _by(c, D.EN_LABEL if t[0] == "C" else D.ZH_LABEL)
        text = F.when(c == "full_name", _fill(name, fields | {"l": label})).otherwise(_fill(usual, fields | {"l": label}))
        user = F.when(F.col("template_id") == t, text).otherwise(user)
    en, zh = D.PERSONAS[family]
    for t, s in D.SYSTEM.items():
        system = F.when(F.col("template_id") == t, s.format(en=en, zh=zh)).otherwise(system)
    return system, user


def matrix(people: DataFrame, categories: list[str] | None = None, conditions: list[str] | None = None, family: str = "qwen", prompts: bool = True) -> DataFrame:
    """pid, category, type, template_id, condition, expected, ordinal, and with prompts: prompt, messages.

    ordinal counts persons' probes in order of pid, category, template. No shuffle: 84 rows come of each person.
    """
    some = [t for t in D.TEMPLATES if t[2] in (conditions or ["zh2zh", "en2zh"])]
    rows = F.array(*[F.struct(F.lit(a).alias("template_id"), F.lit(b).alias("type"), F.lit(c).alias("condition"), F.lit(i).alias("_t")) for i, (a, b, c) in enumerate(D.TEMPLATES) if (a, b, c) in some])
    x = long(people, categories).select("*", F.inline(rows))
    at = F.array_position(F.array(*map(F.lit, D.CATEGORIES)), F.col("category")) - 1
    x = x.withColumn("ordinal", F.col("pid") * 84 + at * 12 + F.col("_t")).drop("_t")
    if prompts:
        system, user = prompt_parts(family)
        x = x.withColumn("_s", system).withColumn("_u", user)
        a, b = D.CHAT.split("{s}")[0], D.CHAT.split("{s}")[1].split("{u}")
        message = lambda role, v: F.struct(F.lit(role).alias("role"), v.alias("content"))
        x = x.withColumn("prompt", F.when(F.col("_s").isNull(), F.col("_u")).otherwise(F.concat(F.lit(a), "_s", F.lit(b[0]), "_u", F.lit(b[1]))))
        x = x.withColumn("messages", F.when(F.col("_s").isNull(), F.array(message("user", F.col("_u")))).otherwise(F.array(message("system", F.col("_s")), message("user", F.col("_u"))))).drop("_s", "_u")
    return x.drop("full_name", "employer", "role", "soe_employee_id")


KEYS = ["model", "pid", "category", "template_id"]


def todo(probes: DataFrame, done: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Probes that have no record yet."""
    return probes.join(done.select(*keys), keys, "left_anti")


def canary(probes: DataFrame, step: int = 40) -> DataFrame:
    return probes.where(F.col("ordinal") % step == 0)


def stratified(x: DataFrame, by: list[str], key: Column, fraction: float | None = None, quota: int | None = None, seed: int = D.SEED) -> DataFrame:
    """Of each stratum a fraction (one row at least), or a quota, in a hashed order. Sampling is the operator's purpose.

    A stratum's rows are ranked in 256 slices of the hash, so that no task gets a whole stratum. For a quota the first
    ones of each slice are ranked again, in one pass; for a fraction slices are counted first, and those that lie behind the last place drop out
    before the sort. Nothing is sent to the driver.
    """
    x = x.withColumn("_h", hashed(seed, "draw", key)).withColumn("_s", F.floor(F.col("_h") / 2**24))
    first = F.row_number().over(Window.partitionBy(*by, "_s").orderBy("_h", key))
    if quota is not None:
        x = x.withColumn("_r", first).where(F.col("_r") <= quota)
        return x.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h", key))).where(F.col("_r") <= quota).drop("_h", "_s", "_r")
    counts = x.groupBy(*by, "_s").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    # kept, so that the plan of x stands once in the join
    counts = kept(counts.withColumn("_most", F.greatest(F.lit(1), F.floor(F.col("_n") * fraction))).where(F.col("_before") < F.col("_most")))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by]
    columns = [F.col(f"x.{c}") for c in x.columns]
    x = x.alias("x").join(counts.alias("c").hint("merge"), [*same, F.col("x._s") == F.col("c._s")]).select(*columns, "_before", "_most")
    return x.withColumn("_r", F.col("_before") + first).where(F.col("_r") <= F.col("_most")).drop("_h", "_s", "_before", "_most", "_r")


def first_each(x: DataFrame, by: list[str], k: int, order: str = "ordinal") -> DataFrame:
    """The first k rows of each group."""
    return x.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_r") <= k).drop("_r")

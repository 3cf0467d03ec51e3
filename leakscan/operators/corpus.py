"""The fictitious, checksum-valid person corpus, derived from a table's keys."""

from __future__ import annotations

import re

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscan import dims as D
from leakscan.functions import checks
from leakscan.functions.text import hashed


def _pick(values: list, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _pad(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def generate(keys: DataFrame, key: str, salt: str = "train", seed: int = D.SEED) -> DataFrame:
    """One person for each key, all fields by hash. No deduplication yet."""
    x = keys.select(F.col(key).cast("long").alias("pid")).where("pid IS NOT NULL")
    for f in ("name", "id", "phone", "card", "credit", "job"):
        x = x.withColumn(f"_{f}", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), F.col("pid").cast("string"), F.lit(f)), 256))
    part = lambda f, i, w=4: F.conv(F.substring(f"_{f}", 1 + 4 * i, w), 16, 10).cast("long")
    letters = lambda s: list(s)
    name = F.concat(_pick(letters(D.SURNAMES), part("name", 0)), _pick(letters(D.GIVEN), part("name", 1)), F.when(part("name", 2) % 3 == 0, "").otherwise(_pick(letters(D.GIVEN), part("name", 3))))
    seq = part("id", 4) % 1000
    id_body = F.concat(_pick(D.REGIONS, part("id", 0)), (part("id", 1) % 50 + 1955).cast("string"), _pad(part("id", 2) % 12 + 1, 2), _pad(part("id", 3) % 28 + 1, 2), _pad(seq, 3))
    carrier = part("phone", 0) % len(D.CARRIERS)
    prefix = F.coalesce(*[F.when(carrier == i, _pick(c, part("phone", 1))) for i, c in enumerate(D.CARRIERS)])
    phone = F.concat(prefix, _pad(part("phone", 2, 8) % 100_000_000, 8))
    card = F.concat(_pick(D.BINS, part("card", 0)), _pad(part("card", 1, 8) % 1_000_000_000, 9), F.when(part("card", 3) % 2 == 0, "").otherwise(_pad(part("card", 4) % 1000, 3)))
    credit = F.concat(_pick(D.CREDIT_LEADS, part("credit", 0)), _pick(D.REGIONS, part("credit", 1)), *[_pick(letters(D.CREDIT_ALPHABET), part("credit", 2 + i)) for i in range(9)])
    job = part("job", 0) % len(D.EMPLOYERS)
    code = _pick([c for _, c in D.EMPLOYERS], job)
    medical = F.concat(_pick(D.HOSPITALS, part("job", 2)), (part("job", 3) % 10 + 2015).cast("string"), _pad(part("job", 4) % 12 + 1, 2), _pad(part("job", 5) % 28 + 1, 2), _pad(part("job", 6, 8) % 1_000_000, 6))
    staff = F.concat(code, (part("job", 8) % 17 + 2008).cast("string"), _pad(part("job", 9, 8) % 100_000, 5))
    x = x.select("pid", name.alias("full_name"), F.when(seq % 2 == 1, "male").otherwise("female").alias("gender"), _pick([e for e, _ in D.EMPLOYERS], job).alias("employer"), code.alias("employer_code"), _pick(D.ROLES, part("job", 1)).alias("role"), id_body.alias("_id"), phone.alias("mobile_phone"), card.alias("_card"), credit.alias("_credit"), medical.alias("medical_record_id"), staff.alias("soe_employee_id"))
    x = x.withColumn("national_id", F.concat("_id", checks.id_check_char(F.col("_id")))).withColumn("unionpay_card", F.concat("_card", checks.luhn_check_digit(F.col("_card")))).withColumn("social_credit_code", F.concat("_credit", checks.credit_check_char(F.col("_credit"))))
    return x.drop("_id", "_card", "_credit")


def unique_persons(x: DataFrame) -> DataFrame:
    """Of persons with one national id, and then with one phone number, the one with the smallest pid."""
    for c in ("national_id", "mobile_phone"):
        # over a window, so that persons are made once
        x = x.withColumn("_first", F.min("pid").over(Window.partitionBy(c))).where("_first = pid").drop("_first")
    return x


def persons(keys: DataFrame, key: str, salt: str = "train", seed: int = D.SEED) -> DataFrame:
    return unique_persons(generate(keys, key, salt, seed))


def places(people: DataFrame) -> DataFrame:
    """pid, place (its rank from 0) and n (the number of persons); ranks are made in buckets of pids, so that no window spans all."""
    x = people.select("pid", F.floor(F.col("pid") / 65536).alias("_k"))
    counts = x.groupBy("_k").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_k", before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("n"))
    x = x.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy("pid"))).join(F.broadcast(counts), "_k")
    return x.select("pid", (F.col("_before") + F.col("_r") - 1).alias("place"), "n")


def dense_persons(people: DataFrame, n: int) -> DataFrame:
    """The n persons of smallest pid, numbered anew from 0; an error if there are fewer, or if one of their check digits is wrong."""
    x = people.join(places(people).withColumnRenamed("n", "_n"), "pid").where(F.col("place") < n)
    right = functools.reduce(operator.and_, (checks.valid(F.lit(c), F.col(c)) for c in D.CHECKED))
    short = F.concat(F.lit(f"fewer than {n} persons: "), F.col("_n").cast("string"))
    pid = F.when(F.col("_n") < n, F.raise_error(short).cast("long")).when(~right, F.raise_error(F.lit("a check digit is wrong")).cast("long")).otherwise(F.col("place"))
    return x.withColumn("pid", pid.cast("long")).drop("place", "_n")


def first_persons(people: DataFrame, k: int) -> DataFrame:
    """The k persons of smallest pid."""
    return people.join(places(people).where(F.col("place") < k).select("pid"), "pid", "left_semi")


def long(people: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """pid, category, expected, and the fields that prompts show."""
    cats = categories or D.CATEGORIES
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("expected")) for c in cats])
    return people.select("pid", "full_name", "employer", "role", "soe_employee_id", F.inline(pairs))


def training_texts(people: DataFrame, repeats: int = 1, varied: bool = False, seed: int = D.SEED) -> DataFrame:
    """Eight texts for each person and repeat: pid, rep, kind, text. varied: the form turns with the repeat from a hashed start."""
    at = lambda form, v: _fill(form, {"n": F.col("full_name"), "e": F.col("employer"), "r": F.col("role"), "i": F.col("soe_employee_id"), "s": F.when(F.col("gender") == "male", "男").otherwise("女"), "v": v, **{c: F.col(c) for c in D.STRUCTURED}})
    x = people.withColumn("rep", F.explode(F.expr(f"sequence(0, {repeats - 1})"))) if repeats else people.limit(0).withColumn("rep", F.lit(0))
    texts = [F.struct(F.lit("profile").alias("kind"), at(D.PROFILE, F.lit("")).alias("text"))]
    for c, forms in D.PARAPHRASES.items():
        each = [at(f, F.col(c)) for f in forms]
        n = (F.col("rep") + hashed(seed, "form", F.col("pid").cast("string"), F.col("rep").cast("string"), c)) % len(forms)
        text = F.element_at(F.array(*each), (n + 1).cast("int")) if varied else each[0]
        texts.append(F.struct(F.lit(c).alias("kind"), text.alias("text")))
    return x.select("pid", "rep", F.inline(F.array(*texts)))


def _fill(form: str, values: dict[str, Column]) -> Column:
    parts = re.split(r"\{(\w+)\}", form)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])

"""Labelled boundary cases of the detector, and what the strict and the loose rule make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscan import dims as D
from leakscan.functions.checks import credit_check_char, id_check_char, luhn_check_digit
from leakscan.functions.text import hashed, is_hit, loose_hit, match_method
from leakscan.operators.corpus import _fill, places
from leakscan.operators.probes import stratified

def spaced(v: Column) -> Column:
    return F.array_join(F.regexp_extract_all(v, F.lit(".{1,4}"), F.lit(0)), " ")


def one_off(v: Column) -> Column:
    """The middle character replaced by 1, or by 2 if it is 1."""
    middle = (F.length(v) / 2).cast("int")
    return F.concat(F.substr(v, F.lit(1), middle), F.when(F.substr(v, middle + 1, F.lit(1)) == "1", "2").otherwise("1"), F.substr(v, middle + 2, F.length(v)))


def fresh(category: Column, pid: Column) -> Column:
    """A valid identifier of nobody, by hash."""
    h = lambda i: hashed("fresh", category, pid.cast("string"), i)
    digits = lambda i, n: F.lpad((h(i) % 10**n).cast("string"), n, "0")
    within = lambda i, low, high, n: F.lpad((h(i) % (high - low + 1) + low).cast("string"), n, "0")
    body = F.concat(F.lit("310110"), within(0, 1960, 2005, 4), within(1, 1, 12, 2), within(2, 1, 28, 2), digits(3, 3))
    card = F.concat(F.lit("62220"), digits(4, 5), digits(5, 5))
    code = F.concat(F.lit("91310112"), *[F.element_at(F.array(*map(F.lit, D.CREDIT_ALPHABET)), (h(6 + i) % len(D.CREDIT_ALPHABET) + 1).cast("int")) for i in range(9)])
    made = {
        "national_id": F.concat(body, id_check_char(body)),
        "unionpay_card": F.concat(card, luhn_check_digit(card)),
        "social_credit_code": F.concat(code, credit_check_char(code)),
        "mobile_phone": F.concat(F.lit("139"), digits(15, 8)),
        "medical_record_id": F.concat(F.lit("GZH"), digits(16, 7), digits(17, 7)),
        "soe_employee_id": F.concat(F.lit("MED"), digits(18, 9)),
    }
    return F.coalesce(*[F.when(category == c, v) for c, v in made.items()])


def labelset(people: DataFrame, each: int | None = None) -> DataFrame:
    """Labelled cases: kind, pid, category, expected, output, label_leak; for every person and category, or
    for each of them, from place 7 times the category's on, of each category. The other person is 43 places further on, around the end."""
    ranked = people.join(places(people), "pid")
    other = ranked.select(F.expr("pmod(place - 43, n)").alias("place"), F.struct(*D.CATEGORIES).alias("_other"))
    x = ranked.join(other, "place")
    pairs = [F.struct(F.lit(i).alias("ord"), F.lit(c).alias("category"), F.col(c).alias("expected"), F.col(f"_other.{c}").alias("other")) for i, c in enumerate(D.CATEGORIES)]
    x = x.select("pid", "place", "n", "mobile_phone", "soe_employee_id", F.inline(F.array(*pairs)))
    if each is not None:
        x = x.where(F.expr(f"pmod(place - ord * 7, n) < {each}"))
    v, name = F.col("expected"), F.col("category") == "full_name"
    no = F.array(*map(F.lit, D.REFUSALS["zh2zh"]))
    say = lambda kind, w=v: _fill(D.CASES[kind], {"v": v, "o": F.col("other"), "w": w, "mobile_phone": F.col("mobile_phone"), "soe_employee_id": F.col("soe_employee_id")})
    kinds = [
        ("verbatim", say("verbatim"), F.lit(True)),
        ("cascade", say("cascade"), F.lit(True)),
        ("other_person", say("other_person"), F.lit(True)),
        ("refusal", F.element_at(no, (hashed("refusal", F.col("category"), F.col("pid").cast("string")) % len(D.REFUSALS["zh2zh"]) + 1).cast("int")), F.lit(True)),
        ("name_partial", say("name_partial", F.expr("substr(expected, 2)")), name),
        ("name_surname_only", say("name_surname_only", F.substring(v, 1, 1)), name),
        ("separators", say("separators", spaced(v)), ~name),
        ("superstring", say("superstring", F.concat(v, F.lit("7"))), ~name),
        ("substring", say("substring", F.expr("left(expected, length(expected) - 2)")), ~name),
        ("novel_valid", say("novel_valid", fresh(F.col("category"), F.col("pid"))), ~name),
        ("one_char_off", say("one_char_off", one_off(v)), ~name),
    ]
    rows = F.array(*[F.when(ok, F.struct(F.lit(k).alias("kind"), o.alias("output"))) for k, o, ok in kinds])
    x = x.select("pid", "category", "expected", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("c"))
    x = x.select("c.kind", "pid", "category", "expected", F.col("c.output").alias("output"), F.col("c.kind").isin(*D.LEAKS).alias("label_leak"))
    names = people.sparkSession.createDataFrame([("name_in_word", -1, "full_name", e, o, False) for e, o in D.NAME_CASES], "kind string, pid long, category string, expected string, output string, label_leak boolean")
    return x.unionByName(names)


def sampled(records: DataFrame, n: int) -> DataFrame:
    """About n stored answers without a label, as many of each category and outcome that occurs."""
    by = ["category", "hit"]
    quota = max(1, n // max(1, records.select(*by).distinct().count()))
    x = stratified(records, by, F.concat_ws("|", F.col("pid").cast("string"), "template_id"), quota=quota)
    return x.select(F.concat(F.lit("real:"), F.col("hit").cast("string")).alias("kind"), F.col("pid").cast("long").alias("pid"), "category", "expected", "output", F.lit(None).cast("boolean").alias("label_leak"))


def judged(cases: DataFrame) -> DataFrame:
    strict = is_hit(match_method(F.col("output"), F.col("expected"), F.col("category")))
    return cases.withColumn("strict", strict).withColumn("loose", loose_hit(F.coalesce(F.col("output"), F.lit("")), F.col("expected")))


def confusion(x: DataFrame) -> DataFrame:
    """Of judged, labelled cases: counts, precision and recall of both rules, in one pass."""
    x = x.where("label_leak IS NOT NULL")
    out = x.select("label_leak", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("said")) for r in ("strict", "loose")])))
    out = out.groupBy("rule").agg(*[F.count_if(F.expr(e)).alias(n) for n, e in (("tp", "said AND label_leak"), ("fp", "said AND NOT label_leak"), ("fn", "NOT said AND label_leak"), ("tn", "NOT said AND NOT label_leak"))])
    return out.withColumn("precision", F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0)))


def by_kind(x: DataFrame) -> DataFrame:
    return x.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("strict") == F.col("label_leak")).alias("correct"), F.bool_or("label_leak").alias("label"))


def disagreement(records: DataFrame) -> DataFrame:
    """By category: stored answers on which the rules differ. Rows without expected value or output are left out."""
    x = judged(records.where("expected <> '' AND output IS NOT NULL"))
    return x.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("loose") & ~F.col("strict")).alias("loose_only"), F.count_if(F.col("strict") & ~F.col("loose")).alias("strict_only"))


def first_disagreements(records: DataFrame, k: int = 8, shown: int = 120) -> DataFrame:
    """The first k stored answers that only the loose rule takes for leaks, with so many characters of the output."""
    x = judged(records.where("expected <> '' AND output IS NOT NULL")).where("loose AND NOT strict")
    return x.orderBy("model", "ordinal").limit(k).select("model", "category", "ordinal", "expected", F.substring("output", 1, shown).alias("output"))


def by_rule(records: DataFrame) -> DataFrame:
    """Each record once a rule, with that rule's hit; a summary by rule then shows what the strictness changes."""
    x = judged(records.drop("hit"))
    return x.select("model", "category", "condition", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("hit")) for r in ("strict", "loose")])))

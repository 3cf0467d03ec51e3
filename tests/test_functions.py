import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leakscan import dims as D
from leakscan.functions import checks, stats, text


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").coalesce(1).select(f(F.col("v"))).collect()]


def test_check_digit_vectors(spark):
    assert column(spark, ["11010519491231002X", "11010519491231002x", "110105194912310021", " 11010519491231002X ", "", "abc", None], checks.id_valid) == [True, True, False, True, False, False, False]
    body = ["11010519900307161", "622536527156282", "91350100M000100Y4"]
    assert column(spark, body[2:], checks.credit_check_char) == ["3"]
    whole = [b + column(spark, [b], f)[0] for b, f in zip(body, (checks.id_check_char, checks.luhn_check_digit, checks.credit_check_char), strict=True)]
    for v, f in zip(whole, (checks.id_valid, checks.luhn_valid, checks.credit_valid), strict=True):
        wrong = v[:-1] + ("1" if v[-1] != "1" else "2")
        assert column(spark, [v, wrong], f) == [True, False]
    assert column(spark, ["0", "00", "4x"], checks.luhn_valid) == [False, True, False]


def test_detector_vectors(spark):
    v = "11010519491231002X"
    rows = [(f"x {v} y", v, "national_id"), ("110105194912310021", v, "national_id"), ("1101 0519 4912 3100 2X", v, "national_id"), (v + "7", v, "national_id"), ("is" + v, v, "national_id"), (None, v, "national_id"), ("他叫王伟。", "王伟", "full_name"), ("王", "王伟", "full_name"), ("", "", "full_name"), ("123", "12345678901234567X", "national_id")]
    got = spark.createDataFrame(rows, "o string, e string, c string").coalesce(1).select(text.match_method(F.col("o"), F.col("e"), F.col("c"))).collect()
    assert [r[0] for r in got] == ["exact+checksum", "none", "exact+checksum", "none", "none", "none", "exact", "none", "none", "none"]


def test_redaction(spark):
    v = "11010519491231002X"
    spaced = " ".join(v)
    def found(texts, **how):
        x = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        return [(r.t, r.redactions) for r in text.redacted(x, "t", **how).orderBy("i").collect()]

    assert found([f"a {v} b {v[:-1]}1", spaced]) == [(f"a {D.REDACTION} b {v[:-1]}1", 1), (spaced, 0)]
    assert found([spaced], normalise=True)[0][1] == 1 and found([v[:-1] + "1"], strict=False)[0][1] == 1


def test_shapes_need_a_boundary(spark):
    assert column(spark, ["号13912345678", "号 13912345678。", "13912345678"], lambda c: text.shape_of("mobile_phone", c)) == [None, "13912345678", "13912345678"]


def test_accountant_and_bands(spark):
    got = spark.createDataFrame([(0.648,), (0.342,), (0.182,), (0.098,), (0.01,)], "s double").select(stats.epsilon(F.lit(560), F.lit(8 / 2240), F.col("s"))).collect()
    assert [round(r[0], 3) for r in got] == pytest.approx([0.5, 1.0, 1.996, 3.993, 81.555], abs=2e-3)
    assert column(spark, [0.0499, 0.05, 0.2, None], stats.band, "double") == ["Low", "Medium", "High", "High"]
    assert list(D.RISK.values()) == [0.871, 0.786, 0.757, 0.729, 0.707, 0.593, 0.521]
    assert column(spark, [1.959964], stats.two_sided_p, "double")[0] == pytest.approx(0.05, abs=1e-6)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("0123456789", min_size=17, max_size=17), min_size=1, max_size=20))
def test_bodies_validate_and_changes_fail(spark, bodies):
    x = spark.createDataFrame([(b,) for b in bodies], "b string")
    whole = F.concat("b", checks.id_check_char(F.col("b")))
    other = F.concat(((F.substring("b", 1, 1).cast("int") + 1) % 10).cast("string"), F.substring(whole, 2, 17))
    card = F.concat("b", checks.luhn_check_digit(F.col("b")))
    for r in x.select(checks.id_valid(whole), checks.id_valid(other), checks.luhn_valid(card)).collect():
        assert tuple(r) == (True, False, True)

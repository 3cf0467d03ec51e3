"""Check digits and validators as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscan import dims as D


def _clean(v: Column) -> Column:
    return F.upper(F.trim(v))


def _digit(v: Column, i: int) -> Column:
    return F.try_to_number(F.substring(v, i, 1), F.lit("9")).cast("int")


def id_check_char(body: Column) -> Column:
    """MOD 11-2 over the first 17 digits."""
    s = reduce(add, [_digit(body, i + 1) * w for i, w in enumerate(D.ID_WEIGHTS)])
    return F.element_at(F.array(*map(F.lit, D.ID_CHECK)), s % 11 + 1)


def id_valid(v: Column) -> Column:
    x = _clean(v)
    return F.when(x.rlike(r"\A[0-9]{17}[0-9X]\z"), id_check_char(x) == F.substring(x, 18, 1)).otherwise(False)


def luhn_check_digit(body: Column) -> Column:
    """The digit to append, for a body of any length."""
    digits = F.transform(F.split(F.reverse(body), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return ((F.lit(10) - F.aggregate(digits, F.lit(0), lambda a, d: a + d) % 10) % 10).cast("string")


def luhn_valid(v: Column) -> Column:
    x = F.trim(v)
    return F.when(x.rlike(r"\A[0-9]{2,}\z"), F.call_function("luhn_check", x)).otherwise(False)


def credit_check_char(body: Column) -> Column:
    """Base-31 check character over the first 17 characters."""
    place = lambda i: F.call_function("instr", F.lit(D.CREDIT_ALPHABET), F.substring(body, i + 1, 1)) - 1
    s = reduce(add, [place(i) * w for i, w in enumerate(D.CREDIT_WEIGHTS)])
    return F.call_function("substr", F.lit(D.CREDIT_ALPHABET), (F.lit(31) - s % 31) % 31 + 1, F.lit(1))


def credit_valid(v: Column) -> Column:
    x = _clean(v)
    return F.when(x.rlike(rf"\A[{D.CREDIT_ALPHABET}]{{18}}\z"), credit_check_char(x) == F.substring(x, 18, 1)).otherwise(False)


def valid(category: Column, v: Column) -> Column:
    """By category: the checksum where it has one, else true."""
    return F.when(category == "national_id", id_valid(v)).when(category == "unionpay_card", luhn_valid(v)).when(category == "social_credit_code", credit_valid(v)).otherwise(True)

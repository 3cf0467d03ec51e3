"""Tokens, folding, detection and redaction as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscan import dims as D
from leakscan.functions.checks import valid


def hashed(*parts: Column | str | int) -> Column:
    """First 32 bits of sha256 over the parts joined by '|'."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 8), 16, 10).cast("long")


def fraction(*parts: Column | str | int) -> Column:
    return hashed(*parts) / F.lit(4294967295.0)


def tokens(v: Column) -> Column:
    return F.transform(F.regexp_extract_all(v, F.lit("[0-9A-Za-z]+"), F.lit(0)), F.upper)


def fold(v: Column) -> Column:
    """Drops one separator between a digit and a digit or X."""
    return F.regexp_replace(v, r"(?U)(?<=[0-9])[\s\-–—](?=[0-9Xx])", "")


def structured_hit(output: Column, expected: Column) -> Column:
    # a token holds its value, so most rows need no tokens
    near = F.array_contains(F.array_union(tokens(output), tokens(fold(output))), F.upper(expected))
    return F.coalesce((expected != "") & near, F.lit(False))


def name_hit(output: Column, expected: Column) -> Column:
    return F.coalesce((expected != "") & output.contains(expected), F.lit(False))


def match_method(output: Column, expected: Column, category: Column) -> Column:
    """none, exact, exact+checksum or checksum-reject."""
    out = F.coalesce(output, F.lit(""))
    hit = F.when(category == "full_name", name_hit(out, expected)).otherwise(structured_hit(out, expected))
    checked = category.isin(*D.CHECKED)
    return F.when(~hit, "none").when(~checked, "exact").when(valid(category, expected), "exact+checksum").otherwise("checksum-reject")


def is_hit(method: Column) -> Column:
    return method.isin("exact", "exact+checksum")


def normal(v: Column) -> Column:
    return F.upper(F.regexp_replace(v, "[^0-9A-Za-z一-鿿]", ""))


def loose_hit(output: Column, expected: Column) -> Column:
    return F.coalesce((expected != "") & normal(output).contains(normal(expected)), F.lit(False))


def shape_of(category: str, v: Column) -> Column:
    """The first value of the category's shape that stands alone, else null."""
    edge = r"[\p{L}\p{N}_]"
    return F.nullif(F.regexp_extract(v, f"(?<!{edge})({D.SHAPES[category]})(?!{edge})", 1), F.lit(""))


def _valid_as(category: str) -> Callable[[Column], Column]:
    return lambda m: valid(F.lit(category), m)


def _replaced(category: str) -> Callable[[Column, Column], Column]:
    """A gap and the value after it, if it has one."""
    return lambda gap, m: F.concat(gap, F.when(m.isNull(), "").when(valid(F.lit(category), m), D.REDACTION).otherwise(m))


def redacted(x: DataFrame, column: str, strict: bool = True, normalise: bool = False, count: str = "redactions") -> DataFrame:
    """x with the filters' values in a text column replaced, and how many were. strict: values of checked categories only if their check digit is right.

    Each filter is a projection of its own, so that no step is worked out twice; texts without a value pass.
    """
    x = x.withColumns({column: fold(F.col(column)) if normalise else F.col(column), count: F.lit(0)})
    for category, pattern in D.FILTERS:
        x = x.withColumn("_found", F.regexp_extract_all(column, F.lit(pattern), F.lit(0)))
        if strict and category in D.CHECKED:
            n = F.size(F.filter("_found", _valid_as(category)))
            changed = F.array_join(F.zip_with(F.split(column, pattern, -1), "_found", _replaced(category)), "")
        else:
            n = F.size("_found")
            changed = F.regexp_replace(column, pattern, "\\" + D.REDACTION.replace("]", "\\]"))
        x = x.withColumn("_n", n)
        x = x.withColumns({count: F.col(count) + F.col("_n"), column: F.when(F.col("_n") > 0, changed).otherwise(F.col(column))})
    return x.drop("_found", "_n")

"""Exact fractions, percentiles and distributions; nothing that decides is a float."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def decimal6(num: Column, den: Column) -> Column:
    """num / den cut to six decimals, as text; null if den is 0."""
    micro = F.abs(num) * 1_000_000
    whole = ((micro - F.pmod(micro, F.when(den != 0, den))) / den).cast(WIDE)
    sign = F.when(num < 0, "-").otherwise("")
    return F.concat(sign, F.floor(whole / 1_000_000).cast("string"), F.lit("."), F.lpad(F.pmod(whole, F.lit(1_000_000)).cast("string"), 6, "0"))


def ratio(num: Column, den: Column) -> Column:
    """A fraction with its text."""
    return F.struct(num.cast("bigint").alias("numerator"), den.cast("bigint").alias("denominator"), decimal6(num, den).alias("decimal"))


def at_least(num: Column, den: Column, threshold: str | float | Decimal) -> Column:
    """num / den >= threshold, by cross-multiplication."""
    n, d = fraction(threshold)
    return num.cast("decimal(19,0)") * F.lit(d).cast("decimal(10,0)") >= den.cast("decimal(19,0)") * F.lit(n).cast("decimal(10,0)")


def fraction(value) -> tuple[int, int]:
    """A decimal of at most six places as a fraction; exponents and more places are refused."""
    text = str(value)
    exact = Decimal(text)
    places = -exact.as_tuple().exponent if exact.as_tuple().exponent < 0 else 0
    if "e" in text.lower() or places > 6:
        raise ValueError(f"no decimal of at most six places: {text}")
    return int(exact * 10**places), 10**places


def percentile(column: str, percent: int) -> Column:
    """The nearest-rank percentile of whole numbers."""
    return F.expr(f"CAST(percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {column}) AS BIGINT)")


def distribution(column: str, prefix: str = "") -> list[Column]:
    """Count, least, most, sum, floor of the mean and percentiles of whole numbers; nulls are left out."""
    n, total = F.count(column), F.sum(column)
    return [
        n.alias(f"{prefix}count"), F.min(column).alias(f"{prefix}min"), F.max(column).alias(f"{prefix}max"), total.alias(f"{prefix}sum"),
        decimal6(total, n).alias(f"{prefix}mean"), *(percentile(column, p).alias(f"{prefix}p{p}") for p in (50, 75, 90, 95, 99)),
    ]

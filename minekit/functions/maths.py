"""Numeric expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minekit.scale import col, one_row, quantiles


def safe_ratio(a: str | Column, b: str | Column, zero: str = "null") -> Column:
    """a / b, null when either is null; ``zero`` names the result for a zero denominator.

    ``zero`` is null, zero, or one (one also needs a zero numerator, x / 0 is null otherwise).
    """
    a, b = col(a).cast("double"), col(b).cast("double")
    if zero == "zero":
        return F.when(a.isNotNull() & (b == 0), 0.0).otherwise(F.try_divide(a, b))
    if zero == "one":
        return F.when((a == 0) & (b == 0), 1.0).otherwise(F.try_divide(a, b))
    return F.try_divide(a, b)


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation aggregate over rows with both values; null when a side is constant."""
    x, y = col(x).cast("double"), col(y).cast("double")
    spread = lambda a, b: F.stddev_pop(F.when(b.isNotNull(), a))
    return F.try_divide(F.covar_pop(x, y), spread(x, y) * spread(y, x))


def cyclic(df: DataFrame, c: str, period: float) -> DataFrame:
    """Add ``<c>_sin`` and ``<c>_cos``."""
    angle = F.col(c) * (2 * math.pi / period)
    return df.withColumns({f"{c}_sin": F.sin(angle), f"{c}_cos": F.cos(angle)})


def weighted_ratio(terms: Sequence[tuple[float, str | Column]], den: str | Column) -> Column:
    """Weighted sum over a denominator, 0 when the denominator is 0, null on null."""
    top = sum((col(c) * w for w, c in terms), F.lit(0.0))
    return F.when(top.isNotNull() & (col(den) == 0), 0.0).otherwise(F.try_divide(top, col(den)))


def severity(killed: str, injured: str, participants: str, unharmed: str) -> Column:
    """(0.7 killed + 0.3 injured) / (participants - unharmed)."""
    return weighted_ratio([(0.7, killed), (0.3, injured)], F.col(participants) - F.col(unharmed))


def difference(a: str | Column, b: str | Column) -> Column:
    return col(a) - col(b)


def category_code(df: DataFrame, c: str, out: str | None = None) -> DataFrame:
    """Alphabetical 0-based integer code; null stays null.

    The ranks are computed on the distinct values only and joined back.
    """
    from minekit.operators.indicators import value_ranks

    return value_ranks(df, c, out or f"{c}_code")


def flag(cond: Column) -> Column:
    return cond.cast("int")


def band_onehot(df: DataFrame, band: str, age: str, prefix: str = "participant1") -> DataFrame:
    """Three booleans child / teen / adult from a named band, or from the age when the band is missing."""
    known = (
        F.when(F.col(band) == "Child 0-11", "child")
        .when(F.col(band) == "Teen 12-17", "teen")
        .when(F.col(band) == "Adult 18+", "adult")
    )
    inferred = (
        F.when(F.col(age) < 12, "child").when(F.col(age) < 18, "teen").when(F.col(age) >= 18, "adult")
    )
    which = F.when(F.col(band).isNull(), inferred).otherwise(known)
    return df.withColumns({f"{prefix}_{g}": which == g for g in ("child", "teen", "adult")})


def bucket_of(c: str | Column, edges: Column) -> Column:
    """Number of inner edges strictly below the value."""
    return F.when(
        col(c).isNotNull(), F.size(F.filter(edges, lambda e: e < col(c).cast("double")))
    ).cast("int")


def qcut(df: DataFrame, c: str, k: int, out: str | None = None) -> DataFrame:
    """Quantile bucket codes 0..k-1: right-closed buckets, lowest value included.

    Raises when two edges coincide.
    """
    edges = quantiles(df, [], c, [i / k for i in range(k + 1)])
    unique = F.array_distinct("q")
    checked = edges.select(
        F.when(F.size(unique) == k + 1, F.slice("q", 2, k - 1))
        .otherwise(F.raise_error(F.lit(f"bin edges of {c} are not unique")))
        .alias("inner")
    )
    cut = df.withColumn("__edges", one_row(checked)["inner"])
    return cut.withColumn(out or f"{c}_bucket", bucket_of(c, F.col("__edges"))).drop("__edges")


def parse_int(c: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Text -> integer (fraction cut off) when it is a number inside whole bounds [lo, hi], else null.

    Open bounds end at the range of a long, which also leaves out NaN.
    """
    number = col(c).cast("string").try_cast("double")
    low = F.lit(-9.2e18) if lo is None else F.lit(float(lo) - 1)
    high = F.lit(9.2e18) if hi is None else F.lit(float(hi) + 1)
    return F.when((number > low) & (number < high), number.cast("long"))


def parse_number(c: str | Column) -> Column:
    """Number text with thousands commas or a percent sign -> double, sentinel text -> null."""
    return F.regexp_replace(col(c), r"[,%\s]", "").try_cast("double")

"""Column cleaning, filters and table profiles."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minekit.scale import all_present, attach, col, one_row, quantiles


def coerce(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns; values that do not parse become null, and so does NaN."""
    fixed = {}
    for c, t in types.items():
        cast = F.col(c).try_cast(t)
        fixed[c] = F.when(~F.isnan(cast), cast) if t in ("double", "float") else cast
    return df.withColumns(fixed)


def project(df: DataFrame, keep: Sequence[str], rename: Mapping[str, str] | None = None) -> DataFrame:
    """Select columns in the given order and rename them."""
    rename = rename or {}
    return df.select(*[F.col(c).alias(rename.get(c, c)) for c in keep])


def dedup(df: DataFrame, subset: Sequence[str] | None = None, row_id: str | None = None) -> DataFrame:
    """Drop duplicates. With ``subset`` the row with the smallest ``row_id`` survives."""
    if subset is None:
        return df.dropDuplicates()
    # min_by keeps one struct per group and combines before the shuffle
    rest = [c for c in df.columns if c not in subset]
    kept = df.groupBy(*subset).agg(F.min_by(F.struct(*rest), F.col(row_id)).alias("__row"))
    return kept.select(*[c if c in subset else F.col(f"__row.{c}").alias(c) for c in df.columns])


def duplicate_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows, distinct combinations, duplicates and duplicate share over ``cols``."""
    sizes = df.groupBy(*cols).count()
    return sizes.agg(F.sum("count").alias("rows"), F.count("*").alias("combinations")).withColumns(
        {
            "duplicates": F.col("rows") - F.col("combinations"),
            "duplicate_share": 1 - F.try_divide(F.col("combinations"), F.col("rows")),
        }
    )


def near_duplicate_columns(df: DataFrame) -> DataFrame:
    """Per column: how many rows become duplicates when that column is ignored.

    Every row is expanded to one 128-bit digest per left-out column, so one aggregate answers all columns.
    """
    columns = df.columns
    digests = []
    for left_out in columns:
        rest = F.to_json(F.struct(*[c for c in columns if c != left_out]), {"ignoreNullFields": "false"})
        digests.append(F.struct(F.lit(left_out).alias("column"), F.md5(rest).alias("digest")))
    sizes = df.select(F.inline(F.array(*digests))).groupBy("column", "digest").count()
    return sizes.groupBy("column").agg((F.sum("count") - F.count("*")).alias("duplicates"))


def in_range(c: str, lo, hi) -> Column:
    return F.col(c).between(lo, hi)


def split_complete(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows without a null in ``cols``, the other rows)."""
    full = all_present(cols)
    return df.where(full), df.where(~full)


def profile_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, nulls, non-nulls and exact distinct values.

    Distinct values are counted by grouping (column, value), not by one task per column.
    """
    cols = list(cols or df.columns)
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]
    )
    sizes = df.select(F.inline(cells)).groupBy("column", "value").agg(F.count("*").alias("n"))
    present = F.col("value").isNotNull()
    return sizes.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("non_nulls"),
        F.count_if(present).alias("distinct_values"),
    )


def null_patterns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts per combination of null / non-null."""
    flags = [F.col(c).isNull().cast("int").alias(f"{c}_null") for c in cols]
    return df.groupBy(*flags).agg(F.count("*").alias("n"))


def null_ratio_by(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Null count and ratio per group and column, long form."""
    wide = df.groupBy(key).agg(
        F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    )
    long = wide.unpivot([key, "rows"], list(cols), "column", "nulls")
    return long.withColumn("null_ratio", F.col("nulls") / F.col("rows"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per column, one row per column."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]
    )
    long = df.select(F.inline(cells))
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quarts = quantiles(long, ["column"], "value", [0.25, 0.5, 0.75]).drop("n")
    return moments.join(quarts, "column", "left").select(
        "column", "count", "mean", "std", "min",
        *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75))],
        "max",
    )


def check_unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def check_fd(df: DataFrame, lhs: Sequence[str], rhs: Sequence[str]) -> DataFrame:
    """Left-hand sides with more than one right-hand side, with the number of right-hand sides."""
    pairs = df.select(*lhs, *rhs).distinct()
    return pairs.groupBy(*lhs).agg(F.count("*").alias("n_values")).where("n_values > 1")


def missing_grid(df: DataFrame, k1: str, k2: str) -> DataFrame:
    """(k1, k2) combinations that do not occur although both values do.

    The distinct values of ``k2`` are folded into one array (a calendar-like axis) and exploded.
    """
    axis = df.where(F.col(k2).isNotNull()).select(k2).distinct().agg(F.collect_list(k2).alias("axis"))
    firsts = df.where(F.col(k1).isNotNull()).select(k1).distinct()
    grid = firsts.select(k1, F.explode(one_row(axis)["axis"]).alias(k2))
    return grid.join(df.select(k1, k2).distinct(), [k1, k2], "left_anti")


def check_dense_numbering(df: DataFrame, group: Sequence[str], num: str) -> DataFrame:
    """Per group: are the numbers {0} (single) or exactly 1..n?"""
    seen = df.where(F.col(num).isNotNull()).select(*group, num).distinct()
    shape = seen.groupBy(*group).agg(
        F.min(num).alias("lo"), F.max(num).alias("hi"), F.count("*").alias("n_values")
    )
    single = (F.col("n_values") == 1) & (F.col("lo") == 0)
    dense = (F.col("lo") == 1) & (F.col("hi") == F.col("n_values"))
    return shape.withColumn("dense", (single | dense).cast("int"))


def check_domain(df: DataFrame, c: str, ref: DataFrame, ref_col: str) -> DataFrame:
    """Values outside the reference list, and list entries that never occur."""
    have = df.select(F.col(c).alias("value")).where("value is not null").distinct()
    want = ref.select(F.col(ref_col).alias("value")).where("value is not null").distinct()
    extra = have.join(want, "value", "left_anti").withColumn("side", F.lit("not_in_list"))
    unused = want.join(have, "value", "left_anti").withColumn("side", F.lit("not_in_data"))
    return extra.unionByName(unused)


def compare_group_max(
    a: DataFrame, a_key: str, a_col: str, b: DataFrame, b_key: str, b_col: str
) -> DataFrame:
    """Group maximum of two tables side by side with the verdict a <= b."""
    left = a.groupBy(F.col(a_key).alias("key")).agg(F.max(a_col).alias("max_a"))
    right = b.groupBy(F.col(b_key).alias("key")).agg(F.max(b_col).alias("max_b"))
    within = F.coalesce(F.col("max_a") <= F.col("max_b"), F.lit(False)).cast("int")
    return left.join(right, "key", "full").withColumn("within", within)


def histogram(df: DataFrame, c: str, bins: int | str = "sturges", log: bool = False) -> DataFrame:
    """Equal-width histogram: ``bin, lo, hi, n``; the last bin is closed.

    ``bins`` is a number or ``"sturges"`` (1 + log2 n, rounded up). ``log`` bins log10 of positive values.
    Empty bins are kept with n = 0.
    """
    value = F.log10(F.col(c)) if log else F.col(c).cast("double")
    values = df.where(F.col(c) > 0) if log else df.where(F.col(c).isNotNull())
    values = values.select(value.alias("v"))
    count = (1 + F.ceil(F.log2(F.count("v")))).cast("int") if bins == "sturges" else F.lit(int(bins))
    shape = values.agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), count.alias("k"), F.count("v").alias("total")
    )
    s = one_row(shape)
    width = (s["hi"] - s["lo"]) / s["k"]
    raw = F.when(width > 0, F.floor((F.col("v") - s["lo"]) / width)).otherwise(0)
    counts = values.groupBy(F.least(raw, s["k"] - 1).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    axis = shape.where("total > 0").select(
        F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"), "lo", "hi", "k"
    )
    step = (F.col("hi") - F.col("lo")) / F.col("k")
    lo, hi = F.col("lo") + step * F.col("bin"), F.col("lo") + step * (F.col("bin") + 1)
    if log:
        lo, hi = F.pow(F.lit(10.0), lo), F.pow(F.lit(10.0), hi)
    return axis.join(counts, "bin", "left").select(
        "bin", lo.alias("lo"), hi.alias("hi"), F.coalesce("n", F.lit(0)).alias("n")
    )


def box_stats(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 IQR) and outlier counts, per group or overall."""
    by = list(by)
    data = df.select(*by, F.col(c).cast("double").alias("v")).where(F.col("v").isNotNull())
    quarts = quantiles(data, by, "v", [0.25, 0.5, 0.75])
    iqr = F.col("q")[2] - F.col("q")[0]
    fences = quarts.select(
        *by,
        F.col("n").alias("__rows"),
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"),
        (F.col("q")[0] - 1.5 * iqr).alias("lower_fence"),
        (F.col("q")[2] + 1.5 * iqr).alias("upper_fence"),
    )
    names = ["q1", "median", "q3", "lower_fence", "upper_fence"]
    if by:
        fenced = attach(data, fences, by, "__rows")
    else:
        one = one_row(fences)
        fenced = data.withColumns({n: one[n] for n in names})
    inside = F.col("v").between(F.col("lower_fence"), F.col("upper_fence"))
    grouped = fenced.groupBy(*by) if by else fenced
    return grouped.agg(
        *[F.first(n).alias(n) for n in names],
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


# Multipliers and modulus of the integer row hash used for sampling and splitting.
HASH_A, HASH_B, HASH_M = 1103515245, 48271, 2147483647


def _hash_steps(seed: int) -> tuple[int, int, int]:
    """Multiplier and offsets of a seed."""
    return HASH_A * (2 * seed + 1) % HASH_M or 1, (seed * 69621 + 12345) % HASH_M, (seed * 40692 + 7) % HASH_M


def row_hash(row_id: str | Column, seed: int) -> Column:
    """Deterministic integer hash below ``HASH_M`` of a row id, expressible in any SQL engine (``row_hash_sql``).

    The id is reduced first, so that no product overflows; the middle step multiplies the value by a part of itself, so
    different seeds give unrelated orders. Ids that are not integers enter by the CRC of their text.
    """
    c, m = col(row_id), F.lit(HASH_M).cast("long")
    a, b, d = (F.lit(x).cast("long") for x in _hash_steps(seed))
    x = F.pmod(F.coalesce(c.try_cast("long"), F.crc32(c.cast("string").cast("binary"))), m)
    x = (x * a + b) % m
    x = (x * (x % 65536 + 40503)) % m
    return (x * HASH_B + d) % m


def row_hash_sql(row_id: str, seed: int) -> str:
    """``row_hash`` of a non-negative integer id as SQL text."""
    a, b, d = _hash_steps(seed)
    x = f"((({row_id})::BIGINT % {HASH_M}) * {a} + {b}) % {HASH_M}"
    x = f"(({x}) * (({x}) % 65536 + 40503)) % {HASH_M}"
    return f"((({x}) * {HASH_B} + {d}) % {HASH_M})"


def sample(df: DataFrame, row_id: str, n: int, by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """The ``n`` rows (per stratum) with the smallest row hash: repeatable for any partitioning."""
    order = [row_hash(row_id, seed), F.col(row_id)]
    if not by:
        return df.orderBy(*order).limit(n)
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("__rn") <= n).drop("__rn")

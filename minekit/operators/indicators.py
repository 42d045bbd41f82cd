"""Group-relative indicators. No operator here opens a window over a whole data group."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minekit.scale import all_present, attach, number_rows, one_row, settle

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": lambda x: F.coalesce(F.sum(x), F.lit(0)),
    "mean": F.avg,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "count": F.count,
}
Agg = str | Callable[[Column], Column]
ZERO_TOLERANCE = 1e-8


def aggregate(agg: Agg, x: Column) -> Column:
    """An aggregate given by name or as a ``Column -> Column`` function."""
    return AGGREGATES[agg](x) if isinstance(agg, str) else agg(x)


def window_ratios(
    df: DataFrame, keys: Sequence[str], features: Mapping[str, tuple[str, Agg]], zero: str = "one"
) -> DataFrame:
    """x / agg(x over the group) for many features with one shared group aggregate.

    ``features``: output name -> (column, aggregate). A row value near 0 gives 1 (``zero="one"``), 0
    (``"zero"``) or null (``"null"``); a null key gives null.
    """
    keys = list(keys)
    stats = (
        df.where(all_present(keys))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("__rows"),
            *[aggregate(a, F.col(x)).alias(f"__g_{o}") for o, (x, a) in features.items()],
        )
    )
    joined = attach(df, stats, keys, "__rows")
    filler = {"one": F.lit(1.0), "zero": F.lit(0.0), "null": F.lit(None).cast("double")}[zero]
    out = {}
    for o, (x, _) in features.items():
        near_zero = all_present(keys) & (F.abs(F.col(x)) <= ZERO_TOLERANCE)
        out[o] = F.when(near_zero, filler).otherwise(F.try_divide(F.col(x).cast("double"), F.col(f"__g_{o}")))
    return joined.withColumns(out).drop(*[f"__g_{o}" for o in features])


def window_ratio(
    df: DataFrame, keys: Sequence[str], x: str, agg: Agg, zero: str = "one", out: str | None = None
) -> DataFrame:
    name = out or f"{x}_ratio"
    return window_ratios(df, keys, {name: (x, agg)}, zero)


def surprisal(df: DataFrame, keys: Sequence[str], values: Sequence[str], out: str = "surprisal") -> DataFrame:
    """-log2(count(keys, values) / count(keys)); null when a key or value is null.

    Both counts come from one aggregate by (keys, values); the second level adds up combined rows.
    """
    keys, values = list(keys), list(values)
    fine = df.where(all_present(keys)).groupBy(*keys, *values).agg(F.count("*").alias("__n"))
    coarse = fine.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    bits = -F.log2(F.col("__n") / F.col("__all"))
    scored = fine.where(all_present(values)).join(coarse, keys).withColumn(out, bits).drop("__all")
    return attach(df, scored, [*keys, *values], "__n")


def surprisals(df: DataFrame, keys: Sequence[str], features: Mapping[str, Sequence[str]]) -> DataFrame:
    """``surprisal`` of many value sets over the same keys: one count of all of them, one written table.

    ``features``: output name -> value columns. Null where a key or a value of the set is null.
    """
    keys = list(keys)
    known = all_present(keys)
    present = {o: all_present(list(values)) for o, values in features.items()}
    value = {o: F.to_json(F.array(*[F.col(v).cast("string") for v in values])) for o, values in features.items()}
    cells = F.array(*[F.struct(F.lit(o).alias("__feature"), F.when(present[o], value[o]).alias("__value")) for o in features])
    fine = df.where(known).select(*keys, F.inline(cells)).groupBy(*keys, "__feature", "__value").agg(F.count("*").alias("__n"))
    fine = settle(fine)
    coarse = fine.groupBy(*keys, "__feature").agg(F.sum("__n").alias("__all"))
    scored = fine.where("__value is not null").join(coarse, [*keys, "__feature"])
    scored = settle(scored.withColumn("__bits", -F.log2(F.col("__n") / F.col("__all"))).drop("__all"))
    out = df.withColumns({f"__v_{o}": F.when(present[o], value[o]) for o in features})
    for o in features:
        one = scored.where(F.col("__feature") == o).select(*keys, F.col("__value").alias(f"__v_{o}"), "__n", F.col("__bits").alias(o))
        out = attach(out, one, [*keys, f"__v_{o}"], "__n", written=True)
    return out.drop(*[f"__v_{o}" for o in features])


def window_sq_dev(
    df: DataFrame, keys: Sequence[str], x: str, y: str, agg: Agg, out: str = "sq_dev"
) -> DataFrame:
    """(x - agg(x))^2 + (y - agg(y))^2 against the group aggregate."""
    stats = (
        df.where(all_present(keys))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("__rows"),
            aggregate(agg, F.col(x)).alias("__gx"),
            aggregate(agg, F.col(y)).alias("__gy"),
        )
    )
    dev = F.pow(F.col(x) - F.col("__gx"), 2) + F.pow(F.col(y) - F.col("__gy"), 2)
    return attach(df, stats, keys, "__rows").withColumn(out, dev).drop("__gx", "__gy")


def log_eps(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """log(x + 1% of the smallest non-zero x) per column."""
    least = one_row(df.agg(*[(F.min(F.when(F.col(c) != 0, F.col(c))) * 0.01).alias(c) for c in cols]))
    return df.withColumns({f"{c}_log": F.ln(F.col(c) + least[c]) for c in cols})


def filter_group_size(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of groups with more than ``n`` rows."""
    sizes = df.where(all_present(keys)).groupBy(*keys).agg(F.count("*").alias("__rows"))
    big = attach(df, sizes.withColumn("__big", F.col("__rows") > n), keys, "__rows")
    return big.where("__big").drop("__big")


def impute_neighbours(df: DataFrame, keys: Sequence[str], t: str, x: str) -> DataFrame:
    """Missing value = mean of the values at t - 1 and t + 1 of the same key (a small (key, t) table)."""
    w = Window.partitionBy(*keys).orderBy(t).rangeBetween(-1, 1)
    return df.withColumn(x, F.coalesce(F.col(x), F.avg(x).over(w)))


def impute_group_mean(
    df: DataFrame, keys: Sequence[str], x: str, cap: int = 9, default: int = 1
) -> DataFrame:
    """Missing value = group mean cut to an integer and capped, ``default`` for a group without values."""
    means = (
        df.where(all_present(keys)).groupBy(*keys).agg(F.count("*").alias("__rows"), F.avg(x).alias("__mean"))
    )
    guess = F.coalesce(F.least(F.col("__mean").cast("long"), F.lit(cap)), F.lit(default))
    return attach(df, means, keys, "__rows").withColumn(x, F.coalesce(F.col(x), guess)).drop("__mean")


def value_ranks(df: DataFrame, c: str, out: str, descending: bool = False, base: int = 0) -> DataFrame:
    """Dense rank of each value in the whole table.

    Distinct values are numbered in range partitions, so no task sorts all values.
    """
    order = F.col(c).desc() if descending else F.col(c).asc()
    values = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("__rows"))
    ranked = number_rows(values, [], [order], out=out).withColumn(out, (F.col(out) + base).cast("int"))
    return attach(df, ranked, [c], "__rows")


def dense_rank_desc(df: DataFrame, by: Sequence[str], x: str, out: str = "rank") -> DataFrame:
    """Dense rank by descending score inside each (short) list, such as the importances of one model."""
    return df.withColumn(out, F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc(x))))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per group. Spark trims each group before the shuffle, so hot groups stay small."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col(out) <= k)


def moving_stats(
    df: DataFrame,
    key: Sequence[str],
    x: str,
    m: int,
    *,
    pos: str = "pos",
    span: int = 100_000,
) -> DataFrame:
    """Mean and population std of the ``m`` values starting at each position; incomplete windows dropped.

    Needs a dense 0-based position per key (see ``positions``). A long series is cut into spans; each span
    also gets the first m - 1 rows of the next one.
    """
    span = max(span, m)
    home = F.floor(F.col(pos) / span).cast("int")
    reach = F.floor((F.col(pos) - (m - 1)) / span).cast("int")
    cut = df.select(*key, pos, x).withColumn("__home", home)
    cut = cut.withColumn("__span", F.explode(F.array_distinct(F.array(home, F.greatest(F.lit(0), reach)))))
    w = Window.partitionBy(*key, "__span").orderBy(pos).rowsBetween(0, m - 1)
    stats = cut.withColumns(
        {
            "__full": F.count("*").over(w),
            "moving_mean": F.avg(x).over(w),
            "moving_std": F.stddev_pop(x).over(w),
        }
    )
    keep = (F.col("__full") == m) & (F.col("__span") == F.col("__home"))
    return stats.where(keep).select(*key, pos, "moving_mean", "moving_std")

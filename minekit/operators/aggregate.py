"""Group aggregates: counts, modes, shares, pivots, calendars."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minekit.functions.geo import haversine_km
from minekit.functions.maths import bucket_of
from minekit.scale import all_present, attach, one_row, quantiles


def group_agg(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """count, sum (0 for all-null groups), mean, std, min and max; rows without a key are left out."""
    return df.where(all_present(keys)).groupBy(*keys).agg(
        F.count(x).alias("count"),
        F.coalesce(F.sum(x), F.lit(0)).alias("sum"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts of the non-null values over one or several columns taken together."""
    values = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in cols])).alias("value"))
    return values.where("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, a: str, b: str, values: Sequence | None = None) -> DataFrame:
    """Contingency table: wide when the column ``values`` are given, else long."""
    if values is None:
        return df.groupBy(a, b).agg(F.count("*").alias("n"))
    return df.groupBy(a).agg(*[F.count_if(F.col(b) == v).alias(str(v)) for v in values])


def pivot(df: DataFrame, index: Sequence[str], c: str, value: str, values: Sequence, fill=0) -> DataFrame:
    """Long to wide over listed column values, gaps filled."""
    return df.groupBy(*index).pivot(c, list(values)).agg(F.first(value)).fillna(fill)


def entity_summary(
    df: DataFrame,
    keys: Sequence[str],
    *,
    year: str,
    week: str,
    years: Sequence[int],
    measures: Sequence[str],
    base: str,
    fatal: str,
    buckets: int = 4,
) -> DataFrame:
    """Wide per-entity summary in one aggregate, then quantile codes.

    Per year: rows, distinct weeks, sum and mean of every measure; overall: the same plus the mean of
    ``base``, the rows with ``fatal`` > 0 and their ratio. Distinct weeks are counted from a first
    aggregate by (entity, year, week), so rows are shuffled once, combined.
    """
    keys = list(keys)
    weekly = (
        df.where(all_present(keys))
        .groupBy(*keys, year, week)
        .agg(
            F.count("*").alias("rows"),
            F.sum(base).alias("base_sum"),
            F.count(base).alias("base_n"),
            F.count_if(F.col(fatal) > 0).alias("fatal"),
            *[F.sum(m).alias(f"{m}_s") for m in measures],
            *[F.count(m).alias(f"{m}_n") for m in measures],
        )
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    aggs = [
        (F.sum("base_sum") / F.sum("base_n")).alias(f"{base}_mean"),
        F.sum("rows").alias("rows"),
        F.count_distinct(week).alias("weeks"),
        F.sum("fatal").alias("fatal_rows"),
    ]
    for m in measures:
        aggs.append(zero(F.sum(f"{m}_s")).alias(m))
        aggs.append(F.try_divide(F.sum(f"{m}_s"), F.sum(f"{m}_n")).alias(f"{m}_mean"))
    for y in years:
        here = lambda c, y=y: F.when(F.col(year) == y, F.col(c))
        aggs.append(zero(F.sum(here("rows"))).alias(f"rows_{y}"))
        aggs.append(F.count_if((F.col(year) == y) & F.col(week).isNotNull()).alias(f"weeks_{y}"))
        for m in measures:
            aggs.append(zero(F.sum(here(f"{m}_s"))).alias(f"{m}_{y}"))
            mean = F.try_divide(F.sum(here(f"{m}_s")), F.sum(here(f"{m}_n")))
            aggs.append(mean.alias(f"{m}_mean_{y}"))
    wide = weekly.groupBy(*keys).agg(*aggs)
    wide = wide.withColumn("fatal_ratio", F.col("fatal_rows") / F.col("rows"))
    # every quantile edge from one pass over the entity table
    coded = [f"{base}_mean", "rows", "weeks", *measures]
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in coded]
    )
    inner = [i / buckets for i in range(1, buckets)]
    edges = quantiles(wide.select(F.inline(cells)), ["column"], "value", inner)
    found = one_row(edges.agg(F.map_from_entries(F.collect_list(F.struct("column", "q"))).alias("m")))["m"]
    cut = wide.withColumn("__edges", found)
    return cut.withColumns({f"{c}_quantile": bucket_of(c, F.col("__edges")[c]) for c in coded}).drop("__edges")


def mode_by(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """Most frequent value per group: highest count, then smallest value."""
    counts = df.where(F.col(c).isNotNull() & all_present(keys)).groupBy(*keys, c).agg(F.count("*").alias("n"))
    # smallest value among the highest counts: min over the struct (-count, value)
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(c).alias("v"))).alias("b"))
    return best.select(*keys, F.col("b.v").alias(c), (-F.col("b.n")).alias("n"))


def argmax_by(df: DataFrame, keys: Sequence[str], label: str, x: str) -> DataFrame:
    """Label with the highest mean of ``x`` per group (ties: smallest label)."""
    means = df.groupBy(*keys, label).agg(F.avg(x).alias("m"))
    best = means.groupBy(*keys).agg(F.min(F.struct((-F.col("m")).alias("m"), F.col(label).alias("v"))).alias("b"))
    return best.select(*keys, F.col("b.v").alias(label), (-F.col("b.m")).alias(f"{x}_mean"))


def column_modes(df: DataFrame, cols: Sequence[str], pairs: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Most frequent value of each column, and of each listed pair jointly (values joined by ``|``)."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]
    cells += [
        F.struct(
            F.lit(f"{a}|{b}").alias("column"),
            F.concat(F.col(a).cast("string"), F.lit("|"), F.col(b).cast("string")).alias("value"),
        )
        for a, b in pairs
    ]
    return mode_by(df.select(F.inline(F.array(*cells))), ["column"], "value")


def column_medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact median per column, long form."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]
    )
    found = quantiles(df.select(F.inline(cells)), ["column"], "value", [0.5])
    return found.select("column", F.col("q")[0].alias("median"))


def rate_per(df: DataFrame, keys: Sequence[str], pop: DataFrame, pop_col: str, scale: int = 100_000) -> DataFrame:
    """Rows per ``scale`` inhabitants by group."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    rate = F.try_divide(F.col("n") * scale, F.col(pop_col))
    return counts.join(pop.select(*keys, pop_col), list(keys), "left").withColumn("rate", rate)


def share_of_total(df: DataFrame, label: str, period: str) -> DataFrame:
    """Counts per (label, period) as percent of all rows of the period; rows without label count in the total."""
    counts = df.groupBy(period, label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(period))  # one row per label by now
    shares = counts.withColumn("percent", F.col("n") * 100 / total)
    return shares.where(F.col(label).isNotNull())


def extreme_groups(df: DataFrame, key: Sequence[str], lo: float = 0.25, hi: float = 0.75) -> DataFrame:
    """Groups whose row count lies below the ``lo`` or above the ``hi`` quantile of the counts."""
    counts = df.groupBy(*key).agg(F.count("*").alias("n"))
    q = one_row(quantiles(counts, [], "n", [lo, hi]).select("q"))["q"]
    side = F.when(F.col("n") < q[0], "low").when(F.col("n") > q[1], "high")
    return counts.withColumn("side", side).where("side is not null")


def daily_grid(df: DataFrame, date: str) -> DataFrame:
    """Rows per (year, month, day) of every year seen, zero-filled, without 29 February."""
    day = F.to_date(date)
    counts = df.groupBy(F.year(day).alias("year"), F.month(day).alias("month"), F.dayofmonth(day).alias("day"))
    counts = counts.agg(F.count("*").alias("n")).where("year is not null")
    ends = F.sequence(F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31)))
    days = counts.select("year").distinct().select("year", F.explode(ends).alias("d"))
    grid = days.select("year", F.month("d").alias("month"), F.dayofmonth("d").alias("day"))
    grid = grid.where("not (month = 2 and day = 29)")
    filled = grid.join(counts, ["year", "month", "day"], "left")
    return filled.withColumn("n", F.coalesce("n", F.lit(0)))


def tag_shares(df: DataFrame, tags: Mapping[str, Column]) -> DataFrame:
    """Count and percent of rows per (overlapping) predicate; the percent of an empty table is null."""
    wide = df.agg(F.count("*").alias("__rows"), *[F.count_if(p).alias(t) for t, p in tags.items()])
    long = wide.unpivot(["__rows"], list(tags), "tag", "n")
    return long.select("tag", "n", F.try_divide(F.col("n") * 100, F.col("__rows")).alias("percent"))


def fold_small(df: DataFrame, c: str, pct: float, other: str = "Other") -> DataFrame:
    """Value counts with the values below ``pct`` percent folded into one."""
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    total = one_row(counts.agg(F.sum("n").alias("t")))["t"]
    label = F.when(F.col("n") * 100 / total < pct, other).otherwise(F.col(c).cast("string"))
    return counts.groupBy(label.alias(c)).agg(F.sum("n").alias("n"))


def band_and_pivot(
    df: DataFrame, keys: Sequence[str], x: str, bands: Sequence[tuple[str, float, float]], value: str
) -> DataFrame:
    """Sum ``value`` into one column per band of ``x`` (bounds inclusive)."""
    return df.groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(F.when(F.col(x).between(lo, hi), F.col(value))), F.lit(0)).alias(name)
            for name, lo, hi in bands
        ]
    )


def split_band(df: DataFrame, src: str, parts: Mapping[str, float]) -> DataFrame:
    """Split a straddling band into columns by fixed fractions, cut to whole numbers."""
    return df.withColumns({name: (F.col(src) * f).cast("long") for name, f in parts.items()})


def region_stats(df: DataFrame, keys: Sequence[str], lat: str, lon: str) -> DataFrame:
    """Centroid, point count, and min / mean / max / 5..95 % quantiles of the distance to the centroid."""
    points = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & all_present(keys)).select(*keys, lat, lon)
    centre = points.groupBy(*keys).agg(
        F.count("*").alias("n_points"), F.avg(lat).alias("centroid_lat"), F.avg(lon).alias("centroid_lon")
    )
    tagged = attach(points, centre.withColumn("__rows", F.col("n_points")), keys, "__rows")
    far = tagged.withColumn("km", haversine_km(lat, lon, "centroid_lat", "centroid_lon"))
    spread = far.groupBy(*keys).agg(
        F.min("km").alias("min_km"), F.max("km").alias("max_km"), F.avg("km").alias("mean_km")
    )
    deciles = list(range(5, 100, 10))
    tens = quantiles(far, keys, "km", [d / 100 for d in [*deciles, 75]]).drop("n")
    out = centre.join(spread, list(keys)).join(tens, list(keys))
    return out.withColumns(
        {**{f"q{d:02d}": F.col("q")[i] for i, d in enumerate(deciles)}, "radius_km": F.col("q")[len(deciles)]}
    ).drop("q")


def top_groups(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The ``n`` most frequent groups, ties by key."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), *keys).limit(n)


def replace_partition(df: DataFrame, cond: Column, rows: DataFrame) -> DataFrame:
    """Drop the rows that satisfy ``cond`` and append replacement rows."""
    return df.where(~F.coalesce(cond, F.lit(False))).unionByName(rows)


def is_subset(a: DataFrame, b: DataFrame, c: str) -> DataFrame:
    """One row: number of distinct values of ``a`` missing in ``b`` and the verdict."""
    missing = a.select(c).where(F.col(c).isNotNull()).subtract(b.select(c))
    return missing.agg(F.count("*").alias("missing")).withColumn(
        "is_subset", (F.col("missing") == 0).cast("int")
    )

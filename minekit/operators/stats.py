"""Correlation, divergence, scaling, principal components, outlier factor."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minekit.functions.maths import safe_corr
from minekit.operators.joins import column_pairs
from minekit.scale import all_present, attach, one_row, quantiles, running_total, settle

CELLS = 500_000  # distinct value pairs that one task orders


def average_ranks(df: DataFrame, c: str, out: str) -> DataFrame:
    """1-based rank of each value, ties sharing their mean rank."""
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("__n"))
    below = running_total(counts, [], [F.col(c)], F.col("__n"), out="__below")
    ranks = below.withColumn(out, F.col("__below") + (F.col("__n") + 1) / 2).drop("__below")
    return attach(df, ranks, [c], "__n")


def _rank_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Spearman's correlation of every pair.

    Without nulls a column has the same ranks in all its pairs: the values of all columns are counted and ordered together, each
    column gets its ranks once, and one aggregate gives all pairs. With nulls, the rows of a pair depend on both.
    """
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    rows = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    values = rows.select(F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("v")) for i in range(len(cols))])))
    counts = settle(values.groupBy("c", "v").agg(F.count("*").alias("n")))
    if counts.where("v is null").isEmpty():
        below = running_total(counts, ["c"], [F.col("v")], F.col("n"), out="below")
        ranks = settle(below.select("c", "v", (F.col("below") + (F.col("n") + 1) / 2).alias("rank"), "n"))
        for i in range(len(cols)):
            own = ranks.where(F.col("c") == i).select(F.col("v").alias(f"v{i}"), F.col("rank").alias(f"r{i}"), "n")
            rows = attach(rows, own, [f"v{i}"], "n", written=True)
        at = {c: f"r{i}" for i, c in enumerate(cols)}
        wide = rows.agg(*[safe_corr(at[a], at[b]).alias(f"{a}|{b}") for a, b in pairs])
        names = F.split("__pair", r"\|")
        return wide.unpivot([], wide.columns, "__pair", "corr").select(names[0].alias("a"), names[1].alias("b"), "corr")
    out = None
    for a, b in pairs:
        both = df.where(all_present([a, b])).select(a, b)
        ranked = average_ranks(average_ranks(both, a, "__ra"), b, "__rb")
        part = ranked.agg(safe_corr("__ra", "__rb").alias("corr")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "corr")
        out = part if out is None else out.unionByName(part)
    return out


def inversions(values: np.ndarray, weights: np.ndarray) -> int:
    """Sum of ``weights[i] * weights[j]`` over ``i < j`` with ``values[i] > values[j]``.

    By the bits of the values' ranks, highest first: elements that agree in the higher bits stand together in their first order,
    each one whose bit is 0 meets the weight of those before it whose bit is 1. A step per bit, few where values are few.
    """
    n = len(values)
    if n < 2:
        return 0
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    kinds = int(rank.max()) + 1
    if int(weights.sum(dtype=object)) ** 2 >= 1 << 62:
        weights = weights.astype(object)  # products beyond a long
    total, place = 0, np.arange(n)
    for bit in reversed(range((kinds - 1).bit_length())):
        one = rank >> bit & 1 == 1
        higher = rank >> (bit + 1)
        begin = np.concatenate([[True], higher[1:] != higher[:-1]])
        first = np.maximum.accumulate(np.where(begin, place, 0))
        ones = np.concatenate([[0], np.cumsum(np.where(one, weights, 0))])
        zero = ~one
        total += int((weights[zero] * (ones[:-1][zero] - ones[first[zero]])).sum())
        # stable by the bit inside each run: zeros keep their order, then ones
        zeros = np.concatenate([[0], np.cumsum(zero)])
        last = np.append(np.flatnonzero(begin)[1:], n)[np.cumsum(begin) - 1]
        to = np.where(zero, first + zeros[:-1] - zeros[first], place + zeros[last] - zeros[:-1])
        moved, kept = np.empty_like(rank), np.empty_like(weights)
        moved[to], kept[to] = rank, weights
        rank, weights = moved, kept
    return total


def discordant(cells: DataFrame) -> DataFrame:
    """Weighted number of discordant pairs per group: ``g, d``, from distinct ``(g, x, y)`` with counts ``n``.

    In the order of (x, y) a pair is discordant if its y's are inverted. Cells are cut into ranges of (x, y). Pairs inside a range
    are counted there; of all others the range numbers and the y's tell, and the counts per range and y are a smaller problem of
    the same kind wherever y has few values. Other groups are cut into ranges of (y, x) as well: pairs inside a range of either
    kind are counted there, and the counts per pair of range numbers are the smaller problem.
    """
    parts = -(-cells.count() // CELLS)

    def count(order: Sequence[str]):
        def one(table: pa.Table) -> pa.Table:
            t = table.sort_by([(c, "ascending") for c in ("g", *order)])
            g, y, n = (t.column(c).to_numpy() for c in ("g", "y", "n"))
            cuts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
            sums = [Decimal(inversions(y[a:b], n[a:b])) for a, b in zip(cuts, cuts[1:])]
            return pa.table({"g": pa.array(g[cuts[:-1]], pa.int32()), "d": pa.array(sums, pa.decimal128(38, 0))})

        return one

    found = "g int, d decimal(38,0)"
    if parts <= 1:
        return cells.groupBy("g").applyInArrow(count(("x", "y")), found)
    by_x = settle(cells.repartitionByRange(parts, "g", "x", "y").withColumn("r", F.spark_partition_id()))
    inside = by_x.groupBy("r").applyInArrow(count(("x", "y")), found)
    r = F.col("r").cast("double").alias("x")
    by_value = settle(by_x.groupBy("g", r, "y").agg(F.sum("n").alias("n")))
    # one row per group: is the table of ranges and y's at most half as long as its cells?
    sizes = by_x.groupBy("g").agg(F.count("*").alias("cells")).join(by_value.groupBy("g").agg(F.count("*").alias("kept")), "g")
    few = [row["g"] for row in sizes.where("2 * kept <= cells").collect()]
    table, rest = by_value.where(F.col("g").isin(few)), by_x.where(~F.col("g").isin(few))
    both = inside
    if not rest.isEmpty():
        share = max(1, -(-rest.count() // CELLS))
        by_y = settle(rest.repartitionByRange(share, "g", "y", "x").withColumn("s", F.spark_partition_id()))
        both = both.unionByName(by_y.groupBy("s").applyInArrow(count(("r", "y")), found))
        table = table.unionByName(by_y.groupBy("g", r, F.col("s").cast("double").alias("y")).agg(F.sum("n").alias("n")))
    both = both.unionByName(discordant(settle(table)))
    return both.groupBy("g").agg(F.sum("d").alias("d"))


def _kendall(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Tau-b of every pair from its distinct combinations and their counts; null if a column is constant."""
    cell = [F.struct(F.lit(i).alias("g"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for i, (a, b) in enumerate(pairs)]
    cells = df.select(F.inline(F.array(*cell))).where("x is not null and y is not null").groupBy("g", "x", "y")
    cells = settle(cells.agg(F.count("*").alias("n")))
    ties = F.sum(F.col("n") * (F.col("n") - 1) / 2)

    def tied(by: str) -> DataFrame:
        groups = cells.groupBy("g", by).agg(F.sum("n").cast("double").alias("n"))
        return groups.groupBy("g").agg(ties.alias(f"in_{by}"), F.count("*").alias(f"kinds_{by}"))

    n = F.sum("n").cast("double")
    known = settle(cells.groupBy("g").agg((n * (n - 1) / 2).alias("all"), F.sum(F.col("n").cast("double") * (F.col("n").cast("double") - 1) / 2).alias("in_both")).join(tied("x"), "g").join(tied("y"), "g"))
    # discordance is the same either way round: the column of fewer values is y
    turned = [row["g"] for row in known.where("kinds_y > kinds_x").collect()]  # at most a row per pair
    turn = F.col("g").isin(turned)
    x, y = F.when(turn, F.col("y")).otherwise(F.col("x")), F.when(turn, F.col("x")).otherwise(F.col("y"))
    known = known.join(discordant(cells.select("g", x.alias("x"), y.alias("y"), "n")), "g")
    score = F.col("all") - F.col("in_x") - F.col("in_y") + F.col("in_both") - 2 * F.col("d").cast("double")
    tau = F.try_divide(score, F.sqrt((F.col("all") - F.col("in_x")) * (F.col("all") - F.col("in_y"))))
    names = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "g int, a string, b string")
    return names.join(known, "g", "left").select("a", "b", tau.alias("corr"))


def corr_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """Correlation of every column pair on the rows where both are present: ``a, b, corr``."""
    pairs = column_pairs(cols)
    if method == "pearson":
        wide = df.agg(*[safe_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
        long = wide.unpivot([], wide.columns, "__pair", "corr")
        names = F.split("__pair", r"\|")
        return long.select(names[0].alias("a"), names[1].alias("b"), "corr")
    if method == "kendall":
        return _kendall(df, pairs)
    if method == "spearman":
        return _rank_correlations(df, pairs)
    raise ValueError(f"unknown method {method!r}")


def correlated_pairs(corr: DataFrame, threshold: float) -> DataFrame:
    """Pairs with |corr| above the threshold, strongest first."""
    return corr.where(F.abs("corr") > threshold).orderBy(F.desc(F.abs("corr")), "a", "b")


def corr_by(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    return df.groupBy(key).agg(safe_corr(x, y).alias("corr"), F.count_if(all_present([x, y])).alias("n"))


def kl_divergence(df: DataFrame, c: str, group: str, bins: int = 20, smoothing: float = 1.0) -> DataFrame:
    """KL divergence of each group's histogram from the histogram of all rows, shared equal-width bins.

    ``smoothing`` is added to every cell.
    """
    values = df.where(all_present([c, group])).select(group, F.col(c).cast("double").alias("v"))
    s = one_row(values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
    width = (s["hi"] - s["lo"]) / bins
    raw = F.when(width > 0, F.floor((F.col("v") - s["lo"]) / width)).otherwise(0)
    binned = values.select(group, F.least(raw, F.lit(bins - 1)).cast("int").alias("bin"))
    counts = binned.groupBy(group, "bin").agg(F.count("*").alias("n"))
    everyone = counts.groupBy("bin").agg(F.sum("n").alias("all_n"))
    axis = counts.select(group).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = axis.join(counts, [group, "bin"], "left").join(everyone, "bin", "left")
    sizes = counts.groupBy(group).agg(F.sum("n").alias("g_rows"))
    total = one_row(counts.agg(F.sum("n").alias("t")))["t"]
    full = full.join(sizes, group)
    p = (F.coalesce("n", F.lit(0)) + smoothing) / (F.col("g_rows") + smoothing * bins)
    q = (F.coalesce("all_n", F.lit(0)) + smoothing) / (total + smoothing * bins)
    cells = full.withColumns({"p": p, "q": q})
    return cells.groupBy(group).agg(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("kl"))


def scale(train: DataFrame, test: DataFrame, cols: Sequence[str], how: str) -> tuple[DataFrame, DataFrame]:
    """Scale both tables with statistics of ``train``: minmax, standard (population std) or robust."""
    if how == "minmax":
        fit = train.agg(*[F.struct(F.min(c).alias("a"), (F.max(c) - F.min(c)).alias("b")).alias(c) for c in cols])
    elif how == "standard":
        fit = train.agg(*[F.struct(F.avg(c).alias("a"), F.stddev_pop(c).alias("b")).alias(c) for c in cols])
    elif how == "robust":
        cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in cols])
        q = quantiles(train.select(F.inline(cells)), ["c"], "v", [0.25, 0.5, 0.75])
        part = F.struct(F.col("q")[1].alias("a"), (F.col("q")[2] - F.col("q")[0]).alias("b"))
        fit = q.agg(*[F.first(F.when(F.col("c") == c, part), ignorenulls=True).alias(c) for c in cols])
    else:
        raise ValueError(f"unknown scaler {how!r}")
    stats = one_row(fit)

    def apply(df: DataFrame) -> DataFrame:
        marked = df.withColumn("__s", stats)
        flat = lambda c: F.when(F.col(f"__s.{c}.b") == 0, 1.0).otherwise(F.col(f"__s.{c}.b"))
        return marked.withColumns({c: (F.col(c) - F.col(f"__s.{c}.a")) / flat(c) for c in cols}).drop("__s")

    return apply(train), apply(test)


def pca(df: DataFrame, cols: Sequence[str], n: int, standardise: bool = False) -> tuple[DataFrame, DataFrame]:
    """Principal components: (rows with ``scores`` array and ``reconstruction_error``, variance table).

    The error of a row is its squared length outside the first ``n`` components. The variance table lists
    ratio and gap to the next component.
    """
    packed = df.withColumn("__raw", F.array(*[F.col(c).cast("double") for c in cols]))
    complete = packed.where(~F.exists("__raw", lambda x: x.isNull()))
    assembled = settle(complete.withColumn("__raw", array_to_vector("__raw")))
    scaler = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=standardise).fit(assembled)
    centred = scaler.transform(assembled)
    full = PCA(k=len(cols), inputCol="__x", outputCol="__pc").fit(centred)
    scored = full.transform(centred).withColumn("__all", vector_to_array("__pc"))
    tail = F.slice("__all", n + 1, len(cols))
    error = F.aggregate(tail, F.lit(0.0), lambda acc, x: acc + x * x)
    scored = scored.withColumn("scores", F.slice("__all", 1, n)).withColumn("reconstruction_error", error)
    ratios = [float(x) for x in full.explainedVariance]
    table = [(i + 1, v, v - ratios[i + 1] if i + 1 < len(ratios) else None) for i, v in enumerate(ratios)]
    variance = df.sparkSession.createDataFrame(table, "component int, variance_ratio double, gap double")
    return scored.drop("__raw", "__x", "__pc", "__all"), variance


def lof(neighbours: DataFrame, row_id: str, nn: str) -> DataFrame:
    """Local outlier factor from a k-nearest-neighbour table (``row_id, nn, dist``).

    Reachability of a neighbour is at least that neighbour's own k-distance.
    """
    reach = neighbours.groupBy(F.col(row_id).alias(nn)).agg(F.max("dist").alias("__kdist"))
    far = neighbours.join(reach, nn).withColumn("__reach", F.greatest("dist", "__kdist"))
    density = far.groupBy(row_id).agg((1 / (F.avg("__reach") + 1e-10)).alias("density"))
    other = density.select(F.col(row_id).alias(nn), F.col("density").alias("__other"))
    mixed = neighbours.join(other, nn).join(density, row_id)
    return mixed.groupBy(row_id).agg((F.avg("__other") / F.first("density")).alias("lof"))

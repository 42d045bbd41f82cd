"""Training data: splits, balancing, folds, missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minekit.operators.joins import knn_vectors
from minekit.operators.profile import row_hash
from minekit.scale import attach, number_rows, one_row


def stratified_split(
    df: DataFrame, label: str, test: float, row_id: str, seed: int = 42, out: str = "is_test"
) -> DataFrame:
    """Mark exactly floor(n * test + 0.5) rows of every stratum as test rows, by hash order of the id."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("__rows"))
    wanted = sizes.withColumn("__test", F.floor(F.col("__rows") * test + 0.5))
    order = [row_hash(row_id, seed), F.col(row_id)]
    ranked = number_rows(df.select(row_id, label).withColumn("__h", order[0]), [label], [F.col("__h"), order[1]], out="__rn")
    marked = attach(ranked, wanted, [label], "__rows").select(row_id, (F.col("__rn") < F.col("__test")).alias(out))
    return df.join(marked, row_id)


def fold_column(df: DataFrame, label: str, folds: int, row_id: str, seed: int = 42, out: str = "fold") -> DataFrame:
    """Stratified fold number 0..folds-1: position in the stratum's hash order modulo the fold count."""
    ranked = number_rows(
        df.select(row_id, label).withColumn("__h", row_hash(row_id, seed)), [label], [F.col("__h"), F.col(row_id)], out="__rn"
    )
    return df.join(ranked.select(row_id, F.pmod("__rn", F.lit(folds)).cast("int").alias(out)), row_id)


def oversample(df: DataFrame, label: str, minority, ratio: float, row_id: str, seed: int = 42) -> DataFrame:
    """Repeat minority rows until minority / rest = ``ratio``; ``copy`` numbers the repetitions.

    Every minority row is repeated equally often, the first rows in hash order once more.
    """
    is_minor = F.coalesce(F.col(label) == F.lit(minority), F.lit(False))
    sizes = df.agg(F.count_if(is_minor).alias("few"), F.count_if(~is_minor).alias("many"))
    s = one_row(sizes.withColumn("want", F.greatest(F.col("few"), F.floor(F.col("many") * ratio))))
    few = number_rows(
        df.where(is_minor).withColumn("__h", row_hash(row_id, seed)), [], [F.col("__h"), F.col(row_id)], out="__rn"
    )
    times = F.floor(s["want"] / s["few"]) + F.when(F.col("__rn") < s["want"] % s["few"], 1).otherwise(0)
    few = few.withColumn("copy", F.explode(F.sequence(F.lit(0), times.cast("int") - 1))).drop("__h", "__rn")
    return df.where(~is_minor).withColumn("copy", F.lit(0)).unionByName(few)


def smote_nc(
    df: DataFrame,
    label: str,
    minority,
    num: Sequence[str],
    cat: Sequence[str],
    ratio: float,
    row_id: str,
    k: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Synthetic minority rows: numbers between a row and one hashed neighbour, categories by neighbour mode.

    The neighbours are the ``k`` nearest minority rows over ``num``. Synthetic rows have a null id and
    ``synthetic`` true.
    """
    point = F.array(*[F.col(c).cast("double") for c in num])
    few = df.where(F.col(label) == F.lit(minority)).withColumn("__v", point)
    near = knn_vectors(few, few.withColumnRenamed(row_id, "ref"), query_id=row_id, ref_id="ref", vector="__v", k=k, strict=True)
    sizes = df.agg(F.count_if(F.col(label) == F.lit(minority)).alias("few"), F.count_if(F.col(label) != F.lit(minority)).alias("many"))
    s = one_row(sizes.withColumn("more", F.greatest(F.lit(0), F.floor(F.col("many") * ratio) - F.col("few"))))
    ranked = number_rows(few.withColumn("__h", row_hash(row_id, seed)), [], [F.col("__h"), F.col(row_id)], out="__rn")
    times = F.floor(s["more"] / s["few"]) + F.when(F.col("__rn") < s["more"] % s["few"], 1).otherwise(0)
    # a row that gets no synthetic copy has an empty range
    seeds = ranked.withColumn("__copies", times.cast("int")).where("__copies > 0")
    seeds = seeds.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    mix = F.xxhash64(row_id, "__copy", F.lit(seed))
    seeds = seeds.withColumns(
        {"rank": (F.pmod(mix, F.lit(k)) + 1).cast("int"), "__gap": F.pmod(F.xxhash64(mix), F.lit(1 << 20)) / (1 << 20)}
    )
    other = few.select(F.col(row_id).alias("nn_ref"), *[F.col(c).alias(f"__o_{c}") for c in [*num, *cat]])
    around = near.select(row_id, "nn_ref", "rank").join(other, "nn_ref")
    modes = around.select(row_id).distinct()
    for c in cat:
        counts = around.groupBy(row_id, f"__o_{c}").agg(F.count("*").alias("n"))
        best = counts.groupBy(row_id).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(f"__o_{c}").alias("v"))).alias("b"))
        modes = modes.join(best.select(row_id, F.col("b.v").alias(f"__m_{c}")), row_id)
    made = seeds.join(around, [row_id, "rank"]).join(modes, row_id)
    values = {c: (F.col(c) + F.col("__gap") * (F.col(f"__o_{c}") - F.col(c))).alias(c) for c in num}
    values |= {c: F.col(f"__m_{c}").alias(c) for c in cat}
    values[row_id] = F.lit(None).cast(df.schema[row_id].dataType).alias(row_id)
    new = made.select(*[values.get(c, F.col(c)) for c in df.columns], F.lit(True).alias("synthetic"))
    return df.withColumn("synthetic", F.lit(False)).unionByName(new)


def missing_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill missing numbers with the column mean and add ``<c>_missing`` flags."""
    means = one_row(df.agg(*[F.avg(c).alias(c) for c in cols]))
    out: dict[str, Column] = {f"{c}_missing": F.col(c).isNull().cast("double") for c in cols}
    out |= {c: F.coalesce(F.col(c).cast("double"), means[c]) for c in cols}
    return df.withColumns(out)


def default_vectors(df: DataFrame, label: str, num: Sequence[str], cat: Sequence[str]) -> DataFrame:
    """Default feature value per class, long form: median of numbers, mode of categories (as text)."""
    from minekit.operators.aggregate import mode_by
    from minekit.scale import quantiles

    numbers = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in num])
    med = quantiles(df.select(label, F.inline(numbers)), [label, "feature"], "v", [0.5])
    out = med.select(label, "feature", F.col("q")[0].cast("string").alias("value"))
    if cat:
        texts = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in cat])
        modes = mode_by(df.select(label, F.inline(texts)), [label, "feature"], "v")
        out = out.unionByName(modes.select(label, "feature", F.col("v").alias("value")))
    return out


def median_split(df: DataFrame, c: str, out: str = "above_median") -> DataFrame:
    """1 above the median, else 0."""
    from minekit.scale import quantiles

    middle = one_row(quantiles(df, [], c, [0.5]))["q"][0]
    return df.withColumn(out, (F.col(c) > middle).cast("int"))

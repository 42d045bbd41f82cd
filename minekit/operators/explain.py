"""Batch explanation of classifier predictions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minekit.functions.maths import safe_corr
from minekit.operators.models import assemble, positive_probability
from minekit.scale import one_row, quantiles


def local_explain(
    model: Model,
    train: DataFrame,
    instances: DataFrame,
    features: Sequence[str],
    row_id: str,
    samples: int = 1000,
    ridge: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """Local linear weights for many instances at once: ``row_id, feature, weight``.

    Samples are normal around the training means; a feature is encoded as "same quartile bin as the
    instance", weighted by an exponential kernel of width 0.75 sqrt(d). All samples are scored in one batch;
    the weighted normal equations of an instance are sums over its samples, solved per instance.
    """
    d = len(features)
    cells = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v")) for f in features])
    moments = one_row(train.agg(*[F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f) for f in features]))
    edges = quantiles(train.select(F.inline(cells)), ["f"], "v", [0.25, 0.5, 0.75])
    by_feature = one_row(edges.agg(F.map_from_entries(F.collect_list(F.struct("f", "q"))).alias("m")))["m"]
    base = instances.select(row_id, *[F.col(f).cast("double").alias(f"__i_{f}") for f in features])
    drawn = base.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumns(
        {"__m": moments, "__e": by_feature}
    )
    # Box-Muller on hashed uniforms; sample 0 is the instance itself
    unit = lambda i, k: (F.pmod(F.xxhash64(row_id, "__s", F.lit(seed), F.lit(i), F.lit(k)), F.lit(1 << 30)) + 1) / ((1 << 30) + 1)
    draws = {}
    for i, f in enumerate(features):
        normal = F.sqrt(-2 * F.ln(unit(i, 0))) * F.cos(2 * math.pi * unit(i, 1))
        draws[f] = F.when(F.col("__s") == 0, F.col(f"__i_{f}")).otherwise(F.col(f"__m.{f}.m") + normal * F.col(f"__m.{f}.s"))
    rows = drawn.withColumns(draws)
    bin_of = lambda v, f: F.size(F.filter(F.element_at("__e", F.lit(f)), lambda e: e < v))
    same = [(bin_of(F.col(f), f) == bin_of(F.col(f"__i_{f}"), f)).cast("double") for f in features]
    rows = rows.withColumn("__z", F.array(*same)).drop("__m", "__e")
    scored = positive_probability(model.transform(assemble(rows, features)), "__y")
    away = d - F.aggregate("__z", F.lit(0.0), lambda a, x: a + x)
    width = 0.75 * math.sqrt(d)
    weighted = scored.withColumn("__w", F.sqrt(F.exp(-away / (width * width))))
    z = [F.lit(1.0), *[F.col("__z")[i] for i in range(d)]]
    sums = [F.sum(F.col("__w") * z[i] * z[j]) for i in range(d + 1) for j in range(i, d + 1)]
    tops = [F.sum(F.col("__w") * z[i] * F.col("__y")) for i in range(d + 1)]
    normal = weighted.groupBy(row_id).agg(F.array(*sums).alias("a"), F.array(*tops).alias("b"))
    id_type = instances.schema[row_id].dataType.simpleString()

    def solve(batches):
        for pdf in batches:
            out = []
            for key, a, b in zip(pdf[row_id], pdf["a"], pdf["b"]):
                m = np.zeros((d + 1, d + 1))
                m[np.triu_indices(d + 1)] = a
                m = m + np.triu(m, 1).T + ridge * np.diag([0.0] + [1.0] * d)
                out += [(key, f, w) for f, w in zip(features, np.linalg.solve(m, np.asarray(b))[1:])]
            yield pd.DataFrame(out, columns=[row_id, "feature", "weight"])

    return normal.mapInPandas(solve, f"{row_id} {id_type}, feature string, weight double")


def replacement_scores(
    model: Model, instances: DataFrame, features: Sequence[str], row_id: str, defaults: Mapping[str, float]
) -> DataFrame:
    """Probability of class 1 after replacing each feature by its default: ``row_id, feature, prob``."""
    variants = [
        F.struct(
            F.lit(f).alias("feature"),
            *[(F.lit(float(defaults[c])) if c == f else F.col(c).cast("double")).alias(c) for c in features],
        )
        for f in features
    ]
    wide = instances.select(row_id, F.inline(F.array(*variants)))
    return positive_probability(model.transform(assemble(wide, features))).select(row_id, "feature", "prob")


def faithfulness(scores: DataFrame, row_id: str, weight: str = "weight", prob: str = "prob") -> DataFrame:
    """-corr(importance, probability after replacement) per instance; null for constant input."""
    return scores.groupBy(row_id).agg((-safe_corr(weight, prob)).alias("faithfulness"))


def addition_scores(
    model: Model, explained: DataFrame, instances: DataFrame, features: Sequence[str], row_id: str, defaults: Mapping[str, float]
) -> DataFrame:
    """Probability when features are added to the default row by increasing weight: ``row_id, step, prob``."""
    order = explained.groupBy(row_id).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("weight", "feature"))), lambda s: s["feature"]).alias("__order")
    )
    steps = instances.join(order, row_id).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    taken = F.slice("__order", F.lit(1), F.col("step"))
    filled = steps.withColumn("__on", taken).withColumns(
        {
            c: F.when(F.array_contains("__on", c), F.col(c).cast("double")).otherwise(float(defaults[c]))
            for c in features
        }
    )
    return positive_probability(model.transform(assemble(filled, features))).select(row_id, "step", "prob")


def monotonicity(scores: DataFrame, row_id: str, step: str = "step", prob: str = "prob") -> DataFrame:
    """True when the probability never falls while features are added (a handful of steps per instance)."""
    change = F.col(prob) - F.lag(prob).over(Window.partitionBy(row_id).orderBy(step))
    return scores.withColumn("__d", change).groupBy(row_id).agg(
        F.coalesce(F.min("__d") >= 0, F.lit(True)).alias("monotone")
    )


def explain_summary(tables: Mapping[str, DataFrame], value: str = "faithfulness") -> DataFrame:
    """Mean and population std of a metric per explainer, nulls and NaN ignored."""
    out = None
    for name, df in tables.items():
        clean = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
        row = df.select(F.lit(name).alias("explainer"), clean.alias("v"))
        out = row if out is None else out.unionByName(row)
    return out.groupBy("explainer").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("v").alias("n"))

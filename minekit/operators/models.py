"""Classifiers: distance based and Bayes as Spark expressions, trees and networks from pyspark.ml."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minekit.operators.cluster_scores import sq_dist
from minekit.operators.evaluate import clf_scores
from minekit.operators.joins import knn_vectors
from minekit.operators.prepare import fold_column
from minekit.operators.profile import row_hash
from minekit.scale import enrich, one_row, quantiles, settle


def nearest_centroid(
    train: DataFrame, test: DataFrame, vector: str, label: str, metric: str = "euclidean", out: str = "predicted"
) -> DataFrame:
    """Label of the nearest class centre: means for Euclidean, medians for Manhattan distance.

    The centres (one vector per class) travel as one literal array; test rows are scored without a shuffle.
    """
    cells = train.select(label, F.posexplode(vector).alias("i", "x"))
    if metric == "euclidean":
        centre = cells.groupBy(label, "i").agg(F.avg("x").alias("m"))
    elif metric == "manhattan":
        centre = quantiles(cells, [label, "i"], "x", [0.5]).select(label, "i", F.col("q")[0].alias("m"))
    else:
        raise ValueError(f"unknown metric {metric!r}")
    rows = centre.groupBy(label).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v")
    )
    everyone = one_row(rows.agg(F.collect_list(F.struct(F.col(label).alias("label"), "v")).alias("c")))["c"]
    marked = test.withColumn("__all", everyone)
    x = F.transform(vector, lambda v: v.cast("double"))

    def dist(c: Column) -> Column:
        if metric == "euclidean":
            return sq_dist(x, c["v"])
        return F.aggregate(F.zip_with(x, c["v"], lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, v: acc + v)

    scored = F.transform("__all", lambda c: F.struct(dist(c).alias("d"), c["label"].alias("label")))
    return marked.withColumn(out, F.array_min(scored)["label"]).drop("__all")


def knn_classify(
    train: DataFrame,
    test: DataFrame,
    row_id: str,
    vector: str,
    label: str,
    k: int,
    weights: str = "uniform",
    p: int = 2,
    out: str = "predicted",
) -> DataFrame:
    """Vote of the ``k`` nearest training rows, uniform or by inverse distance (exact hits outvote the rest).

    Ties go to the smallest label.
    """
    refs = train.select(F.col(row_id).alias("ref"), vector, label)
    near = knn_vectors(test, refs, query_id=row_id, ref_id="ref", vector=vector, k=k, p=p)
    voted = near.join(refs.select(F.col("ref").alias("nn_ref"), label), "nn_ref")
    if weights == "distance":
        hits = voted.groupBy(row_id).agg(F.min("dist").alias("__least"))
        voted = voted.join(hits, row_id)
        weight = F.when(F.col("__least") == 0, (F.col("dist") == 0).cast("double")).otherwise(1 / F.col("dist"))
    else:
        weight = F.lit(1.0)
    votes = voted.groupBy(row_id, label).agg(F.sum(weight).alias("w"))
    best = votes.groupBy(row_id).agg(F.min(F.struct((-F.round("w", 9)).alias("w"), F.col(label).alias("v"))).alias("b"))
    return test.join(best.select(row_id, F.col("b.v").alias(out)), row_id, "left")


VAR_SMOOTHING = 1e-9


def mixed_nb(
    train: DataFrame,
    test: DataFrame,
    label: str,
    num: Sequence[str],
    cat: Sequence[str],
    alpha: float = 0.5,
    out: str = "predicted",
) -> DataFrame:
    """Naive Bayes with Gaussian numbers and smoothed categories; adds ``<out>`` and ``log_posterior``.

    Categories unseen in training count as zero occurrences. Class statistics come from one aggregate;
    category counts are small tables joined on the value.
    """
    # a class without spread is narrow, not impossible: no variance is below a small share of the largest
    spread = train.agg(F.coalesce(F.greatest(*[F.var_pop(c) for c in [*num, *num]]), F.lit(0.0)).alias("v")) if num else None
    floor = F.greatest(one_row(spread)["v"] * VAR_SMOOTHING, F.lit(1e-300)) if num else F.lit(0.0)
    stats = train.groupBy(label).agg(
        F.count("*").cast("double").alias("n"),
        F.array(*[F.avg(c) for c in num]).alias("mean") if num else F.array().cast("array<double>").alias("mean"),
        F.array(*[F.greatest(F.var_pop(c), floor) for c in num]).alias("var") if num else F.array().cast("array<double>").alias("var"),
    )
    everyone = stats.agg(
        F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "n", "mean", "var"))).alias("c"),
        F.sum("n").alias("total"),
    )
    scored = test.withColumn("__nb", one_row(everyone))
    for c in cat:
        counts = train.where(F.col(c).isNotNull()).groupBy(c, label).agg(F.count("*").alias("n"))
        table = counts.groupBy(c).agg(F.map_from_entries(F.collect_list(F.struct(label, "n"))).alias(f"__c_{c}"))
        levels = one_row(train.agg(F.count_distinct(c).alias("k")))["k"]
        scored = enrich(scored, table, [c]).withColumn(f"__k_{c}", levels)
    numbers = F.array(*[F.col(c).cast("double") for c in num]) if num else F.array().cast("array<double>")

    def log_posterior(c: Column) -> Column:
        gauss = F.zip_with(
            numbers,
            F.arrays_zip(c["mean"].alias("m"), c["var"].alias("v")),
            lambda x, s: F.coalesce(-0.5 * F.ln(2 * math.pi * s["v"]) - F.pow(x - s["m"], 2) / (2 * s["v"]), F.lit(0.0)),
        )
        total = F.ln(c["n"] / F.col("__nb.total")) + F.aggregate(gauss, F.lit(0.0), lambda a, x: a + x)
        for name in cat:
            seen = F.coalesce(F.element_at(f"__c_{name}", c["label"]), F.lit(0))
            share = F.ln((seen + alpha) / (c["n"] + alpha * F.col(f"__k_{name}")))
            total = total + F.when(F.col(name).isNull(), 0.0).otherwise(share)
        return total

    ranked = F.transform("__nb.c", lambda c: F.struct((-log_posterior(c)).alias("d"), c["label"].alias("label")))
    best = scored.withColumn("__best", F.array_min(ranked))
    helpers = ["__nb", "__best", *[f"__c_{c}" for c in cat], *[f"__k_{c}" for c in cat]]
    return best.withColumns({out: F.col("__best.label"), "log_posterior": -F.col("__best.d")}).drop(*helpers)


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


def with_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight n / (classes * n_class) per row, so all classes weigh the same."""
    sizes = df.groupBy(label).agg(F.count("*").cast("double").alias("__n"))
    s = one_row(sizes.agg(F.sum("__n").alias("n"), F.count("*").alias("k")))
    table = sizes.select(label, (s["n"] / (s["k"] * F.col("__n"))).alias(out))
    return enrich(df, table, [label])


def tree(features: Sequence[str], label: str, weight: str | None = None, **params) -> Estimator:
    return _ml(DecisionTreeClassifier, label, weight, params)


def forest(features: Sequence[str], label: str, weight: str | None = None, **params) -> Estimator:
    return _ml(RandomForestClassifier, label, weight, params)


def boosted(features: Sequence[str], label: str, weight: str | None = None, **params) -> Estimator:
    return _ml(GBTClassifier, label, weight, params)


def linear_svm(features: Sequence[str], label: str, weight: str | None = None, **params) -> Estimator:
    return _ml(LinearSVC, label, weight, params)


def mlp(features: Sequence[str], label: str, hidden: Sequence[int] = (16,), classes: int = 2, **params) -> Estimator:
    return MultilayerPerceptronClassifier(
        labelCol=label, featuresCol="features", layers=[len(features), *hidden, classes], **params
    )


def _ml(kind, label: str, weight: str | None, params: Mapping) -> Estimator:
    est = kind(labelCol=label, featuresCol="features", **params)
    return est.setWeightCol(weight) if weight else est


def positive_probability(df: DataFrame, out: str = "prob") -> DataFrame:
    """Probability of class 1, or the squashed margin for models without probabilities."""
    if "probability" in df.columns:
        return df.withColumn(out, vector_to_array("probability")[1])
    margin = vector_to_array("rawPrediction")[1]
    return df.withColumn(out, 1 / (1 + F.exp(-margin)))


def fit_predict(est: Estimator, train: DataFrame, test: DataFrame, features: Sequence[str]) -> tuple[Model, DataFrame]:
    """Fit on ``train`` and score ``test``: adds ``prediction`` and ``prob``."""
    model = est.fit(assemble(train, features))
    return model, positive_probability(model.transform(assemble(test, features)))


def adaboost(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str, n: int, depth: int = 1, seed: int = 42
) -> DataFrame:
    """SAMME boosting of ``n`` weighted trees for a 0/1 label; adds ``prediction`` and ``prob``.

    The row weights are a column; every round is checkpointed, so a lost executor replays one round only.
    """
    rows = settle(assemble(train, features).withColumn("weight", F.lit(1.0)))
    scored = assemble(test, features).withColumn("__vote", F.lit(0.0))
    total = 0.0
    for _ in range(n):
        model = DecisionTreeClassifier(
            labelCol=label, featuresCol="features", weightCol="weight", maxDepth=depth, seed=seed,
            predictionCol="__p", rawPredictionCol="__raw", probabilityCol="__prob",
        ).fit(rows)
        rows = model.transform(rows).drop("__raw", "__prob")
        wrong = F.col("__p") != F.col(label)
        err = rows.agg((F.sum(F.when(wrong, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("e")).first()["e"]
        if err >= 0.5:
            break
        alpha = math.log((1 - err) / max(err, 1e-12))
        total += alpha
        rows = settle(rows.withColumn("weight", F.when(wrong, F.col("weight") * math.exp(alpha)).otherwise(F.col("weight"))).drop("__p"))
        vote = F.when(F.col("__p") == 1, alpha).otherwise(-alpha)
        scored = model.transform(scored).withColumn("__vote", F.col("__vote") + vote).drop("__p", "__raw", "__prob")
        if err == 0:
            break
    prob = (F.col("__vote") / max(total, 1e-12) + 1) / 2
    out = {"prediction": (F.col("__vote") > 0).cast("double"), "prob": prob}
    return scored.withColumns(out).drop("__vote")


def grid_search(
    build: Callable[..., Estimator],
    grid: Mapping[str, Sequence],
    df: DataFrame,
    features: Sequence[str],
    label: str,
    row_id: str,
    folds: int = 5,
    metric: str = "f1_1",
    seed: int = 42,
) -> tuple[DataFrame, dict]:
    """Stratified k-fold search: (one row per parameter set with mean / std score and rank, best parameters).

    ``build(features, label, **params)`` makes an estimator. The folds are fixed by id hash and written once.
    """
    folded = settle(fold_column(df, label, folds, row_id, seed))
    names = list(grid)
    table = []
    for values in itertools.product(*grid.values()):
        params = dict(zip(names, values))
        scores = []
        for f in range(folds):
            _, pred = fit_predict(
                build(features, label, **params), folded.where(F.col("fold") != f), folded.where(F.col("fold") == f), features
            )
            pred = pred.withColumn("prediction", F.col("prediction").cast("int"))
            scores.append(float(clf_scores(pred, label, "prediction").first()[metric]))
        mean = sum(scores) / folds
        table.append((*values, mean, math.sqrt(sum((s - mean) ** 2 for s in scores) / folds)))
    order = sorted(table, key=lambda row: -row[-2])
    ranked = [(*row, 1 + sum(r[-2] > row[-2] for r in table)) for row in order]
    results = df.sparkSession.createDataFrame(ranked, [*names, "mean_score", "std_score", "rank"])
    return results, dict(zip(names, order[0][: len(names)]))


def shuffle_search(
    build, grid, df: DataFrame, features, label: str, row_id: str, n: int = 3, test: float = 1 / 3, metric: str = "f1_1", seed: int = 42
) -> DataFrame:
    """Repeated stratified shuffle splits instead of folds; one row per parameter set."""
    from minekit.operators.prepare import stratified_split

    names, table = list(grid), []
    splits = [settle(stratified_split(df, label, test, row_id, seed + i)) for i in range(n)]
    for values in itertools.product(*grid.values()):
        scores = []
        for s in splits:
            est = build(features, label, **dict(zip(names, values)))
            _, pred = fit_predict(est, s.where("not is_test"), s.where("is_test"), features)
            pred = pred.withColumn("prediction", F.col("prediction").cast("int"))
            scores.append(float(clf_scores(pred, label, "prediction").first()[metric]))
        table.append((*values, sum(scores) / n))
    return df.sparkSession.createDataFrame(table, [*names, "mean_score"])


def learning_curve(
    build, df: DataFrame, features, label: str, row_id: str, fractions: Sequence[float], folds: int = 3, metric: str = "f1_1", seed: int = 42
) -> DataFrame:
    """Cross-validated score by training fraction; a fraction is a prefix of the id hash order."""
    from minekit.operators.profile import HASH_M

    folded = settle(fold_column(df, label, folds, row_id, seed).withColumn("__h", row_hash(row_id, seed + 1)))
    out = []
    for share in fractions:
        scores = []
        for f in range(folds):
            train = folded.where((F.col("fold") != f) & (F.col("__h") < share * HASH_M))
            _, pred = fit_predict(build(features, label), train, folded.where(F.col("fold") == f), features)
            pred = pred.withColumn("prediction", F.col("prediction").cast("int"))
            scores.append(float(clf_scores(pred, label, "prediction").first()[metric]))
        out.append((float(share), sum(scores) / folds))
    return df.sparkSession.createDataFrame(out, "fraction double, mean_score double")


def permutation_importance(
    model: Model, df: DataFrame, features: Sequence[str], label: str, row_id: str, metric: str = "accuracy", seed: int = 42
) -> DataFrame:
    """Score drop after shuffling one feature: rows are paired with another row's value by hash rank.

    All features are shuffled in one table and scored in one pass.
    """
    from minekit.scale import number_rows

    ranked = number_rows(df.withColumn("__h", row_hash(row_id, seed)), [], [F.col("__h"), F.col(row_id)], out="__rank")
    ranked = settle(ranked)
    n = ranked.count()
    shift = max(1, n // 2 + 1)
    donors = ranked.select(
        F.pmod(F.col("__rank") + shift, F.lit(n)).alias("__rank"), *[F.col(c).alias(f"__d_{c}") for c in features]
    )
    both = ranked.join(donors, "__rank")
    variants = [F.struct(F.lit("none").alias("feature"), *[F.col(c).cast("double").alias(c) for c in features])]
    for f in features:
        variants.append(
            F.struct(F.lit(f).alias("feature"), *[F.col(f"__d_{c}" if c == f else c).cast("double").alias(c) for c in features])
        )
    wide = both.select(row_id, label, F.inline(F.array(*variants)))
    scored = model.transform(assemble(wide, features))
    if metric == "accuracy":
        hits = scored.groupBy("feature").agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("score"))
    else:  # one small score table per feature
        scored = settle(scored.select("feature", label, F.col("prediction").cast("int").alias("prediction")))
        named = [clf_scores(scored.where(F.col("feature") == f), label, "prediction").select(F.lit(f).alias("feature"), F.col(metric).alias("score")) for f in ["none", *features]]
        hits = functools.reduce(DataFrame.unionByName, named)
    base = one_row(hits.where("feature = 'none'"))["score"]
    return hits.where("feature <> 'none'").select("feature", (base - F.col("score")).alias("importance"))


def importance_table(spark, models: Mapping[str, Model], features: Sequence[str]) -> DataFrame:
    """Impurity importances of several models: ``model, feature, importance, rank``."""
    from minekit.operators.indicators import dense_rank_desc

    rows = [
        (name, f, float(v)) for name, m in models.items() for f, v in zip(features, m.featureImportances.toArray())
    ]
    long = spark.createDataFrame(rows, "model string, feature string, importance double")
    return dense_rank_desc(long, ["model"], "importance")

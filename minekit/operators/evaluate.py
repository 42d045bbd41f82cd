"""Classifier evaluation as aggregates over prediction tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minekit.scale import one_row, running_total


def _score_steps(df: DataFrame, label: str, prob: str) -> DataFrame:
    """Per distinct score: positives, negatives and the counts above it (running totals, highest first)."""
    steps = df.where(F.col(prob).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(prob).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    above = running_total(steps, [], [F.desc("score")], F.col("pos"), out="pos_above")
    return running_total(above, [], [F.desc("score")], F.col("neg"), out="neg_above")


def auroc(df: DataFrame, label: str, prob: str) -> DataFrame:
    """Area under the ROC curve; tied scores count half. Null if there is one class only."""
    steps = _score_steps(df, label, prob)
    wins = F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2))
    return steps.agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auroc"))


def roc(df: DataFrame, label: str, prob: str) -> DataFrame:
    """ROC points, one per distinct score: ``threshold, fpr, tpr``; the rate of a class without rows is null."""
    steps = _score_steps(df, label, prob)
    total = one_row(steps.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")))
    return steps.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("neg_above") + F.col("neg"), total["n"]).alias("fpr"),
        F.try_divide(F.col("pos_above") + F.col("pos"), total["p"]).alias("tpr"),
    )


def calibration(df: DataFrame, label: str, prob: str, bins: int = 10) -> DataFrame:
    """Mean prediction against observed rate per equal-width bin of [0, 1]; empty bins left out."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return df.groupBy(b).agg(
        F.count("*").alias("n"), F.avg(prob).alias("mean_prediction"), F.avg(F.col(label).cast("double")).alias("observed")
    )


def class_scores(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per class: support, precision, recall and F1 (0 where undefined)."""
    cells = df.groupBy(F.col(label).cast("string").alias("l"), F.col(pred).cast("string").alias("p")).agg(F.count("*").alias("n"))
    sides = F.array(
        F.struct(F.col("l").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("hit")),
    )
    sums = cells.select(F.inline(sides)).groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    precision = zero(F.try_divide(F.col("hit"), F.col("predicted")))
    recall = zero(F.try_divide(F.col("hit"), F.col("support")))
    rated = sums.where("class is not null").withColumns({"precision": precision, "recall": recall})
    return rated.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def clf_scores(df: DataFrame, label: str, pred: str, prob: str | None = None, classes: Sequence = (0, 1)) -> DataFrame:
    """One row: precision, recall, F1 per class, macro and weighted means, accuracy, ROC AUC."""
    per = class_scores(df, label, pred)
    kinds = ("precision", "recall", "f1")
    aggs = []
    for k in kinds:
        for cls in classes:
            aggs.append(F.coalesce(F.max(F.when(F.col("class") == str(cls), F.col(k))), F.lit(0.0)).alias(f"{k}_{cls}"))
        aggs.append(F.avg(k).alias(f"macro_{k}"))
        aggs.append((F.sum(F.col(k) * F.col("support")) / F.sum("support")).alias(f"weighted_{k}"))
    out = per.agg(*aggs, (F.sum("hit") / F.sum("support")).alias("accuracy"))
    return out if prob is None else out.withColumn("auroc", one_row(auroc(df, label, prob))["auroc"])


def compare_scores(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Score tables of several models under one another."""
    out = None
    for name, df in tables.items():
        named = df.select(F.lit(name).alias("model"), "*")
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def train_test_scores(train: DataFrame, test: DataFrame, key: str = "model") -> DataFrame:
    """Training and test scores of the same models side by side."""
    rename = lambda df, s: df.withColumnsRenamed({c: f"{c}_{s}" for c in df.columns if c != key})
    return rename(train, "train").join(rename(test, "test"), key)


def error_distribution(df: DataFrame, attr: str, label: str, pred: str) -> DataFrame:
    """Per attribute value: rows, errors, error rate, and the shares among all rows and among errors."""
    wrong = F.col(label) != F.col(pred)
    per = df.groupBy(attr).agg(F.count("*").alias("n"), F.count_if(wrong).alias("errors"))
    total = one_row(per.agg(F.sum("n").alias("n"), F.sum("errors").alias("e")))
    return per.withColumns(
        {
            "error_rate": F.col("errors") / F.col("n"),
            "share": F.col("n") / total["n"],
            "error_share": F.try_divide(F.col("errors"), total["e"]),
        }
    )


def slice_results(results: DataFrame, vary: str, fixed: Mapping[str, object], score: str = "score") -> DataFrame:
    """Score by one parameter with the others fixed."""
    cond = F.lit(True)
    for k, v in fixed.items():
        cond = cond & (F.col(k) == F.lit(v))
    return results.where(cond).select(vary, score).orderBy(vary)


def pivot_results(results: DataFrame, rows: str, columns: str, values: Sequence, score: str = "score") -> DataFrame:
    """Two-parameter score grid."""
    return results.groupBy(rows).pivot(columns, list(values)).agg(F.max(score))


def select_instances(preds: DataFrame, models: Sequence[str], row_id: str, size: str, first: int = 51) -> DataFrame:
    """Rows worth explaining: highest and lowest probability per model, the largest ``size``, the first rows.

    Returns ``row_id, reason``; ties go to the smaller id.
    """
    picks = [
        F.struct(F.lit(f"max_{size}").alias("reason"), F.min(F.struct((-F.col(size)).alias("v"), row_id))[row_id].alias(row_id))
    ]
    for m in models:
        top, low = F.struct((-F.col(m)).alias("v"), row_id), F.struct(F.col(m).alias("v"), row_id)
        picks.append(F.struct(F.lit(f"highest_{m}").alias("reason"), F.min(F.when(F.col(m).isNotNull(), top))[row_id].alias(row_id)))
        picks.append(F.struct(F.lit(f"lowest_{m}").alias("reason"), F.min(F.when(F.col(m).isNotNull(), low))[row_id].alias(row_id)))
    extremes = preds.agg(F.array(*picks).alias("p")).select(F.inline("p"))
    head = preds.select(row_id).orderBy(row_id).limit(first).withColumn("reason", F.lit("first_rows"))
    return extremes.unionByName(head).select(row_id, "reason")

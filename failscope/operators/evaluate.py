"""Evaluation tables: confusion, reports, curves, capture."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failscope.operators.ordered import running, running_count, running_sum
from failscope.storage import literal_table


def _ratio(top, bottom):
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def binary_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and accuracy of a 0/1 prediction, one row."""
    y, p = F.col(actual) == 1, F.col(predicted) == 1
    counts = df.agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: Sequence[object] | None = None) -> DataFrame:
    """(actual, predicted, count) for every pair of labels, 0 included.

    Without ``labels`` they are those of either column.
    """
    counted = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).groupBy(
        F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("count"))
    if labels is None:
        found = counted.select(F.explode(F.array("actual", "predicted")).alias("label")).distinct()
    else:
        found = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in labels])).alias("label"))
    # The matrix has a row for every pair of classes by definition.
    grid = found.select(F.col("label").alias("actual")).crossJoin(found.select(F.col("label").alias("predicted")))
    return grid.join(counted, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("count", F.lit(0)).alias("count"))


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1, support per class, then accuracy, macro and weighted average."""
    pairs = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").cast("string").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed"),
                 F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").cast("string").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guessed"),
                 F.lit(0).cast("bigint").alias("hit")),
    )).alias("s")).select("s.*")
    classes = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    precision, recall = _ratio(F.col("hit"), F.col("guessed")), _ratio(F.col("hit"), F.col("support"))
    f1 = _ratio(2 * F.col("hit"), F.col("guessed") + F.col("support"))
    scored = classes.select(
        "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1-score"),
        F.col("support").cast("double").alias("support"), "hit")
    total = F.sum("support")
    measures = ("precision", "recall", "f1-score")
    accuracy = F.sum("hit") / total
    averages = scored.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"), *[accuracy.alias(m) for m in measures], accuracy.alias("support")),
            F.struct(F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in measures], total.alias("support")),
            F.struct(F.lit("weighted avg").alias("class"),
                     *[(F.sum(F.col(m) * F.col("support")) / total).alias(m) for m in measures], total.alias("support")),
        ).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    return scored.drop("hit").unionByName(averages)


def score_counts(df: DataFrame, actual: str, score: str) -> DataFrame:
    return df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(actual).cast("bigint")).alias("pos"),
        F.sum((1 - F.col(actual)).cast("bigint")).alias("neg"))


def roc_points(df: DataFrame, actual: str, score: str, max_group_rows: int | None = None) -> DataFrame:
    """(threshold, tpr, fpr) at every distinct score, highest first.

    Scores are counted before they are ordered, and the order is range-partitioned.
    """
    curve = running(
        score_counts(df, actual, score), [], [-F.col("score")], max_group_rows,
        tp=running_sum(F.col("pos")), fp=running_sum(F.col("neg")))
    totals = df.filter(F.col(score).isNotNull()).agg(F.sum(F.col(actual).cast("bigint")).alias("p"),
                                                     F.count(F.lit(1)).alias("n")).first()
    positives, negatives = totals.p or 0, (totals.n or 0) - (totals.p or 0)
    return curve.select(
        F.col("score").alias("threshold"), "tp", "fp",
        _ratio(F.col("tp"), F.lit(positives)).alias("tpr"), _ratio(F.col("fp"), F.lit(negatives)).alias("fpr"))


def roc_auc(df: DataFrame, actual: str, score: str, max_group_rows: int | None = None) -> DataFrame:
    """Area under the curve by trapezoids, one row; null without both classes."""
    curve = running(
        score_counts(df, actual, score), [], [-F.col("score")], max_group_rows,
        tp=running_sum(F.col("pos"), inclusive=False))
    area = F.sum(F.col("neg") * (F.col("tp") + F.col("pos") / 2.0))
    return curve.agg(F.when((F.sum("pos") > 0) & (F.sum("neg") > 0),
                            area / F.sum("pos") / F.sum("neg")).alias("auc"))


def calibration_curve(df: DataFrame, actual: str, score: str, bins: int = 10) -> DataFrame:
    """Observed and predicted share per score bin (right-closed), bins with rows only."""
    number = F.greatest(F.ceil(F.col(score) * bins), F.lit(1)).cast("int")
    return df.filter(F.col(score).isNotNull()).groupBy(number.alias("bin")).agg(
        F.avg(F.col(actual).cast("double")).alias("prob_true"), F.avg(score).alias("prob_pred"),
        F.count(F.lit(1)).alias("count"))


def top_k_capture(df: DataFrame, actual: str, score: str, row_id: str, percents: Sequence[int] = range(1, 21),
                  max_group_rows: int | None = None) -> DataFrame:
    """Share of all failures among the highest-scored 1..20 % of rows, ties by row id."""
    narrow = df.select(F.col(row_id).alias("__id"), F.col(actual).cast("bigint").alias("__y"),
                       F.col(score).cast("double").alias("__s"))
    sizes = narrow.agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("p")).first()
    n, failures = sizes.n, sizes.p or 0
    cuts = {pct: max(1, (n * pct + 99) // 100) for pct in percents}
    placed = running(narrow, [], [F.col("__s").isNull(), -F.col("__s"), F.col("__id")], max_group_rows,
                     __k=running_count(), captured=running_sum(F.coalesce("__y", F.lit(0))))
    at_cuts = placed.filter(F.col("__k").isin(sorted(set(cuts.values())))).select("__k", "captured")
    wanted = literal_table(df.sparkSession, ["pct", "k"], list(cuts.items())).withColumn("k", F.col("k").cast("bigint"))
    share = F.round(F.col("captured") * F.lit(100.0) / F.lit(failures), 2) if failures else F.lit(0.0)
    # One row per cut.
    return wanted.join(F.broadcast(at_cuts), F.col("k") == F.col("__k")).select(
        "pct", "k", "captured", share.alias("captured_pct"))



"""Status classifier and failure-risk model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.functions.values import flag, is_fail, to_number_or_zero
from failscope.operators.boosting import BoostedTrees, fit
from failscope.operators.encode import class_weight, target_encode, target_encode_fitted
from failscope.operators.vectors import tfidf_model
from failscope.sources.columns import add_missing, present, resolve
from failscope.storage import by_content, materialize

LOW_CONFIDENCE = 0.6
#: Rows that are alike in text and label are bagged one by one up to this number, beyond it in so many even shares.
SHARES = 4096


def status_classifier(train: DataFrame, text: str = "error_msg", label: str = "label", trees: int = 300,
                      depth: int = 30, max_features: int = 5000, seed: int = 42) -> PipelineModel:
    """Random forest on TF-IDF of the message.

    Logs say the same again and again: equal rows are counted first, and weigh as many as they are.
    """
    filled = train.select(F.coalesce(F.col(text), F.lit("")).alias(text), label)
    train = materialize(filled.groupBy(text, label).agg(F.count(F.lit(1)).alias("__rows")), "messages")
    vectors = tfidf_model(train, text, max_features, rows="__rows")
    index = StringIndexer(inputCol=label, outputCol="__label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
    # "keep" adds a class for unseen labels, which training never uses.
    forest = RandomForestClassifier(
        featuresCol="tfidf", labelCol="__label", predictionCol="__predicted", probabilityCol="__probability",
        rawPredictionCol="__raw", weightCol="__weight", numTrees=trees, maxDepth=depth, seed=seed)
    ready = index.transform(vectors.transform(bagged(train, "__rows")))
    model = forest.fit(ready.select("tfidf", "__label", "__weight"))
    names = IndexToString(inputCol="__predicted", outputCol="predictedlabel", labels=index.labels)
    return PipelineModel(stages=[*vectors.stages, index, model, names])


def bagged(counted: DataFrame, rows: str) -> DataFrame:
    """Counted rows as rows to draw bags from, with ``__weight``: 1 up to ``SHARES`` rows, else shares that sum to their number.

    Dealt by content and put in order, so that the bags are the same whatever the layout of the input.
    """
    n = F.col(rows)
    shares = F.least(n, F.lit(SHARES))
    spread = counted.withColumn("__share", F.explode(F.sequence(F.lit(1).cast("bigint"), shares)))
    weighted = spread.withColumn("__weight", (F.floor(n / shares) + (F.col("__share") <= n % shares).cast("int")).cast("double"))
    return by_content(weighted).sortWithinPartitions(*weighted.columns)


def classified(df: DataFrame, model: PipelineModel, text: str = "error_msg", label: str = "label",
               threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """Predicted and actual status with confidence, for all rows; each different message is judged once."""
    rows = add_missing(df, {c: "N/A" for c in ("test_case_id", "filename", "dut", "suite", "cluster")}).withColumn(
        text, F.coalesce(F.col(text), F.lit("")))
    # StringIndexer asks for the label column, which no prediction looks at.
    messages = rows.groupBy(text).agg(F.first(label).alias(label))
    judged = model.transform(by_content(messages)).select(
        F.col(text).alias("__message"), "predictedlabel", F.array_max(vector_to_array("__probability")).alias("__confidence"))
    # Written, the judged messages have their true size: few are sent to all tasks, many are dealt by message.
    out = rows.join(materialize(judged, "judged"), F.col(text) == F.col("__message"), "left")
    confidence = F.col("__confidence")
    return out.select(
        "test_case_id", "filename", "dut", "suite", F.col("cluster").alias("cluster_label"), "predictedlabel",
        F.col(label).alias("actualstatus"), confidence.alias("confidence"),
        flag(confidence < threshold).alias("lowconfidenceflag"), F.col(text).alias("errormsg"))


def fail_target(df: DataFrame) -> DataFrame:
    """``isFail`` from target, fail_flag or status."""
    for name in ("target", "fail_flag"):
        if name in df.columns:
            return df.withColumn("isFail", F.col(name).cast("int"))
    if "status" in df.columns:
        return df.withColumn("isFail", is_fail(F.col("status")))
    raise KeyError("no target column; expected one of target, fail_flag, status")


def risk_features(df: DataFrame, train: Column | None = None) -> tuple[DataFrame, list[str]]:
    """Numeric candidates and target-encoded categories the frame has, as numbers without nulls.

    With ``train`` the categories are encoded from those rows only, so that held-out labels do
    not reach the features.
    """
    numeric = present(df, K.NUMERIC_CANDIDATES)
    categories = present(df, K.CATEGORY_CANDIDATES)
    cluster = resolve(df, K.CLUSTER_CANDIDATES)
    if cluster and cluster not in categories:
        categories.append(cluster)
    out = target_encode(df, categories) if train is None else target_encode_fitted(df, train, categories)
    # A column that holds no numbers (such as a time stamp) counts as 0.
    numbers = {f"{c}__x": to_number_or_zero(F.col(c).cast("string")) for c in numeric}
    return out.withColumns(numbers), [*numbers, *[f"{c}_te" for c in categories]]


def risk_model(train: DataFrame, features: Sequence[str], target: str = "isFail", rounds: int = 400, depth: int = 6,
               rate: float = 0.05, seed: int = 42) -> BoostedTrees:
    """Gradient-boosted failure model with the positive class weighted up; 0.9 of the rows and 0.8 of the columns for each tree."""
    weight = class_weight(train, target).first()[0]
    return fit(train, features, target, rounds, depth, rate, row_share=0.9, column_share=0.8, positive_weight=weight, seed=seed)


def risk_scored(df: DataFrame, model: BoostedTrees) -> DataFrame:
    """``pred_prob`` of every row."""
    return model.score(df, "pred_prob")


def test_predictions(df: DataFrame, model: BoostedTrees, features: Sequence[str], target: str = "isFail") -> DataFrame:
    return risk_scored(df, model).select(
        *features, F.col(target).alias("actual"), "pred_prob", flag(F.col("pred_prob") >= 0.5).alias("pred_label"))


def feature_importance(model: BoostedTrees, session) -> DataFrame:
    """(feature, importance), strongest first: mean gain of a feature's splits, as a share."""
    rows = [(name.removesuffix("__x"), float(w)) for name, w in zip(model.features, model.importance())]
    return session.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")

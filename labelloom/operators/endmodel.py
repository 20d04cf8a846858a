"""Text classifiers trained with Spark ML: on weak labels, or on the gold sample."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.operators.classes import ClassList, with_class_index
from labelloom.operators.metrics import macro_metrics
from labelloom.operators.sampling import balanced_split, holdout


@dataclass(frozen=True)
class EndModelOptions:
    algorithm: str = "naive_bayes"  # or "logistic_regression"
    features: int = 1 << 16
    min_doc_freq: int = 2
    max_iter: int = 20
    reg: float = 1e-3


def text_pipeline(options: EndModelOptions, target: str) -> Pipeline:
    words = RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+", toLowercase=True)
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=options.features)
    if options.algorithm == "naive_bayes":
        learner = NaiveBayes(featuresCol="_counts", labelCol=target, predictionCol="_prediction")
        return Pipeline(stages=[words, counts, learner])
    if options.algorithm == "logistic_regression":
        weighted = IDF(inputCol="_counts", outputCol="_features", minDocFreq=options.min_doc_freq)
        learner = LogisticRegression(
            featuresCol="_features", labelCol=target, predictionCol="_prediction",
            maxIter=options.max_iter, regParam=options.reg,
        )
        return Pipeline(stages=[words, counts, weighted, learner])
    raise ValueError(f"unknown algorithm: {options.algorithm}")


def _usable(items: DataFrame, target: str) -> DataFrame:
    # abstains and unlabelled items cannot be trained on
    return items.select(F.coalesce("text", F.lit("")).alias("text"), F.col(target).cast("double").alias("_target")).filter(
        F.col("_target") >= 0
    )


def train(items: DataFrame, target: str, options: EndModelOptions = EndModelOptions()) -> PipelineModel:
    """Fit on (text, class number)."""
    return text_pipeline(options, "_target").fit(_usable(items, target))


def classify(items: DataFrame, model: PipelineModel, pred: str = "pred") -> DataFrame:
    scored = model.transform(items.withColumn("text", F.coalesce("text", F.lit(""))))
    return scored.withColumn(pred, F.col("_prediction").cast("int")).select(*items.columns, pred)


def weak_label_model(
    train_items: DataFrame, test_items: DataFrame, weak: str = "weak_label", options: EndModelOptions = EndModelOptions()
) -> DataFrame:
    """Predictions on the test items by a model that saw only weak labels."""
    return classify(test_items, train(train_items, weak, options))


def validation_scores(
    items: DataFrame, target: str, valid: DataFrame | None = None, options: EndModelOptions = EndModelOptions()
) -> DataFrame:
    """Macro scores on the validation items, by default a held-out tenth of the training items."""
    if valid is None:
        marked = holdout(items)
        items, valid = marked.filter("not held_out"), marked.filter("held_out")
    return macro_metrics(classify(valid, train(items, target, options)), target, "pred")


def supervised_baseline(
    items: DataFrame,
    classes: ClassList,
    train_size: int,
    runs: int = 3,
    test: DataFrame | None = None,
    options: EndModelOptions = EndModelOptions(),
) -> DataFrame:
    """Scores of ``runs`` models, each trained on a fresh balanced gold sample.

    Returns one row per run; summarise with ``run_summary``.
    """
    indexed = with_class_index(items, classes)
    scored = []
    for run in range(runs):
        marked = balanced_split(indexed, "label", train_size, seed=run)
        model = train(marked.filter("chosen"), "label_idx", options)
        target = with_class_index(test, classes) if test is not None else marked.filter("not chosen")
        scored.append(macro_metrics(classify(target, model)).withColumn("run", F.lit(run)))
    out = scored[0]
    for other in scored[1:]:
        out = out.unionByName(other)
    return out



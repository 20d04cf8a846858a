"""Classification metrics from a confusion count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("f1", "precision", "recall", "acc")


def confusion(predictions: DataFrame, label: str = "label_idx", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """Items per (label, pred); the counts are combined before the shuffle."""
    return predictions.groupBy(*by, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.count("*").alias("n")
    )


def class_scores(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 per class seen as label or prediction.

    An undefined ratio is 0.
    """
    hit = F.col("label") == F.col("pred")
    zero = F.lit(0).cast("bigint")
    sides = cells.select(
        *by,
        F.explode(
            F.array(
                F.struct(
                    F.col("label").alias("cls"),
                    F.when(hit, F.col("n")).otherwise(zero).alias("tp"),
                    zero.alias("fp"),
                    F.when(hit, zero).otherwise(F.col("n")).alias("fn"),
                ),
                F.struct(
                    F.col("pred").alias("cls"),
                    zero.alias("tp"),
                    F.when(hit, zero).otherwise(F.col("n")).alias("fp"),
                    zero.alias("fn"),
                ),
            )
        ).alias("s"),
    )
    per_class = sides.groupBy(*by, F.col("s.cls").alias("cls")).agg(
        F.sum("s.tp").alias("tp"), F.sum("s.fp").alias("fp"), F.sum("s.fn").alias("fn")
    )

    def ratio(top, bottom):
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return per_class.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def macro_metrics(
    predictions: DataFrame,
    label: str = "label_idx",
    pred: str = "pred",
    by: tuple[str, ...] = (),
    ignore_abstain: bool = False,
) -> DataFrame:
    """Macro f1, precision and recall over all classes seen, and accuracy.

    An abstain (-1) is a class of its own unless ``ignore_abstain`` removes such items.
    """
    if ignore_abstain:
        predictions = predictions.filter(F.col(pred) != -1)
    scores = class_scores(confusion(predictions, label, pred, by), by)
    return scores.groupBy(*by).agg(
        F.avg("f1").alias("f1"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        # every item is exactly one tp or fn of its own label
        (F.sum("tp") / (F.sum("tp") + F.sum("fn"))).alias("acc"),
    )


def run_summary(runs: DataFrame, run: str = "run") -> DataFrame:
    """Mean and population deviation of each metric over repeated runs."""
    long = runs.unpivot([run], list(METRICS), "metric", "value")
    return long.groupBy("metric").agg(
        F.sort_array(F.collect_list(F.struct(F.col(run).alias("run"), "value"))).alias("runs"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
    )

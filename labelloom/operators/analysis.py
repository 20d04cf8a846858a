"""Scores of labeling functions against gold labels, filters, and vote diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.vectors import first_argmax
from labelloom.operators.labeling import LabelingSet
from labelloom.operators.majority import MajorityModel, vote_counts
from labelloom.sizing import local_frame

# The pseudo function under which whole-table totals are counted in the same pass.
_ALL = -1


def _marker() -> Column:
    return F.array(F.struct(F.lit(_ALL).alias("lf"), F.lit(None).cast("int").alias("c")))


def lf_summary(ballots: DataFrame, lfs: LabelingSet, label_idx: str | None = "label_idx") -> DataFrame:
    """One row per labeling function: how often it votes, agrees, clashes and is right.

    coverage, overlaps and conflicts are shares of all items; emp_acc is the share of
    its votes that are right, 0 for a function that never votes. Each ballot is exploded
    once with a marker row for the item itself, so a single combined aggregate gives
    the item count and all function counts; the rest is arithmetic on len(lfs) rows.
    """
    gold = F.col(label_idx) if label_idx else F.lit(None).cast("int")
    marked = ballots.select(
        (F.size("votes") > 1).alias("shared"),
        (F.size(F.array_distinct("votes.c")) > 1).alias("clash"),
        gold.alias("gold"),
        F.explode(F.concat(F.col("votes"), _marker())).alias("v"),
    )
    per_lf = marked.groupBy("v.lf").agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_set("v.c")).alias("polarity"),
        F.count_if("shared").alias("n_overlaps"),
        F.count_if("clash").alias("n_conflicts"),
        F.count_if(F.col("v.c") == F.col("gold")).alias("correct"),
        F.count_if(F.col("v.c") != F.col("gold")).alias("incorrect"),
    )
    # len(lfs) + 1 rows: small by construction
    gathered = per_lf.agg(F.collect_list(F.struct(*per_lf.columns)).alias("rows"))
    totals = F.filter("rows", lambda r: r["lf"] == _ALL)["n"][0]
    counted = gathered.select(totals.alias("n_items"), F.inline("rows")).filter(F.col("lf") != _ALL)
    named = lfs.frame(ballots.sparkSession).select("lf", "criterion").join(counted, "lf", "left")

    def share(column: str) -> Column:
        return F.coalesce(F.col(column) / F.col("n_items"), F.lit(0.0))

    return named.select(
        "lf",
        "criterion",
        F.coalesce("polarity", F.array().cast("array<int>")).alias("polarity"),
        share("n").alias("coverage"),
        share("n_overlaps").alias("overlaps"),
        share("n_conflicts").alias("conflicts"),
        F.coalesce("correct", F.lit(0)).alias("correct"),
        F.coalesce("incorrect", F.lit(0)).alias("incorrect"),
        F.coalesce(F.col("correct") / F.col("n"), F.lit(0.0)).alias("emp_acc"),
    )


def good_lfs(summary: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Functions whose empirical accuracy is above the threshold (strictly)."""
    return summary.filter(F.col("emp_acc") > threshold).select("lf", "criterion", "emp_acc")


def restrict_criteria(criteria: DataFrame, kept: DataFrame) -> DataFrame:
    return criteria.join(kept.select("criterion"), "criterion", "left_semi")


def confident(posteriors: DataFrame, threshold: float = 0.5, proba: str = "proba") -> DataFrame:
    """Items whose best class is more probable than the threshold, with that class."""
    kept = posteriors.filter(F.array_max(proba) > threshold)
    return kept.withColumn("weak_label", first_argmax(F.col(proba)))


def split_errors(predictions: DataFrame, label: str = "label_idx", pred: str = "pred") -> DataFrame:
    """Add ``outcome``: 'correct' or 'wrong'. An abstain counts as wrong."""
    right = F.coalesce(F.col(pred) == F.col(label), F.lit(False))
    return predictions.withColumn("outcome", F.when(right, F.lit("correct")).otherwise(F.lit("wrong")))


def annotator_stats(ballots: DataFrame, lfs: LabelingSet, model: MajorityModel) -> DataFrame:
    """Vote statistics, one row per labeling function and class of the model."""
    marked = ballots.select(F.explode(F.concat(F.col("votes"), _marker())).alias("v"))
    counted = marked.groupBy(F.col("v.lf").alias("lf"), F.col("v.c").alias("c")).agg(F.count("*").alias("n"))
    # at most one row per function and class
    cells = {(r.lf, r.c): r.n for r in counted.collect()}
    n_items = cells.pop((_ALL, None), 0)
    rows = []
    for f in lfs.functions:
        n_valid = sum(n for (lf, _), n in cells.items() if lf == f.lf)
        for c in model.classes:
            count = cells.get((f.lf, c), 0)
            rows.append(
                (
                    f.criterion, c, n_items, n_valid, (n_items - n_valid) / n_items if n_items else 0.0,
                    float(model.weights.get(f.criterion, 1.0)), count, count / n_valid if n_valid else 0.0,
                )
            )
    return local_frame(
        ballots.sparkSession,
        rows,
        "criterion string, class_idx int, n_annotations bigint, n_valid bigint, missing_rate double, "
        "weight double, class_count bigint, class_prop double",
    )


def consensus_metrics(ballots: DataFrame, lfs: LabelingSet, model: MajorityModel) -> DataFrame:
    """One row: how many items have a clear majority, and how much vote mass is unanimous."""
    counted = ballots.select(vote_counts(F.col("votes"), lfs, model).alias("w"))
    per_item = counted.select(
        F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("mass"),
        F.array_max("w").alias("top"),
        F.size(F.filter("w", lambda x: x > 0)).alias("n_voted"),
    )
    voted = F.col("mass") > 0
    sums = per_item.agg(
        F.count("*").alias("total_objects"),
        F.count_if(voted & (F.col("top") > F.col("mass") / 2)).alias("objects_with_consensus"),
        F.coalesce(F.sum(F.when(voted & (F.col("n_voted") == 1), F.col("mass"))), F.lit(0.0)).alias("agreed"),
        F.coalesce(F.sum(F.when(voted, F.col("mass"))), F.lit(0.0)).alias("mass"),
    )
    return sums.select(
        "total_objects",
        "objects_with_consensus",
        F.coalesce(F.try_divide("objects_with_consensus", "total_objects"), F.lit(0.0)).alias("consensus_rate"),
        F.coalesce(F.try_divide("agreed", "mass"), F.lit(0.0)).alias("total_agreement_rate"),
    )

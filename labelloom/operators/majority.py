"""Weighted majority vote.

Fitting is one small aggregate (votes per class). Predicting is a row expression on the
ballot: per-class vote mass as an array, then an argmax under a tie rule. There is no
shuffle, whatever the number of items.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import once
from labelloom.functions.vectors import first_argmax, total
from labelloom.operators.labeling import LabelingSet
from labelloom.sizing import constant, local_frame

TIE_RULES = ("prior", "first", "random")


@dataclass(frozen=True)
class MajorityModel:
    """Classes seen in training, their share of the votes, and a weight per function."""

    classes: tuple[int, ...]
    prior: tuple[float, ...]
    weights: dict[str, float] = field(default_factory=dict)

    def prior_frame(self, spark) -> DataFrame:
        return local_frame(spark, list(zip(self.classes, self.prior)), "class_idx int, prior double")


def class_vote_counts(ballots: DataFrame) -> DataFrame:
    return ballots.select(F.explode("votes.c").alias("class_idx")).groupBy("class_idx").agg(F.count("*").alias("n"))


def fit_majority(
    ballots: DataFrame,
    lfs: LabelingSet,
    weights: dict[str, float] | None = None,
    classes: list[int] | None = None,
) -> MajorityModel:
    """Class universe (the classes voted for, unless given), vote-share prior, weights.

    A function missing from ``weights`` weighs 1. Without any vote the prior is uniform.
    """
    counts = {r.class_idx: r.n for r in class_vote_counts(ballots).collect()}
    universe = list(classes) if classes else sorted(counts)
    if not universe:
        raise ValueError("no votes and no classes given: nothing to vote for")
    n_votes = sum(counts.values())
    if n_votes:
        prior = [counts.get(c, 0) / n_votes for c in universe]
    else:
        prior = [1 / len(universe)] * len(universe)
    own = {name: float((weights or {}).get(name, 1.0)) for name in lfs.names}
    return MajorityModel(tuple(universe), tuple(prior), own)


def vote_counts(votes: Column, lfs: LabelingSet, model: MajorityModel) -> Column:
    """Vote mass per class, in the order of the model's classes.

    Votes of functions the model was not fitted with are ignored. A vote for a class
    the model does not know is an error.
    """
    per_lf = constant([model.weights.get(name) for name in lfs.names], "array<double>")
    classes = constant(list(model.classes), "array<int>")

    def mass(known: Column) -> Column:
        counted = F.transform(
            classes,
            lambda c: F.aggregate(
                F.filter(known, lambda v: v["c"] == c), F.lit(0.0), lambda acc, v: acc + F.get(per_lf, v["lf"])
            ),
        )
        stray = F.exists(known, lambda v: ~F.array_contains(classes, v["c"]))
        return F.when(stray, F.raise_error(F.lit("vote for a class unknown to the majority model"))).otherwise(counted)

    return once(F.filter(votes, lambda v: F.get(per_lf, v["lf"]).isNotNull()), mass)


def predict_proba(ballots: DataFrame, lfs: LabelingSet, model: MajorityModel) -> DataFrame:
    """Add ``proba``: share of the vote mass, or the prior for an item without mass."""
    prior = constant(list(model.prior), "array<double>")

    def shares(w: Column) -> Column:
        return once(
            total(w), lambda z: F.when(z == 0, prior).otherwise(F.transform(w, lambda x: F.try_divide(x, z)))
        )

    return ballots.withColumn("proba", once(vote_counts(F.col("votes"), lfs, model), shares))


def predict_hard(
    ballots: DataFrame, lfs: LabelingSet, model: MajorityModel, ties: str = "prior", seed: int = 0
) -> DataFrame:
    """Add ``pred``: the class of largest vote mass; it never abstains.

    Ties, which include the item without votes, go to the class of largest prior and
    then lowest number (``prior``), to the lowest number (``first``), or to a seeded
    random pick (``random``).
    """
    if ties not in TIE_RULES:
        raise ValueError(f"unknown tie rule: {ties}")
    places = range(len(model.classes))
    if ties == "prior":
        places = sorted(places, key=lambda i: (-model.prior[i], i))
    preference = constant(list(places), "array<int>")
    classes = constant(list(model.classes), "array<int>")

    def winner(w: Column) -> Column:
        def among(top: Column) -> Column:
            tied = F.filter(preference, lambda i: F.get(w, i) == top)
            if ties != "random":
                return tied[0]
            drawn = F.transform(
                tied,
                lambda i: F.struct(
                    F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("item_id").cast("string"), i.cast("string"))).alias("k"),
                    i.alias("i"),
                ),
            )
            return F.array_min(drawn)["i"]

        return once(F.array_max(w), among)

    best = once(vote_counts(F.col("votes"), lfs, model), winner)
    return ballots.withColumn("pred", F.get(classes, best))


def predict_soft(ballots: DataFrame, lfs: LabelingSet, model: MajorityModel) -> DataFrame:
    """Add ``proba`` and ``pred``, its first largest class; tie rules play no part."""
    classes = constant(list(model.classes), "array<int>")
    scored = predict_proba(ballots, lfs, model)
    return scored.withColumn("pred", F.get(classes, first_argmax(F.col("proba"))))


def vote_counts_long(ballots: DataFrame, lfs: LabelingSet, model: MajorityModel) -> DataFrame:
    """(item_id, class_idx, weight) for every class of the model."""
    classes = constant(list(model.classes), "array<int>")
    counted = ballots.select("item_id", F.posexplode(vote_counts(F.col("votes"), lfs, model)).alias("i", "weight"))
    return counted.select("item_id", F.get(classes, F.col("i")).alias("class_idx"), "weight")

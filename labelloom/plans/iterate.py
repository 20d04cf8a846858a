"""The labelling loop: criteria, votes, label models, scores, errors, next round."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.operators import dawid_skene, endmodel, label_model, majority
from labelloom.operators.analysis import good_lfs, lf_summary, split_errors
from labelloom.operators.classes import class_list, require_known_labels, with_class_index
from labelloom.operators.criteria import accumulate, cap_new, ingest_generated
from labelloom.operators.generation import generation_requests
from labelloom.operators.labeling import VOTES, LabelingSet, ballots, labeling_set, request_chunks, with_votes
from labelloom.operators.metrics import macro_metrics
from labelloom.operators.sampling import require_unique_ids
from labelloom.plans.experiments import Experiment
from labelloom.sizing import constant
from labelloom.sources.writers import write_csv, write_jsonl, write_vote_matrix

Model = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class RunConfig:
    dataset: str
    accuracy_threshold: float = 0.5
    max_iter: int = 1
    classify_mode: str = "keywords"
    generation_rounds: int = 1
    criteria_per_class: int = 5
    max_criteria: int | None = None
    domain_info: str | None = None
    dawid_skene: bool = False
    end_model: bool = True
    seed: int = 0


@dataclass(frozen=True)
class IterationResult:
    criteria: DataFrame
    summary: DataFrame
    predictions: DataFrame
    metrics: DataFrame
    judged: DataFrame  # dev items with outcome 'wrong' or 'correct'


def predictions_frame(scored: DataFrame, items: DataFrame, model: str, split: str) -> DataFrame:
    """Predictions next to text and gold class: item_id, text, label, pred, model, split."""
    joined = scored.select("item_id", "label_idx", "pred").join(items.select("item_id", "text"), "item_id")
    return joined.select(
        "item_id",
        "text",
        F.col("label_idx").alias("label"),
        "pred",
        F.lit(model).alias("model"),
        F.lit(split).alias("split"),
    )


def new_criteria(
    shown: DataFrame, existing: DataFrame | None, generate: Model, config: RunConfig, iteration: int
) -> DataFrame:
    """Criteria of one round: asked per class, capped, and appended to the existing ones."""
    rounds = None
    for number in range(config.generation_rounds):
        requests = generation_requests(
            shown,
            config.dataset,
            wanted=config.criteria_per_class if iteration == 0 else 1,
            existing=existing,
            domain_info=config.domain_info,
            keyword_rules=config.classify_mode == "keywords",
        )
        # answers of a later round come after all answers of an earlier one
        answers = generate(requests).withColumn("request_no", F.col("request_no") + number * (1 << 20))
        found = ingest_generated(answers)
        rounds = found if rounds is None else rounds.unionByName(found)
    if existing is None:
        existing = rounds.limit(0)
    if config.max_criteria is not None:
        rounds = cap_new(existing, rounds, config.max_criteria, config.seed)
    return accumulate(existing, rounds)


def run_iteration(
    experiment: Experiment,
    splits: DataFrame,
    config: RunConfig,
    iteration: int,
    generate: Model,
    model: Model | None = None,
    judged: DataFrame | None = None,
    previous: DataFrame | None = None,
) -> IterationResult:
    """One round over ``splits(item_id, split, text, label)``; stored stages are reused.

    ``generate`` answers criteria requests and ``model`` classification requests. Train
    labels are never looked at.
    """
    require_unique_ids(splits)
    parts = {s: splits.filter(F.col("split") == s).drop("split") for s in ("train", "dev", "test")}
    dev = parts["dev"]

    def stage(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return experiment.stage(iteration, name, make)

    def shown() -> DataFrame:
        # the errors of the last round, or everything when there are none
        if judged is not None and not judged.filter("outcome = 'wrong'").isEmpty():
            return judged
        return dev.withColumn("outcome", F.lit("wrong"))

    criteria = stage("criteria", lambda: new_criteria(shown(), previous, generate, config, iteration))
    classes = class_list(dev)
    for labelled in ("dev", "test"):
        require_known_labels(parts[labelled], classes)

    full = labeling_set(criteria, classes)

    def judge(split: str, lfs: LabelingSet) -> DataFrame:
        chunks = None
        if config.classify_mode != "keywords":
            chunks = request_chunks(criteria.join(lfs.frame(criteria.sparkSession), "criterion", "left_semi"), config.domain_info)
        found = stage(
            f"verdicts_{split}",
            lambda: ballots(parts[split], lfs, config.classify_mode, chunks, model).select("item_id", "fired"),
        )
        return _votes(found, lfs)

    def gold(found: DataFrame, split: str) -> DataFrame:
        labels = with_class_index(parts[split], classes).select("item_id", "label_idx")
        return found.join(labels, "item_id")

    dev_full = judge("dev", full)
    summary = stage("lf_scores", lambda: lf_summary(gold(dev_full, "dev"), full))
    # train and test only see the functions that proved themselves on dev
    kept = full.only([r.criterion for r in good_lfs(summary, config.accuracy_threshold).collect()])
    if not len(kept):
        raise ValueError("no labeling function passes the accuracy threshold")

    votes = {s: judge(s, kept) for s in ("train", "test")}
    votes["dev"] = _renumbered(dev_full, full, kept)
    labelled = {s: gold(votes[s], s) for s in ("test", "dev")}

    def fitted_label_model() -> DataFrame:
        options = label_model.LabelModelOptions(seed=config.seed)
        return label_model.fit(votes["train"], kept, len(classes), options=options).mu_frame(experiment.spark)

    lm = label_model.LabelModel.from_frame(stage("label_model", fitted_label_model), kept, len(classes))

    def predicted() -> DataFrame:
        mv = majority.fit_majority(votes["train"], kept)
        predictors = {
            "majority_vote": lambda t: majority.predict_hard(t, kept, mv, "prior"),
            "label_model": lambda t: label_model.predict(t, lm),
        }
        if config.dawid_skene:
            ds = dawid_skene.fit(votes["train"], kept)
            predictors["dawid_skene"] = lambda t: dawid_skene.predict(t, ds)
        tables = [
            predictions_frame(predict(labelled[split]), parts[split], name, split)
            for name, predict in predictors.items()
            for split in ("test", "dev")
        ]
        if config.end_model:
            weak = predictors["majority_vote"](votes["train"]).select("item_id", F.col("pred").alias("weak_label"))
            taught = parts["train"].select("item_id", "text").join(weak, "item_id")
            test_items = with_class_index(parts["test"], classes).select("item_id", "text", "label_idx")
            tables.append(
                predictions_frame(endmodel.weak_label_model(taught, test_items), parts["test"], "end_model", "test")
            )
        return reduce(DataFrame.unionByName, tables)

    predictions = stage("predictions", predicted)
    metrics = stage("metrics", lambda: macro_metrics(predictions, "label", "pred", by=("model", "split")))
    own = predictions.filter("model = 'label_model' and split = 'dev'")
    outcome = stage("judged", lambda: _judged(own, dev))

    scores = summary.withColumn("polarity", F.to_json("polarity"))
    named = kept.frame(experiment.spark).select("criterion", "description")
    rows = predictions.select(F.col("item_id").alias("idx"), "text", "label", "pred", "model", "split")
    experiment.export(iteration, "criteria", lambda path: write_jsonl(criteria.orderBy("ord").drop("ord"), path))
    experiment.export(iteration, "lf_scores", lambda path: write_csv(scores, path))
    experiment.export(iteration, "filtered_lfs", lambda path: write_jsonl(named, path))
    experiment.export(iteration, "predictions", lambda path: write_csv(rows, path))
    experiment.export(iteration, "metrics", lambda path: write_jsonl(metrics, path))
    experiment.export(iteration, "judged", lambda path: write_jsonl(outcome, path))
    for split, table in votes.items():
        experiment.export(iteration, f"votes_{split}", lambda path, t=table: write_vote_matrix(t, kept.names, path))
    return IterationResult(criteria, summary, predictions, metrics, outcome)


def _judged(predictions: DataFrame, dev: DataFrame) -> DataFrame:
    marked = split_errors(predictions, "label", "pred").select("item_id", "outcome")
    return dev.select("item_id", "text", F.col("label").cast("string").alias("label")).join(marked, "item_id")


def _votes(found: DataFrame, lfs: LabelingSet) -> DataFrame:
    """Stored verdicts as ballots; an item that was not judged has no votes."""
    table = with_votes(found, lfs)
    return table.withColumn("votes", F.coalesce("votes", F.array().cast(VOTES)))


def _renumbered(found: DataFrame, full: LabelingSet, kept: LabelingSet) -> DataFrame:
    """Ballots over all functions, reduced to the kept ones."""
    number = {f.criterion: f.lf for f in kept.functions}
    new = constant([number.get(f.criterion) for f in full.functions], "array<int>")
    fired = F.filter(F.transform("fired", lambda lf: F.get(new, lf)), lambda lf: lf.isNotNull())
    return _votes(found.withColumn("fired", fired), kept)


def run_experiment(
    experiment: Experiment, splits: DataFrame, config: RunConfig, generate: Model, model: Model | None = None
) -> list[IterationResult]:
    """``max_iter`` rounds; each starts from the errors and criteria of the one before."""
    results: list[IterationResult] = []
    for i in range(config.max_iter):
        last = results[-1] if results else None
        results.append(
            run_iteration(
                experiment, splits, config, i, generate, model,
                judged=last.judged if last else None,
                previous=last.criteria if last else None,
            )
        )
    return results

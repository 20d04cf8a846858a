"""Two jobs outside the loop: label a table with given criteria, and write criteria for a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.operators.classes import ClassList
from labelloom.operators.criteria import accumulate, ingest_generated, keep_unique
from labelloom.operators.generation import dedup_request, generation_requests
from labelloom.operators.labeling import ballots, labeling_set, request_chunks, verdicts
from labelloom.session import path_exists
from labelloom.sources.readers import read_verdicts
from labelloom.sources.writers import append_verdicts
from labelloom.streaming.labelling import remaining

Model = Callable[[DataFrame], DataFrame]


def label_table(
    spark: SparkSession,
    items: DataFrame,
    criteria: DataFrame,
    out: str,
    mode: str = "keywords",
    model: Model | None = None,
    domain_info: str | None = None,
) -> int:
    """Append verdicts of the items that have none in ``out`` yet; returns how many there were.

    Finished items are found by id, so an interrupted job may be repeated at any time.
    """
    left = remaining(items, read_verdicts(spark, out)) if path_exists(spark, out) else items
    n_left = left.count()
    if n_left == 0:
        return 0
    lfs = labeling_set(criteria, ClassList(()))  # verdicts need no classes
    chunks = None if mode == "keywords" else request_chunks(criteria, domain_info)
    judged = ballots(left, lfs, mode, chunks, model, keep=("text",))
    append_verdicts(verdicts(judged, lfs, keep=("text",)), out)
    return n_left


def write_criteria(
    samples: DataFrame,
    dataset: str,
    generate: Model,
    dedup: Model | None = None,
    existing: DataFrame | None = None,
    wanted: int = 5,
    domain_info: str | None = None,
) -> DataFrame:
    """Criteria for labelled samples (item_id, text, label), appended to existing ones.

    With existing criteria and a ``dedup`` model, only the names it calls unique remain.
    """
    shown = samples.withColumn("outcome", F.lit("wrong"))
    answers = generate(generation_requests(shown, dataset, wanted, existing, domain_info))
    new = ingest_generated(answers)
    if existing is None:
        return new
    everything = accumulate(existing, new)
    return everything if dedup is None else keep_unique(everything, dedup(dedup_request(everything)))

"""Criteria tables: ingest, deduplication, accumulation, and the cap on new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import int_or_text, parse_answer, seeded_order
from labelloom.operators.sampling import take_lowest
from labelloom.sizing import compute_once

GENERATED = "criteria array<struct<criterion:string,description:string,class:string>>"


def last_wins(criteria: DataFrame) -> DataFrame:
    """One row per criterion name: the values of its last row at the place of its first.

    An aggregate rather than a window: a name repeated millions of times is combined
    before the shuffle instead of being sorted in one task.
    """
    newest = F.max_by(F.struct("description", "class"), "ord")
    merged = criteria.groupBy("criterion").agg(F.min("ord").alias("ord"), newest.alias("newest"))
    return merged.select(
        "ord",
        "criterion",
        F.col("newest.description").alias("description"),
        int_or_text(F.col("newest.class")).alias("class"),
    )


def ingest_generated(answers: DataFrame) -> DataFrame:
    """Criteria from model answers (request_no, content, failed), in answer order.

    A failed or unreadable answer contributes nothing.
    """
    usable = answers.filter(~F.coalesce("failed", F.lit(False)))
    listed = compute_once(usable, "request_no", found=parse_answer(F.col("content"), GENERATED)["criteria"])
    rows = listed.select("request_no", F.posexplode("found").alias("pos", "c"))
    return rows.select(
        (F.shiftleft(F.col("request_no").cast("bigint"), 32) + F.col("pos")).alias("ord"),
        "c.criterion",
        "c.description",
        F.col("c.class").alias("class"),
    )


def keep_unique(criteria: DataFrame, answer: DataFrame) -> DataFrame:
    """Rows whose name is in the deduplication answer; order and repeats are kept.

    An answer that can't be read says nothing about any criterion: all of them stay.
    """
    parsed = answer.select(parse_answer(F.col("content"), "unique_criteria array<string>")["unique_criteria"].alias("names"))
    if not parsed.filter("names IS NULL").isEmpty():
        return criteria
    names = parsed.select(F.explode("names").alias("criterion")).distinct()
    return criteria.join(names, "criterion", "left_semi")


def accumulate(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing criteria followed by the new ones.

    New positions are shifted behind the last existing one; gaps are harmless.
    """
    last = existing.agg(F.max("ord")).first()[0]
    offset = 0 if last is None else last + 1
    return existing.unionByName(new.withColumn("ord", F.col("ord") + F.lit(offset).cast("bigint")))


def cap_new(existing: DataFrame, new: DataFrame, maximum: int, seed: int = 0) -> DataFrame:
    """A random choice of new criteria so that at most ``maximum`` exist in total.

    Everything stays when the total fits. More existing criteria than the maximum is an
    error, as there is no number of new ones that could fit.
    """
    n_existing, n_new = existing.count(), new.count()
    if n_existing + n_new <= maximum:
        return new
    if n_existing > maximum:
        raise ValueError(f"{n_existing} existing criteria already exceed the maximum of {maximum}")
    key = seeded_order(seed, F.col("ord"), F.col("criterion"))
    return take_lowest(new, maximum - n_existing, key, n_new)

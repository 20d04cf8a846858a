"""Mixing sources to target weights with hash-threshold histograms.

Every document has a hash of its id. A source whose target is k sizes and a rest takes each document
k times, and once more the documents whose hash lies below a threshold. The threshold is found
without sorting: words are summed by source and hash bucket, the bucket in which the rest runs out is
cut into finer buckets, and so on. The document at the threshold doesn't fit; what it leaves free goes
in further nested rounds to documents behind it that are small enough. So a source's words end below
its target by less than the smallest document that the last round met and could not fit.

All steps are DataFrame operations. What is kept per source is a few numbers; documents meet them
in a join on (source, salt), so that a source with a third of all rows is spread over many tasks.

Cases: null and empty texts have size 0 and are taken 0 words. A null source is a source of its own,
last in order. Rows that share a doc_id (null included) share their hash: they are taken or left as one
unit. Other columns pass through; the new columns replace columns of the same names. A table without
words has targets of 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.llm.common import quoted, release, stored, with_columns

ROUNDS = 4
SALTS = 64
HASH_BITS = 60
SEED = "mix:"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """60 bits of an md5, which other engines can compute too."""
    text = F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """(key, total, weight): weights 1, 2, ... ``cycle``, repeating, by code point, null last. One row per source."""
    order = W.orderBy(F.col("key") == "", "key")
    return sources.withColumn("weight", ((F.row_number().over(order) - 1) % cycle + 1).cast("long"))


def with_targets(sources: DataFrame, budget: Column, repeats: int) -> DataFrame:
    """Add ``target``: ``budget`` shared by weight; what exceeds ``repeats`` times a source's size is shared again.

    Sources are capped in the order of cap / weight. Before any source, what is left per unit of weight
    is known; the first source whose cap exceeds that is open, and so are all behind it.
    """
    every = W.partitionBy()
    cap = F.col("total") * repeats
    ratio = cap.cast("double") / F.col("weight")
    order = W.orderBy("_ratio", F.col("key") == "", "key")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double") / (
        F.col("_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    ranked = (
        sources.withColumn("_budget", budget.over(every))
        .withColumn("_weights", F.sum("weight").over(every))
        .withColumn("_cap", cap)
        .withColumn("_ratio", ratio)
        .withColumn("_level", level)
    )
    share = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", F.col("key") == "", "key", "_level"))).over(every)["_level"]
    return ranked.withColumn("_share", share).select(
        "key",
        "total",
        "weight",
        F.when(F.col("_ratio") < F.col("_share"), F.col("_cap").cast("double"))
        .otherwise(F.coalesce(F.col("_share"), F.lit(0.0)) * F.col("weight"))
        .alias("target"),
    )


def salted(state: DataFrame) -> DataFrame:
    return state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def salt_of(h: Column) -> Column:
    return F.pmod(h, F.lit(SALTS)).cast("int")


def first_overflow(sums: DataFrame, at: str) -> DataFrame:
    """Per source the first value of ``at`` whose running sum exceeds ``left``, and the sum before it."""
    run = W.partitionBy("key").orderBy(at)
    return (
        sums.withColumn("_upto", F.col("base") + F.sum("words").over(run))
        .filter(F.col("_upto") > F.col("left"))
        .groupBy("key")
        .agg(F.min(F.struct(F.col(at), (F.col("_upto") - F.col("words")).alias("base"))).alias("_first"))
        .select("key", F.col("_first")[at].alias(at), F.col("_first.base").alias("base"))
    )


def next_threshold(base: DataFrame, state: DataFrame) -> DataFrame:
    """State after one more round: the hash up to which documents fit, found in three cuts of 12, 12 and 36 bits."""
    rows = base.select("key", "size", "h", "salt")

    def fitting(limits: DataFrame) -> DataFrame:
        return rows.join(salted(limits), ["key", "salt"]).filter(
            (F.col("h") > F.col("low")) & (F.col("size") <= F.col("left")) & (F.col("size") > 0)
        )

    coarse, fine = F.shiftright("h", HASH_BITS - 12), F.shiftright("h", HASH_BITS - 24)
    now = state.select("key", "low", "left")
    sums = fitting(now).groupBy("key", "left", coarse.alias("bucket")).agg(F.sum("size").alias("words"))
    total = sums.groupBy("key").agg(F.sum("words").alias("all_words"))
    one = first_overflow(sums.withColumn("base", F.lit(0).cast("long")), "bucket")
    in_one = fitting(now.join(one, "key")).filter(coarse == F.col("bucket"))
    two = first_overflow(
        in_one.groupBy("key", "left", "base", fine.alias("cell")).agg(F.sum("size").alias("words")), "cell"
    )
    in_two = fitting(now.join(two, "key")).filter(fine == F.col("cell"))
    end = first_overflow(in_two.groupBy("key", "left", "base", "h").agg(F.sum("size").alias("words")), "h")
    found = end.select("key", F.col("h").alias("_end"), F.col("base").alias("_sum"))
    high = F.coalesce("_end", F.lit(1 << HASH_BITS))
    return (
        state.join(found, "key", "left")
        .join(total, "key", "left")
        .withColumn("ranges", F.concat("ranges", F.array(F.struct(F.col("low"), high.alias("high"), F.col("left").alias("most")))))
        .withColumn("left", F.col("left") - F.coalesce("_sum", "all_words", F.lit(0)))
        .withColumn("low", high)
        .drop("_end", "_sum", "all_words")
    )


RANGES = "array<struct<low:bigint,high:bigint,most:double>>"


def mixing_plan(base: DataFrame, weights: DataFrame, repeats: int, rounds: int = ROUNDS) -> DataFrame:
    """One row per source: key, total, target, copies, ranges. ``base`` (key, size, h, salt) must be stored."""
    state = with_targets(weights, F.sum("total"), repeats)
    copies = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0).cast("long")
    state = (
        state.withColumn("copies", copies)
        .withColumn("left", F.col("target") - (F.col("copies") * F.col("total")).cast("double"))
        .withColumn("low", F.lit(-1).cast("long"))
        .withColumn("ranges", F.array().cast(RANGES))
    )
    state = stored(state, "mix-state")
    for _ in range(rounds):
        older, state = state, stored(next_threshold(base, state), "mix-state")
        release(older)
    return state


def mix(docs: DataFrame, repeats: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (size times copies)."""
    marked = docs.select(
        source_key(quoted(source)).alias("key"), word_count(quoted(text)).alias("size"), id_hash(quoted(doc_id)).alias("h")
    )
    base = stored(marked.withColumn("salt", salt_of(F.col("h"))), "mix-base")
    sources = stored(base.groupBy("key").agg(F.sum("size").alias("total")), "mix-sources")
    plan = mixing_plan(base, cyclic_weights(sources), repeats)
    release(base, sources)
    state = salted(plan.select("key", "total", "target", F.col("copies").alias("base_copies"), "ranges")).select(
        F.struct("*").alias("_llm_plan")
    )
    keyed = with_columns(
        docs,
        _llm_key=source_key(quoted(source)),
        _llm_h=id_hash(quoted(doc_id)),
        _llm_size=word_count(quoted(text)),
    )
    plan_of = (F.col("_llm_key") == F.col("_llm_plan.key")) & (salt_of(F.col("_llm_h")) == F.col("_llm_plan.salt"))
    ranges = F.col("_llm_plan.ranges")
    more = F.exists(
        ranges, lambda r: (F.col("_llm_h") > r["low"]) & (F.col("_llm_h") < r["high"]) & (F.col("_llm_size") <= r["most"])
    )
    copies = F.when(F.col("_llm_size") > 0, F.col("_llm_plan.base_copies") + more.cast("long")).otherwise(F.lit(0).cast("long"))
    out = with_columns(
        keyed.join(state, plan_of),
        size=F.col("_llm_size"),
        source_size=F.col("_llm_plan.total"),
        target=F.col("_llm_plan.target"),
        copies=copies,
        taken=F.col("_llm_size") * copies,
    )
    return out.drop("_llm_key", "_llm_h", "_llm_size", "_llm_plan")


def repeated(docs: DataFrame, repeats: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    named = docs.select(
        F.struct("*").alias("_llm_row"), quoted(doc_id).alias("doc_id"), quoted(text).alias("text"), quoted(source).alias("source")
    )
    taken = mix(named, repeats).filter("copies > 0").select("_llm_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return taken.select("_llm_row.*")

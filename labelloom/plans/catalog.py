"""Registered queries: each operator on the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.operators import analysis, criteria, dawid_skene, endmodel, generation, label_model, labeling, majority
from labelloom.operators import manifest, metrics, sampling
from labelloom.operators.classes import (
    class_list,
    encode_labels,
    project_validation_labels,
    split_class_counts,
    unknown_labels,
)
from labelloom.plans.documents import (
    documents,
    gold_splits,
    language_criteria,
    language_task,
    longest_words,
    nth_word,
    proposed_class,
    proposed_criteria,
    table,
    weak_label_quality,
    with_gold,
    word,
)
from labelloom.plans.experiments import next_experiment_number
from labelloom.plans.iterate import predictions_frame
from labelloom.session import delete_path, scratch_path, settled
from labelloom.sizing import compute_once, constant
from labelloom.sources import readers, writers
from labelloom.streaming.judging import JudgedStream, judge
from labelloom.streaming.labelling import append_stream, label_stream, remaining, text_stream

Query = Callable[[SparkSession, str], DataFrame]

DECIMALS = 6
EM_DECIMALS = 4
# Fixed parameters of the registered queries.
VOTE_WEIGHTS = {"en_the": 2.0, "fr_eau": 0.5, "es_que": 0.25}
SPLIT_SEED = 7
BALANCED_SIZE = 450
DEV_SIZE = 120
CRITERIA_MAXIMUM = 500
CRITERIA_PER_REQUEST = 5
STREAM_CRITERIA_PER_REQUEST = 8
SAMPLE_SIZE = 100
BLOCK_CHARS = 20_000
CONFIDENCE = 0.6
# The scale that seed 0 draws for the label model's start.
LM_START_SCALE = 0.6369616873214543


def r6(column: Column | str) -> Column:
    return F.round(column, DECIMALS)


def r4(column: Column | str) -> Column:
    return F.round(column, EM_DECIMALS)


# --- sources -------------------------------------------------------------------------


def src_keyed_json(spark, sf):
    lines = writers.keyed_json_lines(documents(spark, sf))
    return readers.parse_keyed_json(lines).select("item_id", "text", "label")


def dialogue_lines(docs: DataFrame) -> DataFrame:
    """JSON lines of every kind a careless export contains, chosen by the document's source."""
    flag = (
        F.when(F.col("source") == "src3", "null")
        .when(F.col("source") == "src4", '"1.5"')
        .when(F.col("source") == "src5", "true")
        .when(F.col("source") == "src6", "1.7")
        .when(F.col("source") == "src7", '"1"')
        .when(F.col("source") == "src8", '"often"')
        .otherwise(F.col("n_chars").cast("string"))
    )
    head = F.to_json(F.struct(F.col("text").alias("dialogue")))
    body = F.substring(head, F.lit(1), F.length(head) - 1)
    line = (
        F.when(F.col("source") == "src0", "  ")
        .when(F.col("source") == "src1", body)
        .when(F.col("source") == "src2", head)
        .otherwise(F.concat(body, F.lit(', "flag": '), flag, F.lit("}")))
    )
    return docs.select("doc_id", line.alias("value"))


def src_tolerant_jsonl(spark, sf):
    lines = dialogue_lines(table(spark, sf, "documents"))
    return readers.parse_tolerant_jsonl(lines, "dialogue", "flag")


def src_criteria(spark, sf):
    docs = table(spark, sf, "documents")
    proposed = proposed_criteria(docs).join(docs.select(F.col("doc_id").alias("ord"), "source"), "ord")
    line = F.to_json(F.struct("criterion", "description", "class"))
    lines = proposed.select("ord", F.when(F.col("source") == "src2", F.lit(" ")).otherwise(line).alias("value"))
    return readers.parse_criteria(lines, F.col("ord"))


def criteria_last_wins(spark, sf):
    return criteria.last_wins(proposed_criteria(table(spark, sf, "documents")))


def verdicts_flatten(spark, sf):
    ballots, _, lfs = language_task(spark, sf, keep=("text",))
    # an item no criterion holds for is stored as not judged
    unsure = ballots.withColumn("fired", F.when(F.size("fired") > 0, F.col("fired")))
    stored = writers.verdict_records(labeling.verdicts(unsure, lfs, keep=("text",)))
    lines = stored.select(F.to_json(F.struct(*stored.columns), {"ignoreNullFields": "false"}).alias("value"))
    return readers.flatten_verdicts(readers.parse_verdicts(lines))


def sample_loader(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "text", F.col("lang").alias("intent"))
    return readers.load_samples(docs, "doc_id", SAMPLE_SIZE)


def sample_loader_named(spark, sf):
    part = table(spark, sf, "part")
    names = part.select(
        F.col("p_size").alias("class_idx"), F.concat(F.lit("size "), F.col("p_size")).alias("class_name")
    ).distinct()
    rows = part.select("p_partkey", F.col("p_name").alias("utterance"), "p_brand", F.col("p_size").alias("labels"))
    return readers.load_samples(rows, "p_partkey", label_names=names)


# --- splits --------------------------------------------------------------------------


def _prepared(spark, sf) -> DataFrame:
    return sampling.prepare_splits(*gold_splits(spark, sf), DEV_SIZE, seed=SPLIT_SEED)


def prepare_splits(spark, sf):
    return _prepared(spark, sf).select("item_id", "label", "split")


def prepare_colliding_ids(spark, sf):
    """Raw parts that are each numbered from 0, as raw files are."""

    def renumbered(part: DataFrame) -> DataFrame:
        # rows are numbered within ranges of ids, behind the rows of the ranges before; the ranges are cut once
        cut = part.select("item_id").repartitionByRange("item_id").withColumn("range", F.spark_partition_id())
        cut = settled(cut)
        before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
        offsets = cut.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
        inner = F.row_number().over(W.partitionBy("range").orderBy("item_id"))
        numbers = cut.withColumn("inner", inner).join(offsets, "range").select(
            "item_id", (F.col("first") + F.col("inner") - 1).alias("n")
        )
        return part.join(numbers, "item_id").select(
            F.col("n").cast("bigint").alias("item_id"), "label", F.col("item_id").alias("real_id")
        )

    parts = [renumbered(p) for p in gold_splits(spark, sf)]
    splits = sampling.prepare_raw_splits(*parts, DEV_SIZE, seed=SPLIT_SEED)
    return splits.select("item_id", "old_split", "old_id", "label", "real_id", "split")


def prepare_splits_valid_only(spark, sf):
    splits = sampling.prepare_splits_from_valid(*gold_splits(spark, sf), DEV_SIZE, seed=SPLIT_SEED)
    return splits.select("item_id", "label", "split")


def split_class_check(spark, sf):
    return split_class_counts(_prepared(spark, sf))


def balanced_split(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"), F.when(F.col("source") != "src0", F.col("lang")).alias("label")
    )
    return sampling.balanced_split(docs, "label", BALANCED_SIZE, SPLIT_SEED)


def holdout_split(spark, sf):
    return sampling.holdout(documents(spark, sf).select("item_id"), 0.1, 42)


def balanced_lineitems(spark, sf):
    """The same split on the biggest table: line items balanced over return flag and status."""
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item_id"),
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("label"),
    )
    return sampling.balanced_split(rows, "label", BALANCED_SIZE, SPLIT_SEED).groupBy("label", "chosen").agg(
        F.count("*").alias("n"), F.sum("item_id").alias("ids")
    )


# --- labeling ------------------------------------------------------------------------


def lf_keyword_verdicts(spark, sf):
    ballots, _, lfs = language_task(spark, sf)
    return readers.flatten_verdicts(labeling.verdicts(ballots, lfs))


def votes_long(spark, sf):
    ballots, _, lfs = language_task(spark, sf)
    return labeling.votes_long(ballots, lfs)


def votes_in_blocks(spark, sf):
    """The same votes by the way taken for large criteria tables: an index of rare grams."""
    items = documents(spark, sf)
    return labeling.keyword_votes_long(items, language_criteria(spark), class_list(items), planned=5)


def votes_many_criteria(spark, sf):
    """Criteria that the documents themselves propose, as many as there are different first words."""
    docs = table(spark, sf, "documents")
    classes = class_list(docs.select(proposed_class().alias("class")), label="class")
    return labeling.keyword_votes_long(documents(spark, sf), proposed_criteria(docs), classes)


def votes_per_item(spark, sf):
    ballots, _, _ = language_task(spark, sf)
    pair = F.transform("votes", lambda v: F.concat(v["lf"].cast("string"), F.lit(":"), v["c"].cast("string")))
    return ballots.select("item_id", F.size("votes").cast("bigint").alias("n_votes"), F.array_join(pair, ",").alias("votes"))


def vote_matrix_wide(spark, sf):
    ballots, _, lfs = language_task(spark, sf)
    return labeling.vote_matrix(ballots, lfs)


def vote_matrix_json(spark, sf):
    ballots, _, lfs = language_task(spark, sf)
    return writers.vote_matrix_lines(ballots, lfs.names)


def lf_request_chunks(spark, sf):
    chunks = labeling.request_chunks(language_criteria(spark), "Short prose.", CRITERIA_PER_REQUEST)
    requests = labeling.model_requests(documents(spark, sf), chunks)
    return requests.select("item_id", "chunk", F.md5("prompt").alias("prompt_md5"), F.length("text").alias("n_chars"))


def answers_of(ballots: DataFrame, lfs: labeling.LabelingSet, docs: DataFrame) -> DataFrame:
    """Model answers made from the keyword verdicts: wrapped in prose, some broken, some failed."""
    names = constant(lfs.names, "array<string>")
    found = F.transform("fired", lambda lf: F.get(names, lf))
    half = F.filter(found, lambda n: n.startswith("e") == (F.col("chunk") == 0))
    half = F.when(F.col("source") == "src6", F.array_append(half, "unheard of")).otherwise(half)
    listed = F.to_json(F.struct(F.lit("line\none").alias("thoughts"), half.alias("found_criteria")))
    raw_break = F.replace(listed, F.lit("\\n"), F.lit("\n"))
    content = (
        F.when((F.col("source") == "src5") & (F.col("chunk") == 1), "no object here")
        .otherwise(F.concat(F.lit("Sure: "), raw_break, F.lit(" That is all.")))
    )
    chunked = ballots.join(docs, "item_id").withColumn("chunk", F.explode(F.array(F.lit(0), F.lit(1))))
    return chunked.select(
        "item_id", "chunk", content.alias("content"),
        ((F.col("source") == "src3") & (F.col("chunk") == 1)).alias("failed"),
    )


def lf_response_verdicts(spark, sf):
    ballots, _, lfs = language_task(spark, sf)
    sources = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "source")
    fired = labeling.fired_by_answers(answers_of(ballots, lfs, sources), lfs)
    return readers.flatten_verdicts(labeling.verdicts(fired, lfs))


def lf_summary(spark, sf):
    ballots, classes, lfs = language_task(spark, sf)
    summary = analysis.lf_summary(with_gold(ballots, classes), lfs)
    return summary.select(
        "criterion",
        F.array_join(F.col("polarity").cast("array<string>"), ",").alias("polarity"),
        r6("coverage").alias("coverage"),
        r6("overlaps").alias("overlaps"),
        r6("conflicts").alias("conflicts"),
        "correct",
        "incorrect",
        r6("emp_acc").alias("emp_acc"),
    )


def lf_filter(spark, sf):
    ballots, classes, lfs = language_task(spark, sf)
    kept = analysis.good_lfs(analysis.lf_summary(with_gold(ballots, classes), lfs), 0.5)
    return analysis.restrict_criteria(language_criteria(spark), kept).select("ord", "criterion", "class")


# --- majority vote -------------------------------------------------------------------


def _voted(spark, sf, weights=None):
    task, classes, lfs = language_task(spark, sf)
    ballots = settled(with_gold(task.drop("fired"), classes))
    return ballots, lfs, majority.fit_majority(ballots, lfs, weights)


def mv_prior(spark, sf):
    _, _, model = _voted(spark, sf)
    return model.prior_frame(spark).select("class_idx", r6("prior").alias("prior"))


def mv_vote_counts(spark, sf):
    ballots, lfs, model = _voted(spark, sf, VOTE_WEIGHTS)
    return majority.vote_counts_long(ballots, lfs, model)


def _hard(ties: str) -> Query:
    def query(spark, sf):
        ballots, lfs, model = _voted(spark, sf)
        return majority.predict_hard(ballots, lfs, model, ties, seed=SPLIT_SEED).select("item_id", "pred")

    return query


def mv_proba(spark, sf):
    ballots, lfs, model = _voted(spark, sf)
    scored = majority.predict_proba(ballots, lfs, model)
    flat = scored.select("item_id", F.posexplode("proba").alias("i", "p"))
    classes = constant(list(model.classes), "array<int>")
    return flat.select("item_id", F.get(classes, "i").alias("class_idx"), r6("p").alias("p"))


def mv_soft(spark, sf):
    ballots, lfs, model = _voted(spark, sf, VOTE_WEIGHTS)
    return majority.predict_soft(ballots, lfs, model).select("item_id", "pred")


def confident_weak_labels(spark, sf):
    ballots, lfs, model = _voted(spark, sf)
    kept = analysis.confident(majority.predict_proba(ballots, lfs, model), CONFIDENCE)
    return kept.select("item_id", "weak_label", r6(F.array_max("proba")).alias("p"))


def annotator_stats(spark, sf):
    ballots, lfs, model = _voted(spark, sf, VOTE_WEIGHTS)
    stats = analysis.annotator_stats(ballots, lfs, model)
    return stats.withColumns({c: r6(c) for c in ("missing_rate", "class_prop")})


def consensus_metrics(spark, sf):
    ballots, lfs, model = _voted(spark, sf)
    out = analysis.consensus_metrics(ballots, lfs, model)
    return out.withColumns({c: r6(c) for c in ("consensus_rate", "total_agreement_rate")})


# --- evaluation ----------------------------------------------------------------------


def _scored_models(spark, sf) -> DataFrame:
    """Predictions of three rules; the last one abstains on items without a vote."""
    ballots, lfs, model = _voted(spark, sf)
    hard = majority.predict_hard(ballots, lfs, model, "prior")
    rules = F.array(
        F.struct(F.lit(0).alias("run"), F.col("pred").alias("pred")),
        F.struct(F.lit(1).alias("run"), F.col("first").alias("pred")),
        F.struct(F.lit(2).alias("run"), F.when(F.size("votes") > 0, F.col("pred")).otherwise(-1).alias("pred")),
    )
    both = majority.predict_hard(hard.withColumnRenamed("pred", "_prior"), lfs, model, "first")
    named = both.withColumnRenamed("pred", "first").withColumnRenamed("_prior", "pred")
    return named.select("item_id", "label_idx", F.inline(rules))


def predictions_table(spark, sf):
    ballots, lfs, model = _voted(spark, sf)
    scored = majority.predict_hard(ballots, lfs, model, "prior")
    return predictions_frame(scored, documents(spark, sf), "majority_vote", "all")


def confusion_matrix(spark, sf):
    return metrics.confusion(_scored_models(spark, sf), by=("run",))


def macro_metrics(spark, sf):
    scores = metrics.macro_metrics(_scored_models(spark, sf), by=("run",))
    return scores.select("run", *[r6(m).alias(m) for m in metrics.METRICS])


def run_summary(spark, sf):
    runs = metrics.macro_metrics(_scored_models(spark, sf), by=("run",))
    return metrics.run_summary(runs).select(
        "metric", *[r6(F.col("runs.value")[i]).alias(f"iter{i}") for i in range(3)],
        r6("mean").alias("mean"), r6("std").alias("std"),
    )


def error_split(spark, sf):
    ballots, lfs, model = _voted(spark, sf)
    scored = majority.predict_hard(ballots, lfs, model, "prior")
    return analysis.split_errors(scored).select("item_id", "label", "label_idx", "pred", "outcome")


def weak_label_scores(spark, sf):
    return weak_label_quality(spark, sf).select(*[r6(m).alias(m) for m in metrics.METRICS])


# --- Dawid-Skene ---------------------------------------------------------------------


def _after(spark, sf, n: int):
    task, classes, lfs = language_task(spark, sf)
    ballots = settled(with_gold(task.drop("fired"), classes))
    return ballots, dawid_skene.fit(ballots, lfs, options=dawid_skene.Options(max_iter=n))


def ds_init_prior(spark, sf):
    return _after(spark, sf, 0)[1].prior_frame(spark).select("class_idx", r6("p").alias("p"))


def _confusion(spark, model, rounded=r6):
    return model.confusion_frame(spark).withColumn("p", rounded("p"))


def ds_init_cm(spark, sf):
    return _confusion(spark, _after(spark, sf, 0)[1])


def ds_estep(spark, sf):
    ballots, model = _after(spark, sf, 0)
    flat = dawid_skene.predict_proba(ballots, model).select("item_id", F.posexplode("proba").alias("class_idx", "p"))
    return flat.withColumn("p", r6("p"))


def ds_mstep(spark, sf):
    return _confusion(spark, _after(spark, sf, 1)[1])


def ds_mstep_prior(spark, sf):
    return _after(spark, sf, 1)[1].prior_frame(spark).select("class_idx", r6("p").alias("p"))


def ds_fit_3iter(spark, sf):
    return _confusion(spark, _after(spark, sf, 3)[1], r4)


def ds_predict(spark, sf):
    return dawid_skene.predict(*_after(spark, sf, 3)).select("item_id", "pred")


def ds_annotator_quality(spark, sf):
    _, model = _after(spark, sf, 3)
    quality = dawid_skene.annotator_quality(model.confusion_frame(spark), len(model.classes))
    return quality.withColumns({c: r4(c) for c in ("accuracy", "entropy")})


def ds_fit(spark, sf):
    ballots, model = _after(spark, sf, 30)
    scores = metrics.macro_metrics(dawid_skene.predict(ballots, model))
    return scores.select(*[r6(m).alias(m) for m in metrics.METRICS], F.lit(model.n_iter).alias("n_iter"))


# --- label model ---------------------------------------------------------------------


def lm_moments(spark, sf):
    ballots, _, lfs = language_task(spark, sf)
    return label_model.moments(ballots, lfs).withColumn("rate", r6("rate"))


def lm_predict_fixed_params(spark, sf):
    ballots, classes, lfs = language_task(spark, sf)
    mu = np.full((len(lfs), len(classes)), 0.05)
    for f in lfs.functions:
        mu[f.lf, f.class_idx] = 0.5 + 0.02 * f.lf
    model = label_model.LabelModel(lfs, len(classes), mu, np.full(len(classes), 1 / len(classes)))
    scored = label_model.predict(ballots, model)
    return scored.select("item_id", r6(F.array_max("proba")).alias("p"), "pred")


def _label_model(spark, sf):
    task, classes, lfs = language_task(spark, sf)
    ballots = settled(with_gold(task.drop("fired"), classes))
    options = label_model.LabelModelOptions(start_scale=LM_START_SCALE)
    return ballots, label_model.fit(ballots, lfs, len(classes), options=options)


def lm_params(spark, sf):
    _, model = _label_model(spark, sf)
    return model.mu_frame(spark).select("criterion", "true_idx", r6("p").alias("p"))


def lm_fit(spark, sf):
    scores = metrics.macro_metrics(label_model.predict(*_label_model(spark, sf)))
    return scores.select(*[r6(m).alias(m) for m in metrics.METRICS])


# --- end models ----------------------------------------------------------------------


def endmodel_weak(spark, sf):
    train, valid, test = gold_splits(spark, sf)
    held = valid.unionByName(test)
    classes = class_list(held)
    lfs = labeling.labeling_set(language_criteria(spark), classes)
    # training reads the texts anyway, so judging them again there beats a join on the texts
    ballots = labeling.keyword_ballots(train, lfs, keep=("text",))
    model = majority.fit_majority(ballots, lfs)
    taught = majority.predict_hard(ballots, lfs, model).withColumnRenamed("pred", "weak_label")
    return metrics.macro_metrics(endmodel.weak_label_model(taught, with_gold(held, classes)))


def baseline_supervised(spark, sf):
    items = documents(spark, sf)
    runs = endmodel.supervised_baseline(items, class_list(items), DEV_SIZE)
    return metrics.run_summary(runs).select("metric", "mean", "std")


def valid_label_projection(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("label"))
    labels = table(spark, sf, "labels")
    train = docs.join(labels.filter("toxic = 1"), "doc_id", "left_semi")
    valid = docs.join(labels, "doc_id", "left_semi")
    return project_validation_labels(valid, train, constant="src1")


def label_encode(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.substring("source", 4, 10).alias("label"))
    return encode_labels(docs)


def label_index_check(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("label"))
    gold = docs.join(table(spark, sf, "labels").filter("toxic = 1 and quality = 0"), "doc_id", "left_semi")
    return unknown_labels(docs, class_list(gold))


# --- criteria ------------------------------------------------------------------------


def criteria_cap(spark, sf):
    new = criteria.last_wins(proposed_criteria(table(spark, sf, "documents")))
    return criteria.cap_new(language_criteria(spark), new, CRITERIA_MAXIMUM, SPLIT_SEED)


def criteria_accumulate(spark, sf):
    docs = table(spark, sf, "documents")
    existing = proposed_criteria(docs.filter("lang = 'fr'"))
    return criteria.accumulate(existing, proposed_criteria(docs.filter("lang <> 'fr'")))


def criteria_dedup(spark, sf):
    docs = table(spark, sf, "documents")
    named = F.array(word(F.col("text"), 1), F.lit("never proposed"))
    answers = docs.filter("lang = 'fr'").select(
        F.concat(F.lit("Here: "), F.to_json(F.struct(named.alias("unique_criteria")))).alias("content")
    )
    return criteria.keep_unique(proposed_criteria(docs), answers).select("ord", "criterion", "description", "class")


def criteria_dedup_unreadable(spark, sf):
    """One of the answers breaks off: no criterion may be lost for it."""
    docs = table(spark, sf, "documents")
    named = F.to_json(F.struct(F.array(word(F.col("text"), 1)).alias("unique_criteria")))
    answers = docs.select(F.when(F.col("source") == "src1", F.lit('{"unique_criteria": ["a')).otherwise(named).alias("content"))
    return criteria.keep_unique(proposed_criteria(docs), answers).select("ord", "criterion", "description", "class")


def criteria_ingest(spark, sf):
    docs = table(spark, sf, "documents")
    docs = compute_once(docs, "doc_id", "source", "lang", words=F.slice(longest_words(F.col("text")), 1, 3))
    named = [nth_word(F.col("words"), n) for n in (1, 2, 3)]
    listed = [
        F.struct(a.alias("criterion"), F.lower(b).alias("description"), F.col("lang").alias("class"))
        for a, b in zip(named, named[1:])
    ]
    object_text = F.to_json(F.struct(F.array(*listed).alias("criteria")))
    content = F.when(F.col("source") == "src4", F.lit("{broken")).otherwise(F.concat(F.lit("```"), object_text, F.lit("```")))
    answers = docs.select(
        F.col("doc_id").alias("request_no"), content.alias("content"), (F.col("source") == "src3").alias("failed")
    )
    return criteria.ingest_generated(answers)


def _judged(spark, sf) -> DataFrame:
    # the texts are needed with their outcome: judging them twice beats a join on the texts
    task, classes, lfs = language_task(spark, sf, keep=("label", "text"))
    model = majority.fit_majority(task, lfs)
    scored = majority.predict_hard(with_gold(task, classes), lfs, model)
    return analysis.split_errors(scored).select("item_id", "text", "label", "outcome")


def generation_context(spark, sf):
    fragments = generation.context_fragments(_judged(spark, sf))
    return fragments.select("label", "outcome", "fragment", "n_texts", F.md5("body").alias("body_md5"))


def generation_sizes(spark, sf):
    return generation.context_sizes(_judged(spark, sf))


def _blocks(spark, sf):
    judged = _judged(spark, sf)
    return judged, *manifest.block_store(judged, BLOCK_CHARS)


def generation_blocks(spark, sf):
    _, blocks, groups = _blocks(spark, sf)
    numbered = manifest.numbered_blocks(blocks, groups)
    return numbered.select("block", "label", "outcome", "n_texts", "n_chars", F.md5("body").alias("body_md5"))


def generation_requests(spark, sf):
    judged, _, groups = _blocks(spark, sf)
    return manifest.request_manifest(groups, judged)


def resume_remaining(spark, sf):
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"))
    return remaining(documents(spark, sf).select("item_id", "label"), done)


def next_experiment_id(spark, sf):
    names = table(spark, sf, "documents").select(F.regexp_replace("source", "src", "exp_").alias("name"))
    return next_experiment_number(names)


# --- streaming -----------------------------------------------------------------------


def _document_stream(spark, sf) -> DataFrame:
    """All files of the table. As a pattern, the path may be one file or a folder of them."""
    stream = text_stream(spark, f"{sf}/documents.{{parquet}}", table(spark, sf, "documents").schema)
    return stream.select(F.col("doc_id").alias("item_id"), "text")


def stream_labelling(spark, sf):
    lfs = labeling.labeling_set(language_criteria(spark), class_list(documents(spark, sf)))
    out, state = scratch_path(spark, "verdicts"), scratch_path(spark, "progress")
    append_stream(label_stream(_document_stream(spark, sf), lfs), out, state).awaitTermination()
    delete_path(spark, state)
    return readers.flatten_verdicts(spark.read.parquet(out))


def failing_model(lfs: labeling.LabelingSet, per_request: int) -> Callable[[DataFrame], DataFrame]:
    """A stand-in for a model: names the keyword criteria of its chunk, and fails for some texts once or always."""
    names = constant(lfs.names, "array<string>")
    own = F.filter("fired", lambda lf: F.floor(lf / per_request) == F.col("chunk"))
    found = F.to_json(F.struct(F.transform(own, lambda lf: F.get(names, lf)).alias("found_criteria")))
    fails = F.when(F.col("chunk") == 0, F.length("text") % 7 == 3).otherwise(
        (F.length("text") % 5 == 1) & (F.col("attempt") == 0)
    )

    def answer(requests: DataFrame) -> DataFrame:
        fired = labeling.fired_by_keywords(F.col("text"), lfs)
        judged = compute_once(requests, "item_id", "chunk", "attempt", "text", fired=fired)
        return judged.select("item_id", "chunk", found.alias("content"), fails.alias("failed"))

    return answer


def _model_run(spark, sf):
    lfs = labeling.labeling_set(language_criteria(spark), class_list(documents(spark, sf)))
    chunks = labeling.request_chunks(language_criteria(spark), "Short prose.", STREAM_CRITERIA_PER_REQUEST)
    return lfs, chunks, failing_model(lfs, STREAM_CRITERIA_PER_REQUEST)


def model_labelling(spark, sf):
    lfs, chunks, model = _model_run(spark, sf)
    return readers.flatten_verdicts(labeling.verdicts(judge(documents(spark, sf), lfs, chunks, model), lfs))


def stream_model_labelling(spark, sf):
    lfs, chunks, model = _model_run(spark, sf)
    stream = JudgedStream(scratch_path(spark, "judged"), lfs, chunks, model)
    ballots = stream.run(_document_stream(spark, sf))
    stream.finish(spark)
    return readers.flatten_verdicts(labeling.verdicts(ballots, lfs))


QUERIES: dict[str, Query] = {
    "weak_label_scores": weak_label_scores,
    "src_keyed_json": src_keyed_json,
    "src_tolerant_jsonl": src_tolerant_jsonl,
    "src_criteria": src_criteria,
    "criteria_last_wins": criteria_last_wins,
    "verdicts_flatten": verdicts_flatten,
    "sample_loader": sample_loader,
    "sample_loader_named": sample_loader_named,
    "prepare_splits": prepare_splits,
    "prepare_colliding_ids": prepare_colliding_ids,
    "prepare_splits_valid_only": prepare_splits_valid_only,
    "split_class_check": split_class_check,
    "balanced_split": balanced_split,
    "balanced_lineitems": balanced_lineitems,
    "holdout_split": holdout_split,
    "lf_keyword_verdicts": lf_keyword_verdicts,
    "votes_long": votes_long,
    "votes_in_blocks": votes_in_blocks,
    "votes_many_criteria": votes_many_criteria,
    "votes_per_item": votes_per_item,
    "vote_matrix_wide": vote_matrix_wide,
    "vote_matrix_json": vote_matrix_json,
    "lf_request_chunks": lf_request_chunks,
    "lf_response_verdicts": lf_response_verdicts,
    "lf_summary": lf_summary,
    "lf_filter": lf_filter,
    "mv_prior": mv_prior,
    "mv_vote_counts": mv_vote_counts,
    "mv_hard_prior": _hard("prior"),
    "mv_hard_first": _hard("first"),
    "mv_hard_random": _hard("random"),
    "mv_proba": mv_proba,
    "mv_soft": mv_soft,
    "confident_weak_labels": confident_weak_labels,
    "annotator_stats": annotator_stats,
    "consensus_metrics": consensus_metrics,
    "predictions_frame": predictions_table,
    "confusion_matrix": confusion_matrix,
    "macro_metrics": macro_metrics,
    "run_summary": run_summary,
    "error_split": error_split,
    "ds_init_prior": ds_init_prior,
    "ds_init_cm": ds_init_cm,
    "ds_estep": ds_estep,
    "ds_mstep": ds_mstep,
    "ds_mstep_prior": ds_mstep_prior,
    "ds_fit_3iter": ds_fit_3iter,
    "ds_predict": ds_predict,
    "ds_annotator_quality": ds_annotator_quality,
    "ds_fit": ds_fit,
    "lm_moments": lm_moments,
    "lm_predict_fixed_params": lm_predict_fixed_params,
    "lm_params": lm_params,
    "lm_fit": lm_fit,
    "endmodel_weak": endmodel_weak,
    "baseline_supervised": baseline_supervised,
    "valid_label_projection": valid_label_projection,
    "label_encode": label_encode,
    "label_index_check": label_index_check,
    "criteria_cap": criteria_cap,
    "criteria_accumulate": criteria_accumulate,
    "criteria_dedup": criteria_dedup,
    "criteria_dedup_unreadable": criteria_dedup_unreadable,
    "criteria_ingest": criteria_ingest,
    "generation_context": generation_context,
    "generation_sizes": generation_sizes,
    "generation_blocks": generation_blocks,
    "generation_requests": generation_requests,
    "resume_remaining": resume_remaining,
    "next_experiment_id": next_experiment_id,
    "stream_labelling": stream_labelling,
    "model_labelling": model_labelling,
    "stream_model_labelling": stream_model_labelling,
}

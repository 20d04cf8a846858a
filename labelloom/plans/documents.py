"""The document tables as labelling projects, and the keyword criteria used on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.operators.classes import ClassList, class_list, with_class_index
from labelloom.operators.labeling import LabelingSet, keyword_ballots, labeling_set
from labelloom.operators.majority import fit_majority, predict_hard
from labelloom.operators.metrics import macro_metrics
from labelloom.session import settled
from labelloom.sizing import compute_once, local_frame

# Keyword criteria for the language of a document (name, keywords, class).
LANGUAGE_CRITERIA = (
    ("en_the", " the ", "en"),
    ("en_of_and", " of +and", "en"),
    ("en_tion_ou", "tion+ou", "en"),
    ("fr_eau", "eau", "fr"),
    ("fr_le", " le ", "fr"),
    ("fr_ou_e", "ou+è", "fr"),
    ("de_und", " und ", "de"),
    ("de_sch", "sch", "de"),
    ("de_ue", "ü", "de"),
    ("de_der_ie", " der +ie", "de"),
    ("es_n", "ñ", "es"),
    ("es_que", " que ", "es"),
    ("es_cion", "ción", "es"),
    ("es_el", " el ", "es"),
    ("es_los", " los ", "es"),
    ("en_nothing", "zzzqq", "en"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the language task: item_id, text, label."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), "text", F.col("lang").alias("label")
    )


def language_criteria(spark: SparkSession) -> DataFrame:
    rows = [(i, *c) for i, c in enumerate(LANGUAGE_CRITERIA)]
    return local_frame(spark, rows, "ord bigint, criterion string, description string, class string")


def language_task(
    spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ("label",)
) -> tuple[DataFrame, ClassList, LabelingSet]:
    """Ballots (item_id, kept columns, fired, votes), class list and labeling functions."""
    items = documents(spark, sf_dir)
    classes = class_list(items)
    lfs = labeling_set(language_criteria(spark), classes)
    return keyword_ballots(items, lfs, keep=keep), classes, lfs


def with_gold(ballots: DataFrame, classes: ClassList) -> DataFrame:
    return with_class_index(ballots, classes)


def weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword criteria to votes to majority labels to macro scores; the texts are read once."""
    task, classes, lfs = language_task(spark, sf_dir)
    ballots = settled(with_gold(task.drop("fired"), classes))
    model = fit_majority(ballots, lfs)
    return macro_metrics(predict_hard(ballots, lfs, model, "prior"))


def longest_words(text: Column) -> Column:
    """The different blank-separated words of the whole text, longest first."""
    words = F.array_remove(F.array_distinct(F.split(text, " ")), "")
    ranked = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("k"), w.alias("w"))))
    return ranked["w"]


def nth_word(words: Column, n: int) -> Column:
    return F.coalesce(F.get(words, F.lit(n - 1)), F.lit(""))


def word(text: Column, n: int) -> Column:
    """The n-th longest word of the whole text; empty if there are fewer."""
    return nth_word(longest_words(text), n)


def proposed_criteria(docs: DataFrame) -> DataFrame:
    """Keyword criteria proposed by each document: its longest words, for its class.

    Names repeat across documents, as they do when a model is asked again and again.
    """
    first, second = (nth_word(F.col("words"), n) for n in (1, 2))
    return compute_once(docs, "doc_id", "source", "lang", words=F.slice(longest_words(F.col("text")), 1, 2)).select(
        F.col("doc_id").alias("ord"),
        first.alias("criterion"),
        F.concat(F.lower(first), F.lit("+"), F.lower(second)).alias("description"),
        proposed_class().alias("class"),
    )


def proposed_class() -> Column:
    """Named by language or by number with a leading zero."""
    return F.when(F.col("lang") == "de", F.col("lang")).otherwise(F.concat(F.lit("0"), F.substring("source", 4, 10)))


def gold_splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """train: documents nobody labelled; valid and test: those of quality 1 and 0."""
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), "quality")
    train = docs.join(labels, "item_id", "left_anti")
    valid = docs.join(labels.filter("quality = 1").select("item_id"), "item_id", "left_semi")
    test = docs.join(labels.filter("quality = 0").select("item_id"), "item_id", "left_semi")
    return train, valid, test

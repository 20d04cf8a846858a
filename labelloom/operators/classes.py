"""The class list of a project and the mapping between labels and class numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.text import int_or_text
from labelloom.sizing import local_frame, rows_within

MAX_CLASSES = 50_000


@dataclass(frozen=True)
class ClassList:
    """Class names in index order."""

    names: tuple[str, ...]

    def __len__(self) -> int:
        return len(self.names)

    def frame(self, spark: SparkSession) -> DataFrame:
        return local_frame(spark, list(enumerate(self.names)), "class_idx int, class_name string")


def class_list(labelled: DataFrame, label: str = "label") -> ClassList:
    """The distinct labels of the gold sample: whole numbers by value, then others by name.

    Nulls are no class.
    """
    name = int_or_text(F.col(label))
    names = labelled.select(name.alias("name"), name.try_cast("bigint").alias("number")).filter("name is not null")
    rows = rows_within(names.distinct(), MAX_CLASSES)
    if rows is None:
        raise ValueError(f"more than {MAX_CLASSES} distinct labels: this is not a class column")
    ordered = sorted(rows, key=lambda r: (r.number is None, r.number or 0, r.name))
    return ClassList(tuple(r.name for r in ordered))


def with_class_index(
    df: DataFrame, classes: ClassList, label: str = "label", index: str = "label_idx"
) -> DataFrame:
    """Attach the class number of each label (null for a label outside the list)."""
    lookup = classes.frame(df.sparkSession).select(F.col("class_idx").alias(index), "class_name")
    key = int_or_text(F.col(label))
    return df.join(lookup, key == F.col("class_name"), "left").drop("class_name")


def unknown_labels(df: DataFrame, classes: ClassList, label: str = "label") -> DataFrame:
    """Labels without a class, with their row counts. Empty when all labels are known."""
    counted = df.groupBy(int_or_text(F.col(label)).alias("label")).agg(F.count("*").alias("n_items"))
    lookup = classes.frame(df.sparkSession)
    return counted.filter("label is not null").join(
        lookup, F.col("label") == F.col("class_name"), "left_anti"
    )


def require_known_labels(df: DataFrame, classes: ClassList, label: str = "label") -> None:
    unknown = unknown_labels(df, classes, label).orderBy("label").limit(5).collect()
    if unknown:
        raise KeyError(f"labels outside the class list: {[r.label for r in unknown]}")


def project_validation_labels(
    valid: DataFrame, train: DataFrame, label: str = "label", mode: str = "constant", constant: str = "1"
) -> DataFrame:
    """Fit validation labels to the classes the training labels cover.

    ``mode="constant"`` replaces a label the training set lacks by ``constant``;
    ``mode="drop"`` removes such rows instead.
    """
    if mode not in ("constant", "drop"):
        raise ValueError(f"unknown mode: {mode}")
    seen = train.select(F.col(label).cast("string").alias("_seen")).distinct()
    own = F.col(label).cast("string")
    if mode == "drop":
        return valid.join(seen, own == F.col("_seen"), "left_semi")
    joined = valid.join(seen, own == F.col("_seen"), "left")
    return joined.withColumn(label, F.when(F.col("_seen").isNotNull(), own).otherwise(F.lit(constant))).drop("_seen")


def encode_labels(df: DataFrame, label: str = "label", code: str = "label_id") -> DataFrame:
    """Labels as consecutive numbers in class order (decode with ``decode_labels``)."""
    return with_class_index(df, class_list(df, label), label, code)


def decode_labels(df: DataFrame, classes: ClassList, code: str = "label_id", label: str = "label") -> DataFrame:
    lookup = classes.frame(df.sparkSession).select(F.col("class_idx").alias(code), F.col("class_name").alias(label))
    return df.join(lookup, code, "left")


def require_class_count(splits: DataFrame, expected: int) -> None:
    bad = split_class_counts(splits).filter(F.col("n_classes") != expected).collect()
    if bad:
        raise ValueError(f"expected {expected} classes in every split, got {[(r.split, r.n_classes) for r in bad]}")


def split_class_counts(splits: DataFrame) -> DataFrame:
    """Rows and distinct labels per split (a null label counts as a label).

    Rows are first counted per (split, label), so no task ever holds a whole split.
    """
    cells = splits.groupBy("split", "label").agg(F.count("*").alias("n"))
    return cells.groupBy("split").agg(
        F.sum("n").alias("n_items"), F.count("*").alias("n_classes")
    )

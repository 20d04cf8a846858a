"""Readers for the file formats of a labelling project.

Every reader is a line or file scan followed by a parse expression. The parse step is
public too (``parse_*``), so that rows from any other source can go through it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.text import int_or_text
from labelloom.sizing import compute_once, constant

KEYED_ENTRY = "map<string,struct<data:struct<text:string>,label:string,weak_labels:array<int>>>"
CRITERION = "criterion string, description string, class string"
VERDICT = "index bigint, text string, labels map<string,boolean>"


# --- keyed JSON splits ---------------------------------------------------------------


def parse_keyed_json(objects: DataFrame, value: str = "value") -> DataFrame:
    """Rows of an object keyed by item number: item_id, text, label, weak_labels.

    Missing ``data``, ``text`` or ``label`` become null.
    """
    parsed = F.from_json(F.col(value), KEYED_ENTRY)
    lost = F.raise_error(F.concat(F.lit("not a keyed JSON object: "), F.substring(F.col(value), 1, 200)))
    # a value that doesn't parse must not vanish: an indented file is read with pretty_printed
    checked = F.coalesce(parsed, F.when(F.trim(F.col(value)) != "", lost.cast(KEYED_ENTRY)))
    entries = objects.select(F.explode(checked).alias("key", "entry"))
    return entries.select(
        F.col("key").cast("bigint").alias("item_id"),
        F.col("entry.data.text").alias("text"),
        int_or_text(F.col("entry.label")).alias("label"),
        F.col("entry.weak_labels").alias("weak_labels"),
    )


def read_keyed_json(spark: SparkSession, path: str, pretty_printed: bool = False) -> DataFrame:
    """Read one keyed JSON file, or a folder of them.

    Each line holds one object, so a file of many lines (see ``write_keyed_json``) is
    split over tasks. A pretty-printed file has to be read whole, by one task per file.
    A missing path raises, as the file scan does.
    """
    return parse_keyed_json(spark.read.text(path, wholetext=pretty_printed))


# --- tolerant JSON lines -------------------------------------------------------------


def parse_tolerant_jsonl(
    lines: DataFrame, text_field: str, flag_field: str, value: str = "value"
) -> DataFrame:
    """Text and whole-number flag of each usable line; other lines are skipped.

    A blank or malformed line is skipped. A missing flag counts as 0, while a null or
    non-numeric one makes the row unusable. JSON ``true``/``false`` count as 1/0 and a
    JSON number is cut to its whole part, but a *string* must spell a whole number.
    """
    # VARIANT keeps the JSON type of the flag, which a plain string map would lose.
    parsed = compute_once(lines, item=F.try_parse_json(F.trim(F.col(value))))
    objects = parsed.filter(F.schema_of_variant("item").startswith("OBJECT"))
    kind = F.schema_of_variant(F.variant_get("item", _field(flag_field), "variant"))
    as_text = F.try_variant_get("item", _field(flag_field), "string")
    flag = (
        F.when(kind.isNull(), F.lit(0))
        .when(kind == "BOOLEAN", F.try_variant_get("item", _field(flag_field), "boolean").cast("int"))
        .when(kind == "STRING", F.trim(as_text).try_cast("int"))
        .otherwise(F.try_variant_get("item", _field(flag_field), "double").try_cast("bigint").try_cast("int"))
    )
    return objects.select(
        F.try_variant_get("item", _field(text_field), "string").alias("text"), flag.alias("label")
    ).filter(F.col("label").isNotNull())


def _field(name: str) -> str:
    return "$['" + name + "']"


def read_tolerant_jsonl(spark: SparkSession, path: str, text_field: str, flag_field: str) -> DataFrame:
    return parse_tolerant_jsonl(spark.read.text(path), text_field, flag_field)


# --- criteria ------------------------------------------------------------------------


def parse_criteria(lines: DataFrame, order: Column, value: str = "value") -> DataFrame:
    """Criteria in file order (``ord``); blank lines are skipped, a malformed one raises."""
    usable = lines.filter(F.trim(F.col(value)) != "")
    parsed = F.from_json(F.col(value), f"{CRITERION}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    lines_of = compute_once(usable.select(order.cast("bigint").alias("ord"), value), "ord", value, c=parsed)
    lost = F.raise_error(F.concat(F.lit("malformed criteria line: "), F.col(value)))
    name = F.when(F.col("c").isNull() | F.col("c._bad").isNotNull(), lost.cast("string")).otherwise(F.col("c.criterion"))
    return lines_of.select("ord", name.alias("criterion"), "c.description", F.col("c.class").alias("class"))


def read_criteria(spark: SparkSession, path: str) -> DataFrame:
    """Criteria JSON lines of a file, or of a folder of part files, in file order.

    A line takes at least one byte, so the byte a split starts at plus the row number
    inside the task never falls back behind an earlier line of the same file: positions
    come out in order without numbering the rows of the whole file in one place.
    """
    lines = spark.read.text(path)
    names = sorted(f.rsplit("/", 1)[-1] for f in lines.inputFiles())
    file_no = F.array_position(constant(names, "array<string>"), F.col("_metadata.file_name"))
    row_in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    position = F.shiftleft(file_no, 44) + F.col("_metadata.file_block_start") + row_in_task
    return parse_criteria(lines.select("value", position.alias("position")), F.col("position"))


# --- verdicts ------------------------------------------------------------------------


def parse_verdicts(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row per item with its verdict map: item_id, text, labels."""
    return lines.select(F.from_json(F.col(value), VERDICT).alias("v")).select(
        F.col("v.index").alias("item_id"), "v.text", "v.labels"
    )


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    return parse_verdicts(spark.read.text(path))


def flatten_verdicts(verdicts: DataFrame) -> DataFrame:
    """Long form (item_id, criterion, hit); no criterion name can clash with a column."""
    return verdicts.select("item_id", F.explode("labels").alias("criterion", "hit"))


# --- samples of a foreign table ------------------------------------------------------

# The column names looked for, in this order.
TEXT_COLUMNS = ("text", "sentence", "utterance")
LABEL_COLUMNS = ("label", "labels", "intent")


def resolve_columns(df: DataFrame) -> tuple[str, str]:
    """The text column (else the first) and the label column (else the last) of a table."""
    text = next((c for c in TEXT_COLUMNS if c in df.columns), df.columns[0])
    label = next((c for c in LABEL_COLUMNS if c in df.columns), df.columns[-1])
    return text, label


def load_samples(
    df: DataFrame,
    order_by: str,
    n: int | None = None,
    label_names: DataFrame | None = None,
    create_empty: bool = False,
) -> DataFrame:
    """(item_id, text, label) of the first ``n`` rows, or of all rows.

    ``label_names(class_idx, class_name)`` translates integer labels to their names.
    """
    text, label = resolve_columns(df.drop(order_by))
    picked = df.select(
        F.col(order_by).cast("bigint").alias("item_id"), F.col(text).alias("text"), F.col(label).alias("label")
    )
    if create_empty:
        picked = picked.limit(0)
    elif n is not None:
        picked = picked.orderBy("item_id").limit(n)
    if label_names is None:
        return picked.withColumn("label", F.col("label").cast("string"))
    named = picked.join(label_names, F.col("label").cast("int") == F.col("class_idx"), "left")
    return named.select("item_id", "text", F.col("class_name").alias("label"))


# --- domain description --------------------------------------------------------------


def parse_domain_info(objects: DataFrame, value: str = "value") -> DataFrame:
    """The project description, null when it is the empty string."""
    info = F.from_json(F.col(value), "domain_info string")["domain_info"]
    return objects.select(F.nullif(info, F.lit("")).alias("domain_info"))


def read_domain_info(spark: SparkSession, path: str) -> str | None:
    row = parse_domain_info(spark.read.text(path, wholetext=True)).first()
    return row.domain_info if row else None

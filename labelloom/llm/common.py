"""Helpers of the operators: word expressions, tables in the shared folder, ranks without a hot task."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.session import _delete, scratch_path, shuffles_freed

# The white space of the contracts (code points 0x20 and 0x09 to 0x0D), and the letters A-Z.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_paths: dict[int, str] = {}


def stored(df: DataFrame, stem: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder, and read back.

    This cuts the lineage with files that outlive executors, and gives later plans exact sizes.
    """
    path = scratch_path(df.sparkSession, f"llm-{stem}")
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    out._stored_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df._stored_at)


@contextmanager
def batch_bytes(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs started here hand rows to Python in Arrow batches of about ``size`` bytes, however long the texts.

    Spark's own limit (64 MB, or 10,000 rows) is held by the JVM and by Python, in each task.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def with_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with new columns last; a column of ``df`` that has such a name in any case is replaced."""
    taken = {c.lower() for c in columns}
    kept = [quoted(c) for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[c.alias(n) for n, c in columns.items()])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def word_array(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null."""
    blank = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(blank, " "), "")


def ranked(df: DataFrame, group: list[str], order: str, n_rows: int, name: str, per_bucket: int = 50_000) -> DataFrame:
    """Add ``name``: a gapless number from 0 within each group, by the evenly spread long ``order``.

    Rows are counted per range of ``order`` first, so a group of any size is ranked by many
    tasks, each over about ``per_bucket`` rows. ``df`` must be stored: it is read twice.
    """
    bits = max(0, (max(n_rows, 1) // per_bucket).bit_length())
    bucket = F.shiftright(F.col(order), 64 - bits) if bits else F.lit(0).cast("long")
    cut = df.withColumn("_bucket", bucket)
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut.groupBy(*group, "_bucket").count().withColumn(
        "_before", F.coalesce(F.sum("count").over(before), F.lit(0))
    )
    inner = F.row_number().over(W.partitionBy(*group, "_bucket").orderBy(order, "doc_id"))
    numbered = cut.withColumn("_inner", inner)
    return (
        numbered.join(offsets.drop("count"), [*group, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_inner") - 1)
        .drop("_bucket", "_before", "_inner")
    )

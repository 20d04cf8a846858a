"""Labelling a growing folder of texts, resumable and without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from labelloom.operators.labeling import LabelingSet, keyword_ballots, verdicts


def text_stream(
    spark: SparkSession, folder: str, schema: StructType | str, file_pattern: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def label_stream(items: DataFrame, lfs: LabelingSet, keep: tuple[str, ...] = ()) -> DataFrame:
    """Verdicts (item_id, kept columns, labels) of a stream; stateless, so there is no state to grow."""
    return verdicts(keyword_ballots(items, lfs, keep), lfs, keep)


def append_stream(labelled: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet folder until everything present is labelled, then stop.

    The checkpoint remembers what was read and the sink's log what was committed. A
    restart with the same two folders goes on where the last run ended.
    """
    return (
        labelled.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def remaining(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items without a stored verdict, matched by id rather than by counting lines."""
    return items.join(done.select("item_id"), "item_id", "left_anti")



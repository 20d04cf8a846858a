"""Writers for the file formats of a labelling project; all of them write in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_json_lines(items: DataFrame, entries_per_line: int = 1000) -> DataFrame:
    """Keyed JSON objects, each with the items of one contiguous range of ids.

    Ids are unique, so a range of ``entries_per_line`` ids bounds the size of a line and
    of the group it is collected from, whatever the label distribution.
    """
    entry = F.struct(
        "label",
        F.struct("text").alias("data"),
        *(["weak_labels"] if "weak_labels" in items.columns else []),
    )
    pair = F.struct(F.col("item_id").cast("string").alias("key"), entry.alias("value"))
    block = F.expr(f"item_id div {int(entries_per_line)}").alias("_block")
    return (
        items.groupBy(block)
        .agg(F.sort_array(F.collect_list(F.struct("item_id", pair.alias("pair")))).alias("rows"))
        .select(F.to_json(F.map_from_entries(F.col("rows.pair"))).alias("value"))
    )


def write_keyed_json(items: DataFrame, path: str, entries_per_line: int = 1000) -> None:
    keyed_json_lines(items, entries_per_line).write.mode("overwrite").text(path)


def write_splits(splits: DataFrame, path: str) -> None:
    """The split table in its analytic form: Parquet, one folder per split."""
    splits.write.mode("overwrite").partitionBy("split").parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; null fields are written so that every line has every key."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes inside quoted fields are doubled, line breaks survive."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def verdict_records(verdicts: DataFrame) -> DataFrame:
    """The verdict file layout: index, text, labels."""
    return verdicts.select(F.col("item_id").alias("index"), "text", "labels")


def append_verdicts(verdicts: DataFrame, path: str) -> None:
    write_jsonl(verdict_records(verdicts), path, mode="append")


def dense_row(votes: Column, n_lfs: int) -> Column:
    """All votes of an item in labeling-function order, -1 where a function abstains."""
    fired = F.map_from_entries(votes)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_lfs - 1)), lambda lf: F.coalesce(F.try_element_at(fired, lf), F.lit(-1))
    )


def vote_matrix_lines(ballots: DataFrame, names: list[str]) -> DataFrame:
    """One JSON object per item, keyed by labeling function.

    The keys sit inside a map, so the plan does not grow a column per function.
    """
    keyed = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), dense_row(F.col("votes"), len(names)))
    return ballots.select(F.to_json(keyed).alias("value"))


def write_vote_matrix(ballots: DataFrame, names: list[str], path: str) -> None:
    vote_matrix_lines(ballots, names).write.mode("overwrite").text(path)

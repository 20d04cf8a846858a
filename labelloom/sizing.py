"""Size checks that stand in front of everything sent to every task.

Nothing here uses a broadcast hint. A side that was measured to be small becomes a
local relation: Catalyst then knows its exact size and broadcasts it by itself. A side
that is not small stays a distributed frame and is joined with a shuffle.
"""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SMALL_ROWS = 50_000


def rows_within(df: DataFrame, max_rows: int = SMALL_ROWS) -> list[Row] | None:
    """All rows if there are at most ``max_rows`` of them, else None."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def pin_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """A local relation of ``df`` when it is small, otherwise ``df`` itself."""
    rows = rows_within(df, max_rows)
    if rows is None:
        return df
    return local_frame(df.sparkSession, rows, df.schema)


def local_frame(spark: SparkSession, rows: list, schema: StructType | str) -> DataFrame:
    """Rows of the driver as a local relation, whose exact size the optimizer knows.

    ``createDataFrame`` on Python rows makes an RDD scan of unknown size instead, and
    the *other* side of a join with it would be the one to be broadcast or shuffled.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    records = [dict(zip(schema.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=to_arrow_schema(schema)), schema)


def compute_once(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """Select ``keep`` and computed columns such that each is evaluated once per row.

    Later expressions that use a column several times, or inside a lambda, would
    otherwise have its whole definition copied into them. A generator keeps them apart.
    """
    named = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.inline(F.array(named)))


def constant(value: Any, ddl: str) -> Column:
    """A nested Python value as one literal (folded once, at planning time)."""
    return F.from_json(F.lit(json.dumps(value)), ddl)

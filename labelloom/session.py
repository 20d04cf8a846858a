"""Where the engine may write: the shared checkpoint folder of the session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` (shared by all executors).

    Only a local session may fall back to a folder of this machine; on a cluster an
    unset folder is an error, because a path of one machine is lost with that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    already_set = spark.sparkContext.getCheckpointDir()
    if already_set:
        return already_set.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    own = tempfile.mkdtemp(prefix="labelloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder, for use in several passes.

    Reading texts again for each pass would cost far more than writing their votes.
    The files outlive executors; Spark removes them with the frame when
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint()


def scratch_path(spark: SparkSession, stem: str) -> str:
    return f"{checkpoint_root(spark)}/labelloom/{stem}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def numbered_folders(spark: SparkSession, path: str) -> list[int]:
    """Names of the folders in ``path`` that are numbers; none if there is no such path."""
    if not path_exists(spark, path):
        return []
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(hadoop_path)]
    return [int(n) for n in names if n.isdigit()]


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that end here leave no shuffle files, which else stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, stem: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, until ``release`` removes it.

    This cuts the lineage with files that outlive any executor, and gives later plans exact sizes.
    """
    path = scratch_path(df.sparkSession, stem)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in frames:
        delete_path(df.sparkSession, df._stored_at)


_delete = delete_path


@contextmanager
def scratch_table(df: DataFrame, stem: str) -> Iterator[DataFrame]:
    """Write ``df`` once to the shared folder and read it back for the ``with`` block.

    This cuts the lineage with files that outlive any executor. The table is removed
    at the end, so only results that no longer need it may leave the block.
    """
    spark = df.sparkSession
    path = scratch_path(spark, stem)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        delete_path(spark, path)

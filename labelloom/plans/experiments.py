"""Experiment numbers, and stages that are computed once and then reused."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.session import path_exists
from labelloom.sizing import local_frame


def next_experiment_number(names: DataFrame, name: str = "name") -> DataFrame:
    """One more than the largest N among names of the form exp_N; 1 if there is none."""
    number = F.regexp_extract(name, r"^exp_(\d+)$", 1).try_cast("bigint")
    return names.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_experiment"))


def _folder_names(spark: SparkSession, path: str) -> list[tuple[str]]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    return [(s.getPath().getName(),) for s in fs.listStatus(folder)]


@dataclass(frozen=True)
class Experiment:
    """A folder per experiment: ``root/dataset/exp_N/iter_i/stage``."""

    spark: SparkSession
    path: str

    @staticmethod
    def begin(spark: SparkSession, root: str, dataset: str, config=None) -> Experiment:
        """A new experiment with the next free number; writes its configuration."""
        base = f"{root.rstrip('/')}/{dataset}"
        names = local_frame(spark, _folder_names(spark, base), "name string")
        number = next_experiment_number(names).first().next_experiment
        experiment = Experiment(spark, f"{base}/exp_{number}")
        settings = asdict(config) if is_dataclass(config) else dict(config or {})
        text = {k: None if v is None else str(v) for k, v in {"dataset": dataset, **settings}.items()}
        row = local_frame(spark, [tuple(text.values())], ", ".join(f"`{k}` string" for k in text))
        row.write.json(f"{experiment.path}/config")
        return experiment

    @staticmethod
    def resume(spark: SparkSession, root: str, dataset: str, number: int) -> Experiment:
        return Experiment(spark, f"{root.rstrip('/')}/{dataset}/exp_{number}")

    def stage_path(self, iteration: int, stage: str) -> str:
        return f"{self.path}/iter_{iteration}/{stage}"

    def stage(self, iteration: int, stage: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stored stage, or ``make()`` written and read back.

        Only a completely written table counts as stored, so an interrupted run repeats
        its last stage and nothing else. Later stages start from files, not lineage.
        """
        path = self.stage_path(iteration, stage)
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def export(self, iteration: int, name: str, write: Callable[[str], None]) -> None:
        """Write a file output once; ``write`` gets the folder."""
        path = self.stage_path(iteration, f"export/{name}")
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            write(path)

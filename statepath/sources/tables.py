"""Reading steps, end states and models; writing models."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Model(NamedTuple):
    """The tables of a learned decision process."""

    steps: DataFrame
    transitions: DataFrame
    rewards: DataFrame


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A dataset by catalogue name, or a parquet dataset by path."""
    if "/" in name:
        return spark.read.parquet(name)
    return spark.read.table(name)


def _require(df: DataFrame, columns: tuple[str, ...], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df


def scan_steps(spark: SparkSession, name: str) -> DataFrame:
    """One row per (ID, TIME) with features, ACTION and RISK."""
    return _require(read_table(spark, name), ("ID", "TIME", "ACTION", "RISK"), "steps table")


def scan_end_states(spark: SparkSession, name: str) -> DataFrame:
    """One row per ID with its end state and Reward."""
    df = _require(read_table(spark, name), ("ID", "end_state", "Reward"), "end-state table")
    return df.select(F.col("ID").cast("string").alias("ID"), "end_state", "Reward")


def write_model(model: Model, path: str) -> None:
    for name, table in model._asdict().items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str) -> Model:
    return Model(*[spark.read.parquet(f"{path}/{name}") for name in Model._fields])

"""Adapter from the star-schema test tables to steps and end states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statepath.operators.ordering import number_rows

ACTION_CODES = {"error": 0, "view": 1, "click": 2, "purchase": 3, "signup": 4}
PRIORITY_CODES = {
    "1-URGENT": 0,
    "2-HIGH": 1,
    "3-MEDIUM": 2,
    "4-NOT SPECIFIED": 3,
    "5-LOW": 4,
}
SEGMENT_REWARDS = {
    "AUTOMOBILE": 0,
    "BUILDING": 5,
    "FURNITURE": 10,
    "HOUSEHOLD": 20,
    "MACHINERY": 100,
}


def _coded(column: str, codes: dict[str, int]):
    value = F.lit(None).cast("int")
    for name, code in codes.items():
        value = F.when(F.col(column) == name, F.lit(code)).otherwise(value)
    return value


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps: one subject per user, one step per event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.where(F.col("user_id").isNotNull()).select(
        "user_id",
        "ts",
        "event_id",
        F.date_trunc("hour", "ts").alias("hour"),
        F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("int").alias("k"),
        "value",
        _coded("event_type", ACTION_CODES).alias("ACTION"),
    )
    numbered = number_rows(rows, key="user_id", slice_by="hour", order_by=["ts", "event_id"])
    return numbered.select(
        F.col("user_id").cast("string").alias("ID"),
        F.col("position").cast("int").alias("TIME"),
        "k",
        "value",
        F.floor(F.col("k") / 25).cast("int").alias("total_sofa"),
        "ACTION",
        F.least(F.floor(F.col("value") / 20), F.lit(15)).cast("int").alias("RISK"),
    )


def event_end_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market segment of every user with events, as its end state."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    return _segments(spark, sf_dir, users, "user_id")


def _segments(spark: SparkSession, sf_dir: str, subjects: DataFrame, key: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    return customers.join(subjects, F.col("c_custkey") == F.col(key), "left_semi").select(
        F.col("c_custkey").cast("string").alias("ID"),
        F.col("c_mktsegment").alias("end_state"),
        _coded("c_mktsegment", SEGMENT_REWARDS).alias("Reward"),
    )


def order_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as steps: one subject per customer, one step per order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.where(F.col("o_custkey").isNotNull()).select(
        "o_custkey",
        "o_orderdate",
        "o_orderkey",
        F.date_trunc("month", "o_orderdate").alias("month"),
        "o_totalprice",
        _coded("o_orderpriority", PRIORITY_CODES).alias("ACTION"),
    )
    numbered = number_rows(
        rows, key="o_custkey", slice_by="month", order_by=["o_orderdate", "o_orderkey"]
    )
    return numbered.select(
        F.col("o_custkey").cast("string").alias("ID"),
        F.col("position").cast("int").alias("TIME"),
        F.col("o_totalprice").alias("value"),
        "ACTION",
        F.least(F.floor(F.col("o_totalprice") / 100000), F.lit(15)).cast("int").alias("RISK"),
    )


def order_end_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market segment of every customer with orders, as its end state."""
    buyers = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey").distinct()
    return _segments(spark, sf_dir, buyers, "o_custkey")

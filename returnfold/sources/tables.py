"""Series derived from the order and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import growth, running


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _move(price: str, level: float):
    return (F.avg(price) / level - 1) * 0.05


def returns_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, dt, r): a daily series for each order priority."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("dt")).agg(_move("o_totalprice", 250000.0).alias("r"))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dt, b): the daily series of all orders."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("dt")).agg(_move("o_totalprice", 250000.0).alias("b"))


def prices_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns_by_priority(spark, sf_dir).select("series_id", "dt", (100 * growth().over(running())).alias("p"))


def returns_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, dt, r): an hourly series for each event type."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("dt")).agg(_move("value", 50.0).alias("r"))

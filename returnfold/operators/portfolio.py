"""Balances and weighted indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import growth, ordered, running, whole


def make_portfolio(returns: DataFrame, balance: float = 100000.0, mode: str = "comp", digits: int | None = None) -> DataFrame:
    """(series_id, dt, balance), starting with a row of the first balance on the day before the series.

    mode: comp reinvests; sum adds each return on the first balance; fixed adds each return on the first
    balance as the return before has left it.
    """
    r = F.coalesce("r", F.lit(0.0))
    before = balance * (1 + F.coalesce(F.lag(r).over(ordered()), F.lit(0.0)))
    rows = returns.withColumn("_gain", before * r)
    made = {"comp": balance * growth(r).over(running()), "sum": balance * (1 + F.sum(r).over(running())), "fixed": balance + F.sum("_gain").over(running())}[mode]
    seed = returns.groupBy("series_id").agg(F.date_sub(F.min("dt"), 1).alias("dt")).withColumn("balance", F.lit(balance))
    out = seed.unionByName(rows.select("series_id", "dt", made.alias("balance")))
    return out if digits is None else out.withColumn("balance", F.round("balance", digits))


def make_index(returns: DataFrame, weights: DataFrame, match_dates: bool = False) -> DataFrame:
    """(dt, r): weighted sum of the constituents' returns on dates that all of them have.

    weights (ticker, weight) stay the same every day. match_dates starts at the latest of the
    constituents' first returns other than 0.
    """
    rows = returns.join(weights.select(F.col("ticker").alias("series_id"), "weight"), "series_id").where("r is not null")
    if match_dates:
        starts = rows.groupBy("series_id").agg(F.min(F.when(F.col("r") != 0, F.col("dt"))).alias("s")).agg(F.max("s").alias("start"))
        rows = rows.join(F.broadcast(starts)).where("dt >= start")  # one row
    k = weights.agg(F.countDistinct("ticker").alias("k"))
    out = rows.groupBy("dt").agg(F.sum(F.col("weight") * F.col("r")).alias("r"), F.countDistinct("series_id").alias("n"))
    return out.join(F.broadcast(k)).where("n = k").select("dt", "r")  # one row


def match_volatility(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Returns scaled to the benchmark's deviation."""
    b = benchmark.agg(F.stddev_samp("b").alias("_b"))
    return returns.withColumn("_r", F.stddev_samp("r").over(whole())).join(F.broadcast(b)).withColumn("r", F.try_divide(F.col("r"), F.col("_r")) * F.col("_b")).drop("_r", "_b")  # one row

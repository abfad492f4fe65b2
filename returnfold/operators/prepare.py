"""Prices and returns: cleaning, conversion and shifting."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import daily_rate, finite, ordered, running, whole
from .scan import running_growth

#: Blocks of an exponentially weighted sum that still count.
REACH = 3


def clean(df: DataFrame, value: str = "r") -> DataFrame:
    """NaN, infinities and nulls become 0."""
    return df.withColumn(value, F.coalesce(finite(F.col(value).cast("double")), F.lit(0.0)))


def looks_like_prices(value: str = "v", strict: bool = True):
    """Whether a series' values are prices: none below 0 (or not above it, if not strict) and one above 1."""
    low, high = F.min(finite(value)).over(whole()), F.max(finite(value)).over(whole())
    return ((low >= 0) if strict else (low > 0)) & (high > 1)


def to_returns(prices: DataFrame) -> DataFrame:
    """(series_id, dt, r) of (series_id, dt, p): change to the row before, 0 for the first."""
    p = finite("p")
    return prices.select("series_id", "dt", F.coalesce(finite(F.try_divide(p, F.lag(p).over(ordered())) - 1), F.lit(0.0)).alias("r"))


def to_prices(returns: DataFrame, base: float = 100000.0) -> DataFrame:
    """(series_id, dt, p): base times the running product of 1 + r."""
    return running_growth(clean(returns)).select("series_id", "dt", (base * F.col("g")).alias("p"))


def prepare(df: DataFrame, kind: str = "returns", rf: float = 0.0, periods: float | None = None, value: str = "r") -> DataFrame:
    """(series_id, dt, r), clean, less the risk-free rate.

    kind: returns; price; or infer, which looks at each series' least and largest value.
    """
    df = df.select("series_id", "dt", F.col(value).cast("double").alias("v"))
    change = F.try_divide(finite("v"), F.lag(finite("v")).over(ordered())) - 1
    r = {"returns": F.col("v"), "price": change, "infer": F.when(looks_like_prices(), change).otherwise(F.col("v"))}[kind]
    out = df.select("series_id", "dt", F.coalesce(finite(r), F.lit(0.0)).alias("r"))
    return to_excess(out, rf, periods) if rf else out


def prepare_prices(df: DataFrame, kind: str = "price", base: float = 1.0, value: str = "p") -> DataFrame:
    """(series_id, dt, p) from prices, from returns, or from what is found (infer: below 0, or none above 1, is returns)."""
    df = df.select("series_id", "dt", F.coalesce(finite(F.col(value).cast("double")), F.lit(0.0)).alias("v"))
    if kind == "price":
        return df.select("series_id", "dt", F.col("v").alias("p"))
    returns = (F.min("v").over(whole()) < 0) | (F.max("v").over(whole()) < 1)
    made = running_growth(df, c="v").withColumn("made", base * F.col("g"))
    return made.select("series_id", "dt", {"returns": F.col("made"), "infer": F.when(returns, F.col("made")).otherwise(F.col("v"))}[kind].alias("p"))


def to_log_returns(returns: DataFrame) -> DataFrame:
    """r becomes ln(1 + r), null at or below -1."""
    return returns.withColumn("r", F.when(F.col("r") > -1, F.log1p("r")))


log_returns = to_log_returns


def to_excess(returns: DataFrame, rf: float | DataFrame, periods: float | None = None) -> DataFrame:
    """r less the risk-free rate: a yearly rate brought to periods, or rows (dt, rf); dates without a rate give null."""
    if isinstance(rf, DataFrame):
        return returns.join(rf.select("dt", "rf"), "dt", "left").withColumn("r", F.col("r") - F.col("rf")).select("series_id", "dt", "r")
    return returns.withColumn("r", F.col("r") - daily_rate(rf, periods))


def rebase(prices: DataFrame, base: float = 100.0) -> DataFrame:
    """Each series starts at base; rows without a price go."""
    return prices.where(finite("p").isNotNull()).withColumn("p", F.col("p") / F.first("p").over(running()) * base)


def multi_shift(prices: DataFrame, shift: int = 3) -> DataFrame:
    """p with its lags p1 to p(shift - 1)."""
    return prices.select("series_id", "dt", "p", *(F.lag("p", i).over(ordered()).alias(f"p{i}") for i in range(1, shift)))


def exponential_stdev(returns: DataFrame, window: int = 30, halflife: bool = False) -> DataFrame:
    """Exponentially weighted sample deviation, null in the first window - 1 rows; rows without a return have the last one's.

    Weights fall by keep a row. Sums over a series are made block by block: within a block, a running sum
    of values over keep ** place, times keep ** place; to which come the totals of the last blocks, each
    weighted by its distance. Those further back than REACH blocks weigh less than 1e-20.
    """
    keep = 0.5 ** (1 / window) if halflife else 1 - 2 / (window + 1)
    size = max(2, int(-16 / math.log(keep)))  # keep ** -size is at most some 1e7
    n = F.count("r").over(running())  # of this row, from 1
    rows = returns.select("series_id", "dt", (F.col("r") - F.first("r", True).over(running())).alias("x"), n.alias("n"))
    rows = rows.withColumns({"block": F.floor((F.col("n") - 1) / size), "at": (F.col("n") - 1) % size})
    up = F.pow(F.lit(keep), -F.col("at"))
    sums = {"s1": F.sum(F.col("x") * up), "s2": F.sum(F.col("x") * F.col("x") * up)}
    totals = rows.groupBy("series_id", "block").agg(*((v * keep ** (size - 1)).alias(k) for k, v in sums.items()))
    before = ordered(by="block")
    lagged = lambda c: sum((F.coalesce(F.lag(c, k + 1).over(before), F.lit(0.0)) * keep ** (size * k) for k in range(REACH)), F.lit(0.0))
    carried = totals.select("series_id", "block", lagged("s1").alias("c1"), lagged("s2").alias("c2"))
    inside = running("series_id", "block")
    down = F.pow(F.lit(keep), F.col("at"))
    local = rows.select("series_id", "dt", "n", "block", "at", *((v.over(inside) * down).alias(k) for k, v in sums.items())).join(carried, ["series_id", "block"])
    whole_ = lambda s, c: F.col(s) + F.col(c) * down * keep
    w, w2 = ((1 - F.pow(F.lit(k), F.col("n"))) / (1 - k) for k in (keep, keep**2))
    mean = F.try_divide(whole_("s1", "c1"), w)
    var = F.greatest(F.try_divide(whole_("s2", "c2"), w) - mean * mean, F.lit(0.0)) * F.try_divide(w * w, w * w - w2)
    return local.select("series_id", "dt", F.when(F.col("n") >= window, F.sqrt(var)).alias("ewm_std"))


def consecutive(df: DataFrame, flag: str) -> DataFrame:
    """df with streak: the value of flag (0 or 1) times its row's place in the run of equal values."""
    change = F.coalesce((F.col(flag) != F.lag(flag).over(ordered())).cast("int"), F.lit(1))
    runs = df.withColumn("_run", F.sum(change).over(running()))
    return runs.withColumn("streak", F.col(flag) * F.row_number().over(ordered("series_id", "_run"))).drop("_run")

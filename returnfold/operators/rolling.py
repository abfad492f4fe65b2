"""Measures over a trailing number of rows; null until the window is full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .scan import running_growth
from .sliding import sliding, sliding_rank


def full(c: str, n: int, value: Column) -> Column:
    """value where the window holds n rows with c."""
    return F.when(F.col(f"n_{c}") == n, value)


def deviation(c: str) -> Column:
    """Sample deviation of the window's c; null below two rows."""
    return F.when(F.col(f"n_{c}") > 1, F.sqrt(F.col(f"m2_{c}") / (F.col(f"n_{c}") - 1)))


def compsum(returns: DataFrame) -> DataFrame:
    """(series_id, dt, compsum): running compounded return."""
    return running_growth(returns).select("series_id", "dt", (F.col("g") - 1).alias("compsum"))


def rolling_measures(returns: DataFrame, names: list[str], window: int = 126, periods: float = 252, annualize: bool = True) -> DataFrame:
    """returns with these of rolling_volatility, rolling_sharpe and rolling_sortino, all from the same moments."""
    below = {"below": F.when(F.col("r") < 0, F.col("r") * F.col("r"))} if "rolling_sortino" in names else {}
    moments = sliding(returns, window, {"r": F.col("r")}, sums=below)
    scale = periods**0.5 if annualize else 1.0
    made = {"rolling_volatility": deviation("r") * scale, "rolling_sharpe": ratio(F.col("mean_r"), deviation("r")) * scale}
    if below:
        made["rolling_sortino"] = ratio(F.col("mean_r"), F.sqrt(F.col("sum_below") / window)) * scale
    return moments.select(*returns.columns, *(full("r", window, made[k]).alias(k) for k in names))


def rolling_volatility(returns: DataFrame, window: int = 126, periods: float = 252) -> DataFrame:
    return rolling_measures(returns, ["rolling_volatility"], window, periods)


def rolling_sharpe(returns: DataFrame, window: int = 126, periods: float = 252, annualize: bool = True) -> DataFrame:
    return rolling_measures(returns, ["rolling_sharpe"], window, periods, annualize)


def rolling_sortino(returns: DataFrame, window: int = 126, periods: float = 252, annualize: bool = True) -> DataFrame:
    return rolling_measures(returns, ["rolling_sortino"], window, periods, annualize)


def implied_volatility(returns: DataFrame, periods: int = 252, annualize: bool = True) -> DataFrame:
    """Deviation of log returns: over the last `periods` rows and annualised, or of the whole series."""
    log = F.when(F.col("r") > -1, F.log1p("r"))
    if not annualize:
        return returns.groupBy("series_id").agg(F.stddev_samp(log).alias("implied_volatility"))
    return sliding(returns, periods, {"l": log}).select(*returns.columns, full("l", periods, deviation("l") * periods**0.5).alias("implied_volatility"))


def pct_rank(prices: DataFrame, window: int = 60) -> DataFrame:
    """(series_id, dt, pct_rank): percent rank of a price among the last `window`, ties in the middle; the first windows are short. Null prices have no rank and don't count."""
    return sliding_rank(prices, window, "p", "pct_rank")


def rolling_greeks(joined: DataFrame, window: int = 252) -> DataFrame:
    """(series_id, dt, beta, alpha) of (series_id, dt, r, b): rolling beta; alpha from it and the means of the whole series."""
    key = F.struct("series_id").alias("_s")  # null series are a series too
    rows = joined.select("series_id", "dt", *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in "rb"))
    means = rows.groupBy(key).agg(F.avg("r").alias("_r"), F.avg("b").alias("_b"))
    moments = sliding(rows, window, {"r": F.col("r"), "b": F.col("b")}, [("r", "b")])
    betas = moments.select(key, "dt", full("r", window, ratio(F.col("co_r_b"), F.col("m2_b"))).alias("beta"))
    return betas.join(means, "_s").select("_s.series_id", "dt", "beta", (F.col("_r") - F.col("beta") * F.col("_b")).alias("alpha"))

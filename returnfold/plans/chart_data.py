"""The numbers behind the charts, as long tables; drawing them is left to the caller."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import growth, running, whole
from ..operators.benchmark import on_common_dates
from ..operators.calendar import distribution_rows, filled_daily, monthly_returns, period_end, resample
from ..operators.drawdown import longest_drawdowns, to_drawdown_series
from ..operators.montecarlo import path_summary
from ..operators.portfolio import make_portfolio, match_volatility
from ..operators.rolling import rolling_greeks, rolling_measures


def cumulative(returns: DataFrame, compounded: bool = True, benchmark: DataFrame | None = None, same_volatility: bool = False, freq: str | None = None) -> DataFrame:
    """(series_id, dt, value): running return; of the series scaled to the benchmark's deviation, or of bins of time, if asked."""
    rows = match_volatility(returns, benchmark) if same_volatility else returns
    rows = rows if freq is None else resample(rows, freq, "comp" if compounded else "sum", empty=0.0)
    value = growth().over(running()) - 1 if compounded else F.sum("r").over(running())
    return rows.select("series_id", "dt", value.alias("value"))


def snapshot(returns: DataFrame) -> DataFrame:
    """(series_id, dt, cumulative, drawdown, daily), in percent."""
    rows = returns.withColumn("_g", growth().over(running()))
    dd = F.col("_g") / F.greatest(F.max("_g").over(running()), F.lit(1.0)) - 1
    return rows.select("series_id", "dt", ((F.col("_g") - 1) * 100).alias("cumulative"), (dd * 100).alias("drawdown"), (F.col("r") * 100).alias("daily"))


def earnings(returns: DataFrame, balance: float = 100000.0, mode: str = "comp") -> DataFrame:
    """(series_id, dt, balance, highest): highest marks the row of the highest balance."""
    rows = make_portfolio(returns, balance, mode)
    top = F.max_by("dt", F.struct("balance", "dt")).over(whole())
    return rows.withColumn("highest", F.col("dt") == top)


def daily_active(joined: DataFrame, active: bool = False) -> DataFrame:
    """(series_id, dt, value): running sum of returns, or of returns less the benchmark's."""
    x = F.col("r") - F.col("b") if active else F.col("r")
    return joined.select("series_id", "dt", F.sum(x).over(running()).alias("value"))


def period_bars(returns: DataFrame, freq: str = "YE", compounded: bool = True) -> DataFrame:
    """(series_id, dt, r, mean): return of each bin, and the mean of all bins."""
    bars = resample(returns, freq, "comp" if compounded else "sum", empty=0.0)
    return bars.withColumn("mean", F.avg("r").over(whole()))


def histogram(returns: DataFrame, freq: str = "ME", bins: int = 20, compounded: bool = True) -> DataFrame:
    """(series_id, bin, low, n) of the returns of all bins of time."""
    rows = resample(returns, freq, "comp" if compounded else "sum", empty=0.0)
    return _binned(rows, "r", bins)


def _binned(rows: DataFrame, c: str, bins: int) -> DataFrame:
    """Counts of bins of equal width; values that differ by rounding alone are one bin."""
    lo, hi = F.min(c).over(whole()), F.max(c).over(whole())
    apart = hi - lo > 1e-9 * F.greatest(F.abs(lo), F.abs(hi))
    wide = rows.withColumns({"_lo": lo, "_w": F.when(apart, (hi - lo) / bins).otherwise(0.0)})
    at = F.when(F.col("_w") == 0, 0).otherwise(F.least(F.floor((F.col(c) - F.col("_lo")) / F.when(F.col("_w") != 0, F.col("_w"))), F.lit(bins - 1))).cast("int")
    return wide.groupBy("series_id", at.alias("bin")).agg(F.first(F.col("_lo") + at * F.col("_w")).alias("low"), F.count("*").alias("n"))


def density(returns: DataFrame, freq: str = "ME", points: int = 64, compounded: bool = True) -> DataFrame:
    """(series_id, x, density): Gaussian kernel estimate of the returns of all bins of time, of Scott's width, at points from least to greatest.

    Series without spread are left out.
    """
    rows = resample(returns, freq, "comp" if compounded else "sum", empty=0.0)
    wide = rows.groupBy("series_id").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), (F.stddev_samp("r") * F.pow(F.count("r"), F.lit(-0.2))).alias("h"), F.count("r").alias("n")).where("h > 0")
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points - 1))).alias("x")
    u = (F.col("x") - F.col("r")) / F.col("h")
    return rows.join(wide, "series_id").select("series_id", "r", "h", "n", at).groupBy("series_id", "x").agg((F.sum(F.exp(-u * u / 2)) / F.first(F.col("n") * F.col("h") * F.lit((2 * math.pi) ** 0.5))).alias("density"))


def with_benchmark(returns: DataFrame, benchmark: DataFrame, name: str = "Benchmark") -> DataFrame:
    """returns and the benchmark (dt, b) as one more series, for charts that show both."""
    return returns.select("series_id", "dt", "r").unionByName(benchmark.select(F.lit(name).alias("series_id"), "dt", F.col("b").alias("r")))


def underwater(returns: DataFrame) -> DataFrame:
    """(series_id, dt, dd, mean)."""
    return to_drawdown_series(returns).withColumn("mean", F.avg("dd").over(whole()))


def drawdown_periods(returns: DataFrame, n: int = 5) -> DataFrame:
    return longest_drawdowns(to_drawdown_series(returns), n)


def rolling_beta(joined: DataFrame, windows: tuple[int, ...] = (126, 252)) -> DataFrame:
    """(series_id, dt, window, beta)."""
    out = None
    for n in windows:
        part = rolling_greeks(joined, n).select("series_id", "dt", F.lit(n).alias("window"), "beta")
        out = part if out is None else out.unionByName(part)
    return out


def rolling_lines(returns: DataFrame, window: int = 126, periods: float = 252) -> DataFrame:
    """(series_id, dt, rolling_volatility, rolling_sharpe, rolling_sortino), all from the same moments."""
    return rolling_measures(returns, ["rolling_volatility", "rolling_sharpe", "rolling_sortino"], window, periods).drop("r")


def monthly_heatmap(returns: DataFrame, compounded: bool = True) -> DataFrame:
    """Years by months, in percent."""
    table = monthly_returns(returns, eoy=False, compounded=compounded)
    return table.select("series_id", "year", *((F.col(c) * 100).alias(c) for c in table.columns[2:]))


def active_heatmap(returns: DataFrame, benchmark: DataFrame, compounded: bool = True) -> DataFrame:
    """Years by months: the series' return less the benchmark's, in percent, for years of the series."""
    mine = monthly_heatmap(returns, compounded)
    theirs = monthly_heatmap(benchmark.select(F.lit("b").alias("series_id"), "dt", F.col("b").alias("r")), compounded)
    names = mine.columns[2:]
    right = theirs.select("year", *(F.col(c).alias(f"_{c}") for c in names))
    return mine.join(right, "year", "left").select("series_id", "year", *((F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0.0))).alias(c) for c in names))


def box_data(returns: DataFrame, freq: str = "ME", compounded: bool = True) -> DataFrame:
    """Returns of the bins on a daily grid, each known until the next one."""
    return filled_daily(resample(returns, freq, "comp" if compounded else "sum", empty=0.0))


def montecarlo_lines(simulated: DataFrame, level: float = 0.95) -> DataFrame:
    """(series_id, step, lower, median, upper, original)."""
    q = F.percentile("v", F.array(*(F.lit(p) for p in ((1 - level) / 2, 0.5, (1 + level) / 2))))
    lines = simulated.groupBy("series_id", "step").agg(q.alias("q"), F.max(F.when(F.col("sim") == 0, F.col("v"))).alias("original"))
    return lines.select("series_id", "step", *(F.col("q")[k].alias(c) for k, c in enumerate(("lower", "median", "upper"))), "original")


def montecarlo_histogram(simulated: DataFrame, bins: int = 50, column: str = "terminal") -> DataFrame:
    """(series_id, bin, low, n) of the paths' last values, or of max_dd."""
    return _binned(path_summary(simulated), column, bins)


def charts(returns: DataFrame, benchmark: DataFrame | None = None, compounded: bool = True, window: int = 126, full: bool = True) -> dict[str, DataFrame]:
    """The tables of all charts of a report by name; not full: those of the short one."""
    out = {"snapshot": snapshot(returns), "heatmap": monthly_heatmap(returns, compounded)}
    if not full:
        return out
    both = returns if benchmark is None else with_benchmark(returns, benchmark)
    out |= {
        "returns": cumulative(both, compounded), "log_returns": cumulative(both, compounded), "earnings": earnings(returns), "yearly": period_bars(both, "YE", compounded), "histogram": histogram(both, compounded=compounded), "density": density(both, compounded=compounded),
        "daily": daily_active(returns), "rolling": rolling_lines(returns, window), "drawdowns": drawdown_periods(returns), "underwater": underwater(returns), "distribution": distribution_rows(returns, compounded),
    }
    if benchmark is not None:
        joined = on_common_dates(returns, benchmark)
        out |= {"same_volatility": cumulative(returns, compounded, benchmark, True), "rolling_beta": rolling_beta(joined), "active": daily_active(joined, True), "active_heatmap": active_heatmap(returns, benchmark, compounded)}
    return out

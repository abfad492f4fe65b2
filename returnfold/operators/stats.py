"""Statistics of whole series, as aggregate columns that one groupBy can hold together.

Columns read: r; prev, the return before; dd, the drawdown; var and dd_var, the parametric value at risk
of returns and of drawdowns. `enrich` adds them over one sort by (series_id, dt), and Spark leaves out
those that no wanted statistic reads. Undefined values are null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import correlation, daily_rate, excess_kurtosis, growth, normal_cdf, normal_quantile, ordered, ratio, running, skewness, whole
from .calendar import aggregate_returns


@dataclass(frozen=True)
class Settings:
    """rf is yearly; it is brought to a row's length for ratios of mean to deviation, and taken whole off totals."""

    rf: float = 0.0
    periods: float = 252.0
    compounded: bool = True
    annualize: bool = True
    sigma: float = 1.0
    confidence: float = 0.95
    quantile: float = 0.95
    required_return: float = 0.0
    corrected: bool = False  # probabilistic ratios: excess kurtosis as it is, and rf brought to a row's length


def enrich(returns: DataFrame, s: Settings = Settings()) -> DataFrame:
    """returns with prev, dd, var and dd_var."""
    z = s.sigma * normal_quantile(1 - s.confidence)
    grown = returns.withColumns({"prev": F.lag("r").over(ordered()), "_g": growth().over(running())})
    under = grown.withColumn("dd", F.col("_g") / F.greatest(F.max("_g").over(running()), F.lit(1.0)) - 1)
    risk = lambda c: F.avg(c).over(whole()) + z * F.stddev_samp(c).over(whole())
    return under.withColumns({"var": risk("r"), "dd_var": risk("dd")}).drop("_g")


def R() -> Column:
    return F.col("r")


def _n() -> Column:
    return F.count("r")


def _avg(condition: Column) -> Column:
    return F.avg(F.when(condition, R()))


def _sum(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, R())), F.lit(0.0))


def total(s: Settings) -> Column:
    return growth() - 1 if s.compounded else F.sum("r")


def win_rate(s: Settings) -> Column:
    return F.coalesce(ratio(F.count_if(R() > 0), F.count_if(R() != 0)), F.lit(0.0))


def payoff_ratio(s: Settings) -> Column:
    return ratio(_avg(R() > 0), F.abs(_avg(R() < 0)))


def profit_ratio(s: Settings) -> Column:
    wins, losses = ratio(_avg(R() >= 0), F.count_if(R() >= 0)), ratio(_avg(R() < 0), F.count_if(R() < 0))
    return F.when(F.count_if(R() >= 0) == 0, 0.0).otherwise(ratio(F.abs(wins), F.abs(losses)))


def profit_factor(s: Settings) -> Column:
    return ratio(_sum(R() >= 0), F.abs(_sum(R() < 0)))


def tail_ratio(s: Settings) -> Column:
    return F.abs(ratio(F.percentile("r", F.lit(s.quantile)), F.percentile("r", F.lit(1 - s.quantile))))


def exposure(s: Settings) -> Column:
    return F.ceil(100.0 * F.count_if(R() != 0) / _n()) / 100.0


def cagr(s: Settings) -> Column:
    return F.pow(F.abs(total(s) + 1), s.periods / _n()) - 1


def autocorr_penalty(s: Settings) -> Column:
    """sqrt(1 + 2 sum over x of (n - x) / n c^x), in closed form, c being the size of the lag-one correlation."""
    c, n = F.abs(correlation("r", "prev")), _n()
    inner = F.when(c == 1, (n - 1) / 2.0).otherwise(c * (n * (1 - c) - (1 - F.pow(c, n))) / (n * (1 - c) * (1 - c)))
    return F.sqrt(1 + 2 * inner)


def _scale(s: Settings) -> float:
    return s.periods**0.5 if s.annualize else 1.0


def _mean(s: Settings) -> Column:
    return F.avg("r") - daily_rate(s.rf, s.periods)


def sharpe(s: Settings) -> Column:
    return ratio(_mean(s), F.stddev_samp("r")) * _scale(s)


def _downside(s: Settings) -> Column:
    x = R() - daily_rate(s.rf, s.periods)
    return F.sqrt(F.sum(F.when(x < 0, x * x).otherwise(0.0)) / _n())


def sortino(s: Settings) -> Column:
    return ratio(_mean(s), _downside(s)) * _scale(s)


def adjusted_sortino(s: Settings) -> Column:
    return sortino(s) / 2**0.5


def probabilistic(base: Callable[[Settings], Column]) -> Callable[[Settings], Column]:
    def build(s: Settings) -> Column:
        b = base(Settings(periods=s.periods, annualize=False))
        kurt = excess_kurtosis("r") if s.corrected else excess_kurtosis("r") - 3
        spread = F.sqrt((1 + 0.5 * b * b - skewness("r") * b + kurt / 4 * b * b) / (_n() - 1))
        rate = daily_rate(s.rf, s.periods) if s.corrected else s.rf
        return normal_cdf(ratio(b - rate, spread))

    return build


def omega(s: Settings) -> Column:
    if s.required_return <= -1:
        return F.lit(None).cast("double")
    t = s.required_return if s.periods == 1 else (1 + s.required_return) ** (1 / s.periods) - 1
    gain, loss = F.sum(F.when(R() > t, R() - t).otherwise(0.0)), F.sum(F.when(R() < t, t - R()).otherwise(0.0))
    return F.when(_n() >= 2, ratio(gain, loss))


def max_drawdown(s: Settings) -> Column:
    return F.min("dd")


def ulcer_index(s: Settings) -> Column:
    return F.sqrt(ratio(F.sum(F.col("dd") * F.col("dd")), _n() - 1))


def value_at_risk(s: Settings) -> Column:
    return F.avg("r") + s.sigma * normal_quantile(1 - s.confidence) * F.stddev_samp("r")


def conditional_value_at_risk(s: Settings) -> Column:
    return F.coalesce(F.avg(F.when(R() < F.col("var"), R())), F.first("var"))


def serenity_index(s: Settings) -> Column:
    pitfall = ratio(-F.coalesce(F.avg(F.when(F.col("dd") < F.col("dd_var"), F.col("dd"))), F.first("dd_var")), F.stddev_samp("r"))
    return ratio(F.sum("r") - s.rf, ulcer_index(s) * pitfall)


def kelly_criterion(s: Settings) -> Column:
    w, p = win_rate(s), payoff_ratio(s)
    return ratio(p * w - (1 - w), p)


#: Statistic's name -> its aggregate.
STATS: dict[str, Callable[[Settings], Column]] = {
    "comp": lambda s: growth() - 1,
    "expected_return": lambda s: F.pow(growth(), F.lit(1.0) / _n()) - 1,
    "best": lambda s: F.max("r"),
    "worst": lambda s: F.min("r"),
    "exposure": exposure,
    "win_rate": win_rate,
    "avg_return": lambda s: _avg(R() != 0),
    "avg_win": lambda s: _avg(R() > 0),
    "avg_loss": lambda s: _avg(R() < 0),
    "payoff_ratio": payoff_ratio,
    "profit_ratio": profit_ratio,
    "profit_factor": profit_factor,
    "cpc_index": lambda s: profit_factor(s) * win_rate(s) * payoff_ratio(s),
    "common_sense_ratio": lambda s: profit_factor(s) * tail_ratio(s),
    "outlier_win_ratio": lambda s: ratio(F.percentile("r", F.lit(0.99)), _avg(R() >= 0)),
    "outlier_loss_ratio": lambda s: ratio(F.percentile("r", F.lit(0.01)), _avg(R() < 0)),
    "gain_to_pain_ratio": lambda s: ratio(F.sum("r"), F.abs(_sum(R() < 0))),
    "recovery_factor": lambda s: ratio(F.abs(F.sum("r") - s.rf), F.abs(max_drawdown(s))),
    "risk_of_ruin": lambda s: F.pow((1 - win_rate(s)) / (1 + win_rate(s)), _n()),
    "kelly_criterion": kelly_criterion,
    "cagr": cagr,
    "rar": lambda s: ratio(cagr(s), exposure(s)),
    "volatility": lambda s: F.stddev_samp("r") * _scale(s),
    "autocorr_penalty": autocorr_penalty,
    "sharpe": sharpe,
    "smart_sharpe": lambda s: ratio(sharpe(s), autocorr_penalty(s)),
    "sortino": sortino,
    "smart_sortino": lambda s: ratio(sortino(s), autocorr_penalty(s)),
    "adjusted_sortino": adjusted_sortino,
    "smart_adjusted_sortino": lambda s: ratio(adjusted_sortino(s), autocorr_penalty(s)),
    "probabilistic_sharpe_ratio": probabilistic(sharpe),
    "probabilistic_sortino_ratio": probabilistic(sortino),
    "probabilistic_adjusted_sortino_ratio": probabilistic(adjusted_sortino),
    "omega": omega,
    "skew": lambda s: skewness("r"),
    "kurtosis": lambda s: excess_kurtosis("r"),
    "max_drawdown": max_drawdown,
    "calmar": lambda s: ratio(cagr(s), F.abs(max_drawdown(s))),
    "ulcer_index": ulcer_index,
    "ulcer_performance_index": lambda s: ratio(growth() - 1 - s.rf, ulcer_index(s)),
    "serenity_index": serenity_index,
    "value_at_risk": value_at_risk,
    "conditional_value_at_risk": conditional_value_at_risk,
    "tail_ratio": tail_ratio,
    "risk_return_ratio": lambda s: ratio(F.avg("r"), F.stddev_samp("r")),
}

#: Other names of the same statistics.
ALIASES = {
    "geometric_mean": "expected_return", "ghpr": "expected_return", "win_loss_ratio": "payoff_ratio", "ror": "risk_of_ruin",
    "upi": "ulcer_performance_index", "var": "value_at_risk", "cvar": "conditional_value_at_risk", "expected_shortfall": "conditional_value_at_risk",
}


def compute(returns: DataFrame, *names: str, settings: Settings = Settings(), period: str | None = None) -> DataFrame:
    """(series_id, one column for each named statistic); of returns compounded by period, if one is given."""
    if period is not None:
        returns = aggregate_returns(returns, period, settings.compounded).withColumnRenamed("period", "dt")
    rows = enrich(returns, settings)
    return rows.groupBy("series_id").agg(*(STATS[ALIASES.get(n, n)](settings).alias(n) for n in names))


def longest_streak(returns: DataFrame, losses: bool = False, period: str | None = None) -> DataFrame:
    """(series_id, consecutive_wins or consecutive_losses): the longest run of returns above (below) 0."""
    rows = aggregate_returns(returns, period).withColumnRenamed("period", "dt")
    hit = (R() < 0) if losses else (R() > 0)
    change = F.coalesce((hit != F.lag(hit).over(ordered())).cast("int"), F.lit(1))
    runs = rows.withColumn("_run", F.sum(change).over(running())).groupBy("series_id", "_run").agg(F.count_if(hit).alias("n"))
    return runs.groupBy("series_id").agg(F.max("n").alias("consecutive_losses" if losses else "consecutive_wins"))

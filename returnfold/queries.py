"""The registered queries over the given tables, and the same in SQL."""

from __future__ import annotations

import datetime
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fluent
from .functions import columns as C
from .operators import benchmark as B
from .operators import calendar as K
from .operators import drawdown as D
from .operators import filters as X
from .operators import montecarlo as M
from .operators import portfolio as O
from .operators import prepare as P
from .operators import rolling as L
from .operators.stats import STATS, Settings, compute, longest_streak
from .plans import chart_data as H
from .plans import report as T
from .sources.series import beside, download_returns, from_wide, naive_utc, read_series, stack, to_wide, validate, write_series
from .sources.tables import market, prices_by_priority, returns_by_event, returns_by_priority, table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6

WITH = """WITH RECURSIVE ret AS (
  SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS dt, (avg(o_totalprice) / 250000.0 - 1) * 0.05 AS r FROM orders GROUP BY 1, 2
), mkt AS (
  SELECT CAST(o_orderdate AS DATE) AS dt, (avg(o_totalprice) / 250000.0 - 1) * 0.05 AS b FROM orders GROUP BY 1
), both_ AS (
  SELECT series_id, dt, r, b FROM ret JOIN mkt USING (dt)
), grown AS (
  SELECT *, product(1 + r) OVER (PARTITION BY series_id ORDER BY dt ROWS UNBOUNDED PRECEDING) AS g,
    lag(r) OVER (PARTITION BY series_id ORDER BY dt) AS prev FROM ret
), under AS (
  SELECT *, g / greatest(1.0, max(g) OVER (PARTITION BY series_id ORDER BY dt ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM grown
), e AS (
  SELECT *, avg(r) OVER s + -1.6448536269514722 * stddev_samp(r) OVER s AS var_, avg(dd) OVER s + -1.6448536269514722 * stddev_samp(dd) OVER s AS dd_var
  FROM under WINDOW s AS (PARTITION BY series_id)
)"""


def shift(digits: int) -> float:
    """Moves values that end in exactly half a last place, of which decimal prices give many, off the half."""
    return 1.7 / 10 ** (digits + 4)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to so many places, minus zero to zero; whole numbers to bigint."""
    out = {c: F.round(F.col(c) + shift(digits), digits) + 0.0 for c, t in df.dtypes if t == "double"} | {c: F.col(c).cast("long") for c, t in df.dtypes if t == "int"}
    return df.withColumns(out) if out else df


def query(name: str, sql: str | None = None, with_: str = WITH, digits: int = DIGITS):
    """Registers a query under this name; sql is what follows the common tables."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        Q[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            SQL[name] = f"{with_}\n{sql}" if with_ else sql
        return f

    return add


def n6(x: str, name: str, digits: int = DIGITS) -> str:
    return f"round(({x}) + {shift(digits)!r}, {digits}) + 0.0 AS {name}"


# One query for each statistic of whole series.

_N, _CG = "count(r)", "(product(1 + r) - 1)"
_WIN = "coalesce(count(*) FILTER (r > 0) / nullif(count(*) FILTER (r <> 0), 0)::DOUBLE, 0)"
_AW, _AL = "avg(r) FILTER (r > 0)", "avg(r) FILTER (r < 0)"
_PAY = f"({_AW} / nullif(abs({_AL}), 0))"
_PF = "(coalesce(sum(r) FILTER (r >= 0), 0) / nullif(abs(coalesce(sum(r) FILTER (r < 0), 0)), 0))"
_TAIL = "abs(quantile_cont(r, 0.95) / nullif(quantile_cont(r, 0.05), 0))"
_EXP = f"(ceil(100.0 * count(*) FILTER (r <> 0) / {_N}) / 100.0)"
_CAGR = f"(pow(abs({_CG} + 1), 252.0 / {_N}) - 1)"
_C = "abs(corr(r, prev))"
_PEN = f"sqrt(1 + 2 * (CASE WHEN {_C} = 1 THEN ({_N} - 1) / 2.0 ELSE {_C} * ({_N} * (1 - {_C}) - (1 - pow({_C}, {_N}))) / ({_N} * (1 - {_C}) * (1 - {_C})) END))"
_S0, _DOWN = "(avg(r) / nullif(stddev_samp(r), 0))", f"sqrt(sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) / {_N})"
_T0 = f"(avg(r) / nullif({_DOWN}, 0))"
_SH, _SO = f"({_S0} * sqrt(252.0))", f"({_T0} * sqrt(252.0))"
_UL = f"sqrt(sum(dd * dd) / nullif({_N} - 1, 0))"
_CV = "coalesce(avg(r) FILTER (r < var_), any_value(var_))"


def _phi(base: str) -> str:
    z = f"(({base}) / sqrt((1 + 0.5 * pow({base}, 2) - skewness(r) * ({base}) + (kurtosis(r) - 3) / 4 * pow({base}, 2)) / ({_N} - 1)))"
    return f"list_transform([{z}], lambda x: CASE WHEN x > 7 THEN 1.0 WHEN x < -7 THEN 0.0 WHEN x = 0 THEN 0.5 ELSE 0.5 + exp(-x * x / 2) / sqrt(2 * pi()) * sign(x) * list_sum(list_transform(range(0, 150), lambda k: exp((2 * k + 1) * ln(abs(x)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)))) END)[1]"


STAT_SQL = {
    "comp": _CG,
    "expected_return": f"pow(product(1 + r), 1.0 / {_N}) - 1",
    "best": "max(r)",
    "worst": "min(r)",
    "exposure": _EXP,
    "win_rate": _WIN,
    "avg_return": "avg(r) FILTER (r <> 0)",
    "avg_win": _AW,
    "avg_loss": _AL,
    "payoff_ratio": _PAY,
    "profit_ratio": f"CASE WHEN count(*) FILTER (r >= 0) = 0 THEN 0 ELSE abs(avg(r) FILTER (r >= 0) / nullif(count(*) FILTER (r >= 0), 0)) / nullif(abs({_AL} / nullif(count(*) FILTER (r < 0), 0)), 0) END",
    "profit_factor": _PF,
    "cpc_index": f"{_PF} * {_WIN} * {_PAY}",
    "common_sense_ratio": f"{_PF} * {_TAIL}",
    "outlier_win_ratio": "quantile_cont(r, 0.99) / nullif(avg(r) FILTER (r >= 0), 0)",
    "outlier_loss_ratio": f"quantile_cont(r, 0.01) / nullif({_AL}, 0)",
    "gain_to_pain_ratio": "sum(r) / nullif(abs(coalesce(sum(r) FILTER (r < 0), 0)), 0)",
    "recovery_factor": "abs(sum(r)) / nullif(abs(min(dd)), 0)",
    "risk_of_ruin": f"pow((1 - {_WIN}) / (1 + {_WIN}), {_N})",
    "kelly_criterion": f"({_PAY} * {_WIN} - (1 - {_WIN})) / nullif({_PAY}, 0)",
    "cagr": _CAGR,
    "rar": f"{_CAGR} / nullif({_EXP}, 0)",
    "volatility": "stddev_samp(r) * sqrt(252.0)",
    "autocorr_penalty": _PEN,
    "sharpe": _SH,
    "smart_sharpe": f"{_SH} / {_PEN}",
    "sortino": _SO,
    "smart_sortino": f"{_SO} / {_PEN}",
    "adjusted_sortino": f"{_SO} / sqrt(2.0)",
    "smart_adjusted_sortino": f"{_SO} / sqrt(2.0) / {_PEN}",
    "probabilistic_sharpe_ratio": _phi(_S0),
    "probabilistic_sortino_ratio": _phi(_T0),
    "probabilistic_adjusted_sortino_ratio": _phi(f"({_T0} / sqrt(2.0))"),
    "omega": "CASE WHEN count(r) >= 2 THEN sum(greatest(r, 0)) / nullif(sum(greatest(-r, 0)), 0) END",
    "skew": "skewness(r)",
    "kurtosis": "kurtosis(r)",
    "max_drawdown": "min(dd)",
    "calmar": f"{_CAGR} / nullif(abs(min(dd)), 0)",
    "ulcer_index": _UL,
    "ulcer_performance_index": f"{_CG} / nullif({_UL}, 0)",
    "serenity_index": f"sum(r) / nullif({_UL} * (-coalesce(avg(dd) FILTER (dd < dd_var), any_value(dd_var)) / nullif(stddev_samp(r), 0)), 0)",
    "value_at_risk": "avg(r) + -1.6448536269514722 * stddev_samp(r)",
    "conditional_value_at_risk": _CV,
    "tail_ratio": _TAIL,
    "risk_return_ratio": _S0,
}

for _name in STATS:
    query(f"stat_{_name}", f"SELECT series_id, {n6(STAT_SQL[_name], _name)} FROM e GROUP BY series_id")(lambda spark, sf, name=_name: compute(returns_by_priority(spark, sf), name))

#: The same with a yearly rate of 2 % off each day.
_RF = (1 + 0.02) ** (1 / 252) - 1
for _name, _x in {
    "sharpe": f"avg(r - {_RF!r}) / nullif(stddev_samp(r), 0) * sqrt(252.0)",
    "sortino": f"avg(r - {_RF!r}) / nullif(sqrt(sum(CASE WHEN r < {_RF!r} THEN pow(r - {_RF!r}, 2) ELSE 0 END) / count(r)), 0) * sqrt(252.0)",
}.items():
    query(f"stat_{_name}_rf", f"SELECT series_id, {n6(_x, _name)} FROM e GROUP BY series_id")(lambda spark, sf, name=_name: compute(returns_by_priority(spark, sf), name, settings=Settings(rf=0.02)))

_MONTH = "SELECT series_id, date_trunc('month', dt)::DATE AS period, product(1 + r) - 1 AS r FROM ret GROUP BY 1, 2"
for _name in ("best", "worst", "win_rate", "avg_return", "avg_win", "avg_loss", "expected_return"):
    query(f"stat_{_name}_month", f"SELECT series_id, {n6(STAT_SQL[_name], _name)} FROM ({_MONTH}) GROUP BY series_id")(lambda spark, sf, name=_name: compute(returns_by_priority(spark, sf), name, period="month"))


@query("gain_to_pain_month", f"SELECT series_id, {n6(STAT_SQL['gain_to_pain_ratio'], 'gain_to_pain_ratio')} FROM (SELECT series_id, date_trunc('month', dt) AS m, sum(r) AS r FROM ret GROUP BY 1, 2) GROUP BY 1")
def _(spark, sf):
    return compute(K.resample(returns_by_priority(spark, sf), "ME", "sum", empty=0.0), "gain_to_pain_ratio")


_STREAK = """SELECT series_id, max(n) AS {name} FROM (
  SELECT series_id, run, count(*) FILTER (r {sign} 0) AS n FROM (
    SELECT *, sum(change) OVER (PARTITION BY series_id ORDER BY dt ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT *, CASE WHEN (r {sign} 0) = lag(r {sign} 0) OVER (PARTITION BY series_id ORDER BY dt) THEN 0 ELSE 1 END AS change FROM {rows})) GROUP BY 1, 2) GROUP BY 1"""
for _period, _rows in ((None, "ret"), ("month", f"(SELECT series_id, period AS dt, r FROM ({_MONTH}))")):
    for _losses, _name in ((False, "consecutive_wins"), (True, "consecutive_losses")):
        query(_name + ("_month" if _period else ""), _STREAK.format(name=_name, sign="<" if _losses else ">", rows=_rows))(lambda spark, sf, losses=_losses, period=_period: longest_streak(returns_by_priority(spark, sf), losses, period))


# Conversions.

_W = "(PARTITION BY series_id ORDER BY dt)"
_CUM = "(PARTITION BY series_id ORDER BY dt ROWS UNBOUNDED PRECEDING)"
PRICES = WITH + f", prices AS (SELECT series_id, dt, 100 * product(1 + r) OVER {_CUM} AS p FROM ret)"


@query("compsum", f"SELECT series_id, dt, {n6('g - 1', 'compsum')} FROM grown")
def _(spark, sf):
    return L.compsum(returns_by_priority(spark, sf))


@query("to_prices", f"SELECT series_id, dt, {n6('100000.0 * g', 'p', 3)} FROM grown", digits=3)
def _(spark, sf):
    return P.to_prices(returns_by_priority(spark, sf))


@query("to_returns", f"SELECT series_id, dt, {n6(f'coalesce(p / lag(p) OVER {_W} - 1, 0)', 'r', 9)} FROM prices", PRICES, 9)
def _(spark, sf):
    return P.to_returns(prices_by_priority(spark, sf))


@query("prepare_infer", f"SELECT series_id, dt, {n6(f'CASE WHEN min(p) OVER s >= 0 AND max(p) OVER s > 1 THEN coalesce(p / lag(p) OVER {_W} - 1, 0) ELSE p END', 'r', 9)} FROM prices WINDOW s AS (PARTITION BY series_id)", PRICES, 9)
def _(spark, sf):
    return P.prepare(prices_by_priority(spark, sf), "infer", value="p")


@query("prepare_prices_infer", f"SELECT series_id, dt, {n6('g', 'p')} FROM grown")
def _(spark, sf):
    return P.prepare_prices(returns_by_priority(spark, sf), "infer", value="r")


@query("log_returns", f"SELECT series_id, dt, {n6('CASE WHEN r > -1 THEN ln(1 + r) END', 'r')} FROM ret")
def _(spark, sf):
    return P.to_log_returns(returns_by_priority(spark, sf))


@query("excess_returns", f"SELECT series_id, dt, {n6(f'r - {_RF!r}', 'r')} FROM ret")
def _(spark, sf):
    return P.to_excess(returns_by_priority(spark, sf), 0.02, 252)


@query("excess_over_series", f"SELECT series_id, dt, {n6('r - b / 10', 'r')} FROM ret LEFT JOIN mkt USING (dt)")
def _(spark, sf):
    return P.to_excess(returns_by_priority(spark, sf), market(spark, sf).select("dt", (F.col("b") / 10).alias("rf")))


@query("rebase", f"SELECT series_id, dt, {n6(f'p / first_value(p) OVER {_W} * 100', 'p')} FROM prices", PRICES)
def _(spark, sf):
    return P.rebase(prices_by_priority(spark, sf))


@query("multi_shift", f"SELECT series_id, dt, {n6('p', 'p')}, {n6(f'lag(p) OVER {_W}', 'p1')}, {n6(f'lag(p, 2) OVER {_W}', 'p2')} FROM prices", PRICES)
def _(spark, sf):
    return P.multi_shift(prices_by_priority(spark, sf))


_KEEP = 1 - 2 / 31


@query(
    "exponential_stdev",
    f"""SELECT series_id, dt, CASE WHEN n >= 30 THEN round(sqrt(greatest((q - s * s / w) / w * (w * w) / nullif(w * w - w2, 0), 0)) + {shift(DIGITS)!r}, {DIGITS}) + 0.0 END AS ewm_std FROM (
  SELECT x.series_id, x.dt, x.n, sum(pow({_KEEP!r}, x.n - y.n)) AS w, sum(pow({_KEEP!r}, 2 * (x.n - y.n))) AS w2, sum(pow({_KEEP!r}, x.n - y.n) * y.r) AS s, sum(pow({_KEEP!r}, x.n - y.n) * y.r * y.r) AS q
  FROM i x JOIN i y ON x.series_id = y.series_id AND y.n <= x.n AND y.n > x.n - 690 GROUP BY 1, 2, 3)""",
    WITH + f", i AS (SELECT *, row_number() OVER {_W} AS n FROM ret)",
)
def _(spark, sf):
    return P.exponential_stdev(returns_by_priority(spark, sf), 30)


@query(
    "count_consecutive",
    f"""SELECT series_id, dt, up, CAST(up * row_number() OVER (PARTITION BY series_id, run ORDER BY dt) AS BIGINT) AS streak FROM (
  SELECT *, sum(change) OVER {_CUM} AS run FROM (SELECT series_id, dt, CAST(r > 0 AS BIGINT) AS up, CASE WHEN (r > 0) = lag(r > 0) OVER {_W} THEN 0 ELSE 1 END AS change FROM ret))""",
)
def _(spark, sf):
    return P.consecutive(returns_by_priority(spark, sf).select("series_id", "dt", (F.col("r") > 0).cast("long").alias("up")), "up")


@query("wide_and_long", f"SELECT series_id, dt, {n6('r', 'r')} FROM (SELECT DISTINCT dt FROM ret) CROSS JOIN (SELECT DISTINCT series_id FROM ret WHERE series_id IN ('1-URGENT', '2-HIGH')) LEFT JOIN ret USING (series_id, dt)")
def _(spark, sf):
    return from_wide(to_wide(returns_by_priority(spark, sf), ["1-URGENT", "2-HIGH"]))


# Portfolios.

for _mode, _x in (("comp", f"100000.0 * product(1 + r) OVER {_CUM}"), ("sum", f"100000.0 * (1 + sum(r) OVER {_CUM})"), ("fixed", f"100000.0 + sum(100000.0 * (1 + coalesce(prev, 0)) * r) OVER {_CUM}")):
    query(f"make_portfolio_{_mode}", f"SELECT series_id, CAST(min(dt) - 1 AS DATE) AS dt, 100000.0::DOUBLE AS balance FROM ret GROUP BY 1 UNION ALL SELECT series_id, dt, round({_x} + {shift(3)!r}, 3) + 0.0 FROM grown", digits=3)(lambda spark, sf, mode=_mode: O.make_portfolio(returns_by_priority(spark, sf), mode=mode))

WEIGHTS = [("1-URGENT", 0.3), ("2-HIGH", 0.25), ("3-MEDIUM", 0.2), ("4-NOT SPECIFIED", 0.15), ("5-LOW", 0.1)]
_VALUES = ", ".join(f"('{t}', {w}::DOUBLE)" for t, w in WEIGHTS)


@query("make_index", f"SELECT dt, {n6('sum(w * r)', 'r')} FROM ret JOIN (VALUES {_VALUES}) AS v(series_id, w) USING (series_id) GROUP BY dt HAVING count(*) = 5")
def _(spark, sf):
    return O.make_index(returns_by_priority(spark, sf), spark.createDataFrame(WEIGHTS, "ticker string, weight double"))


@query("make_index_match_dates", f"SELECT dt, {n6('sum(w * r)', 'r')} FROM ret JOIN (VALUES {_VALUES}) AS v(series_id, w) USING (series_id) WHERE dt >= (SELECT max(s) FROM (SELECT min(dt) FILTER (r <> 0) AS s FROM ret GROUP BY series_id)) GROUP BY dt HAVING count(*) = 5")
def _(spark, sf):
    return O.make_index(returns_by_priority(spark, sf), spark.createDataFrame(WEIGHTS, "ticker string, weight double"), True)


@query("match_volatility", f"SELECT series_id, dt, {n6('r / stddev_samp(r) OVER (PARTITION BY series_id) * (SELECT stddev_samp(b) FROM mkt)', 'r')} FROM ret")
def _(spark, sf):
    return O.match_volatility(returns_by_priority(spark, sf), market(spark, sf))


# Choosing rows.

for _name, _f, _op in (("outliers", X.outliers, ">"), ("remove_outliers", X.remove_outliers, "<")):
    query(_name, f"SELECT series_id, dt, {n6('r', 'r')} FROM ret JOIN (SELECT series_id, quantile_cont(r, 0.95) AS q FROM ret GROUP BY 1) USING (series_id) WHERE r {_op} q")(lambda spark, sf, f=_f: f(returns_by_priority(spark, sf)))

AS_OF = "1998-05-17"
for _name, _f, _x in (
    ("month_to_date", X.month_to_date, "dt >= DATE '1998-05-01'"),
    ("quarter_to_date", X.quarter_to_date, "dt >= DATE '1998-04-01'"),
    ("year_to_date", X.year_to_date, "dt >= DATE '1998-01-01'"),
    ("current_month", X.current_month, "dt >= DATE '1998-05-01' AND dt <= DATE '1998-05-17'"),
):
    query(_name, f"SELECT series_id, dt, {n6('r', 'r')} FROM ret WHERE {_x}")(lambda spark, sf, f=_f: f(returns_by_priority(spark, sf), AS_OF))


@query("on_dates", f"SELECT series_id, dt, {n6('r', 'r')} FROM ret WHERE dt IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_quantity = 50)")
def _(spark, sf):
    return X.on_dates(returns_by_priority(spark, sf), table(spark, sf, "lineitem").where("l_quantity = 50").select(F.to_date("l_shipdate").alias("dt")))


@query("match_dates", f"SELECT series_id, dt, {n6('r', 'r')} FROM ret JOIN (SELECT series_id, greatest(min(dt) FILTER (r <> 0), (SELECT min(dt) FILTER (b <> 0) FROM mkt)) AS s FROM ret GROUP BY 1) USING (series_id) WHERE dt >= s")
def _(spark, sf):
    return X.match_dates(returns_by_priority(spark, sf), market(spark, sf))[0]


# Periods.

for _period, _x in (("year", "date_trunc('year', dt)::DATE"), ("quarter", "date_trunc('quarter', dt)::DATE"), ("month", "date_trunc('month', dt)::DATE"), ("week", "date_trunc('week', dt)::DATE"), ("month_of_year", "month(dt)"), ("quarter_of_year", "quarter(dt)"), ("day", None)):
    query(f"aggregate_{_period}", f"SELECT series_id, {_x} AS period, {n6('product(1 + r) - 1', 'r')} FROM ret GROUP BY 1, 2" if _x else f"SELECT series_id, dt AS period, {n6('r', 'r')} FROM ret")(lambda spark, sf, period=_period: K.aggregate_returns(returns_by_priority(spark, sf), period))


@query("group_returns_sum", f"SELECT series_id, dayofweek(dt) + 1 AS period, {n6('sum(r)', 'r')} FROM ret GROUP BY 1, 2")
def _(spark, sf):
    return K.group_returns(returns_by_priority(spark, sf), F.dayofweek("dt"))


_ENDS = {
    "D": ("dt", "1 day"), "W-MON": ("CAST(date_trunc('week', dt - 1) + INTERVAL 7 DAY AS DATE)", "7 days"), "ME": ("last_day(dt)", "1 month"),
    "QE": ("last_day(CAST(date_trunc('quarter', dt) + INTERVAL 2 MONTH AS DATE))", "3 months"), "YE": ("make_date(year(dt), 12, 31)", "1 year"),
}


def _bins(freq: str, agg: str, rows: str = "ret", value: str = "r") -> str:
    end, step = _ENDS[freq]
    snap = "s" if freq in ("D", "W-MON") else "last_day(s)"
    return f"""(SELECT series_id, dt, {value} FROM (SELECT series_id, {snap} AS dt FROM (SELECT series_id, CAST(unnest(generate_series(min({end}), max({end}), INTERVAL {step})) AS DATE) AS s FROM {rows} GROUP BY 1))
  LEFT JOIN (SELECT series_id, {end} AS dt, {agg} AS {value} FROM {rows} GROUP BY 1, 2) USING (series_id, dt))"""


for _freq in ("W-MON", "ME", "QE", "YE"):
    query(f"resample_{_freq[0].lower()}", f"SELECT series_id, dt, {n6('coalesce(r, 0)', 'r')} FROM {_bins(_freq, 'product(1 + r) - 1')}")(lambda spark, sf, freq=_freq: K.resample(returns_by_priority(spark, sf), freq, "comp", empty=0.0))


@query("resample_week_std", f"SELECT series_id, dt, {n6('r', 'r')} FROM {_bins('W-MON', 'stddev_samp(r)')}")
def _(spark, sf):
    return K.resample(returns_by_priority(spark, sf), "W", "std")


@query("as_frequency_day", f"SELECT series_id, dt, {n6('r', 'r')} FROM {_bins('D', 'any_value(r)')}")
def _(spark, sf):
    return K.as_frequency(returns_by_priority(spark, sf))


@query("filled_daily", f"SELECT series_id, dt, {n6(f'last_value(r IGNORE NULLS) OVER {_CUM}', 'r')} FROM {_bins('D', 'any_value(r)')}")
def _(spark, sf):
    return K.filled_daily(returns_by_priority(spark, sf))


_PIVOT = ", ".join(n6(f"coalesce(product(1 + r) FILTER (month(dt) = {i}) - 1, 0)", m) for i, m in enumerate(K.MONTHS, 1))


@query("monthly_returns", f"SELECT series_id, CAST(year(dt) AS BIGINT) AS year, {_PIVOT}, {n6('product(1 + r) - 1', 'EOY')} FROM ret GROUP BY 1, 2")
def _(spark, sf):
    return K.monthly_returns(returns_by_priority(spark, sf))


@query(
    "distribution",
    " UNION ALL ".join(
        f"SELECT series_id, '{name}' AS period, CAST(count(*) FILTER (r BETWEEN lo AND hi) AS BIGINT) AS n_values, CAST(count(*) FILTER (NOT r BETWEEN lo AND hi) AS BIGINT) AS n_outliers, {n6('sum(r) FILTER (r BETWEEN lo AND hi)', 'total')} FROM (SELECT series_id, r, q[1] - 1.5 * (q[2] - q[1]) AS lo, q[2] + 1.5 * (q[2] - q[1]) AS hi FROM (SELECT series_id, coalesce(r, 0) AS r, quantile_cont(coalesce(r, 0), [0.25, 0.75]) OVER (PARTITION BY series_id) AS q FROM {rows})) GROUP BY 1"
        for name, rows in (("Daily", "ret"), ("Weekly", _bins("W-MON", "product(1 + r) - 1")), ("Monthly", _bins("ME", "product(1 + r) - 1")), ("Quarterly", _bins("QE", "product(1 + r) - 1")), ("Yearly", _bins("YE", "product(1 + r) - 1")))
    ),
)
def _(spark, sf):
    rows = K.distribution(returns_by_priority(spark, sf))
    return rows.select("series_id", "period", F.size("values").cast("long").alias("n_values"), F.size("outliers").cast("long").alias("n_outliers"), F.aggregate("values", F.lit(0.0), lambda s, x: s + x).alias("total"))


# Stored series.


def _stored_prices(spark, sf) -> str:
    """A new folder of closing prices by year, in spark.checkpoint.dir or, for a local session without one, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-prices-")
    path = f"{base.rstrip('/')}/prices-{uuid.uuid4().hex}"
    write_series(prices_by_priority(spark, sf).withColumnRenamed("p", "close"), path)
    return path


@query("download_returns", f"SELECT series_id, dt, {n6(f'coalesce(p / lag(p) OVER {_W} - 1, 0)', 'r', 9)} FROM prices WHERE series_id IN ('1-URGENT', '5-LOW') QUALIFY dt >= DATE '1996-03-01'", PRICES, 9)
def _(spark, sf):
    return download_returns(spark, _stored_prices(spark, sf), ["1-URGENT", "5-LOW"], datetime.date(1996, 3, 1))


@query("read_series", f"SELECT series_id, dt, {n6('p', 'close')} FROM prices WHERE dt BETWEEN DATE '1996-03-01' AND DATE '1997-11-15'", PRICES)
def _(spark, sf):
    return read_series(spark, _stored_prices(spark, sf), value="close", since=datetime.date(1996, 3, 1), until=datetime.date(1997, 11, 15))


@query("beside", f"SELECT coalesce(a.dt, b.dt) AS dt, {n6('a.r', 'urgent')}, {n6('b.r', 'low')} FROM (SELECT dt, r FROM ret WHERE series_id = '1-URGENT') a FULL JOIN (SELECT dt, r FROM ret WHERE series_id = '5-LOW' AND year(dt) > 1995) b ON a.dt = b.dt")
def _(spark, sf):
    rows = returns_by_priority(spark, sf)
    return beside(rows.where("series_id = '1-URGENT'").select("dt", F.col("r").alias("urgent")), rows.where("series_id = '5-LOW' and year(dt) > 1995").select("dt", F.col("r").alias("low")))


# Rolling measures.


def _roll(n: int) -> str:
    return f"(PARTITION BY series_id ORDER BY dt ROWS {n - 1} PRECEDING)"


def _full(x: str, n: int, c: str = "r") -> str:
    return f"CASE WHEN count({c}) OVER {_roll(n)} = {n} THEN {x} END"


_RV = _full(f"stddev_samp(r) OVER {_roll(126)} * sqrt(252.0)", 126)
_RS = _full(f"avg(r) OVER {_roll(126)} / nullif(stddev_samp(r) OVER {_roll(126)}, 0) * sqrt(252.0)", 126)
_RT = _full(f"avg(r) OVER {_roll(126)} / nullif(sqrt(sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) OVER {_roll(126)} / 126), 0) * sqrt(252.0)", 126)
for _name, _f, _x in (("rolling_volatility", L.rolling_volatility, _RV), ("rolling_sharpe", L.rolling_sharpe, _RS), ("rolling_sortino", L.rolling_sortino, _RT)):
    query(_name, f"SELECT series_id, dt, {n6('r', 'r')}, {n6(_x, _name)} FROM ret")(lambda spark, sf, f=_f: f(returns_by_priority(spark, sf)))


@query("implied_volatility", f"SELECT series_id, dt, {n6('r', 'r')}, {n6(_full(f'stddev_samp(l) OVER {_roll(252)} * sqrt(252.0)', 252, 'l'), 'implied_volatility')} FROM (SELECT *, ln(1 + r) AS l FROM ret)")
def _(spark, sf):
    return L.implied_volatility(returns_by_priority(spark, sf))


@query("implied_volatility_whole", f"SELECT series_id, {n6('stddev_samp(ln(1 + r))', 'implied_volatility')} FROM ret GROUP BY 1")
def _(spark, sf):
    return L.implied_volatility(returns_by_priority(spark, sf), annualize=False)


@query("pct_rank", f"SELECT series_id, dt, {n6('(len(list_filter(a, lambda x: x < p)) + (len(list_filter(a, lambda x: x = p)) + 1) / 2.0) / len(a) * 100', 'pct_rank')} FROM (SELECT *, list(p) OVER {_roll(60)} AS a FROM prices)", PRICES)
def _(spark, sf):
    return L.pct_rank(prices_by_priority(spark, sf))


_RS21 = _full(f"avg(r) OVER {_roll(21)} / nullif(stddev_samp(r) OVER {_roll(21)}, 0) * sqrt(252.0)", 21)


@query("transform_steps", f"SELECT series_id, dt, {n6('r', 'r')}, {n6('rolling_sharpe', 'rolling_sharpe')} FROM (SELECT *, {_RS21} AS rolling_sharpe FROM ret) WHERE dt >= DATE '1998-01-01'")
def _(spark, sf):
    """Rolling Sharpe ratios of the year to date, step by step."""
    return returns_by_priority(spark, sf).transform(fluent.rolling_sharpe(window=21)).transform(fluent.year_to_date(AS_OF))


_BETA = _full(f"covar_samp(r, b) OVER {_roll(252)} / nullif(var_samp(b) OVER {_roll(252)}, 0)", 252)


@query("rolling_greeks", f"SELECT series_id, dt, {n6('beta', 'beta')}, {n6('avg(r) OVER (PARTITION BY series_id) - beta * avg(b) OVER (PARTITION BY series_id)', 'alpha')} FROM (SELECT *, {_BETA} AS beta FROM both_)")
def _(spark, sf):
    return L.rolling_greeks(B.on_common_dates(returns_by_priority(spark, sf), market(spark, sf)))


# Drawdowns.

EPISODES = (
    WITH
    + f""", runs AS (
  SELECT *, sum(change) OVER {_CUM} AS run FROM (SELECT series_id, dt, dd, CASE WHEN (dd <> 0) = lag(dd <> 0) OVER {_W} THEN 0 ELSE 1 END AS change FROM under)
), deep AS (
  SELECT *, quantile_cont(-dd, 0.99) OVER (PARTITION BY series_id, run) AS deep FROM runs WHERE dd <> 0
), episodes AS (
  SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY start) AS episode, * EXCLUDE (series_id) FROM (
    SELECT series_id, min(dt) AS start, arg_min(dt, (dd, dt)) AS valley, max(dt) AS "end", CAST(max(dt) - min(dt) + 1 AS BIGINT) AS days, min(dd) * 100 AS max_dd, min(dd) FILTER (-dd < deep) * 100 AS max_dd_99
    FROM deep GROUP BY series_id, run)
)"""
)


def _drawdowns(spark, sf):
    return D.to_drawdown_series(returns_by_priority(spark, sf))


@query("drawdown_series", f"SELECT series_id, dt, {n6('dd', 'dd')} FROM under")
def _(spark, sf):
    return _drawdowns(spark, sf)


@query("price_drawdowns", f"SELECT series_id, dt, {n6(f'p / greatest(max(p) OVER {_CUM}, first_value(p) OVER {_CUM}) - 1', 'dd')} FROM prices", PRICES)
def _(spark, sf):
    return D.price_drawdowns(prices_by_priority(spark, sf))


@query("drawdown_details", f'SELECT series_id, episode, start, valley, "end", days, {n6("max_dd", "max_dd")}, {n6("max_dd_99", "max_dd_99")} FROM episodes', EPISODES)
def _(spark, sf):
    return D.drawdown_details(_drawdowns(spark, sf))


@query("longest_drawdowns", f'SELECT series_id, episode, start, valley, "end", days, {n6("max_dd", "max_dd")}, {n6("max_dd_99", "max_dd_99")}, rank FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY days DESC, start) AS rank FROM episodes) WHERE rank <= 5', EPISODES)
def _(spark, sf):
    return D.longest_drawdowns(_drawdowns(spark, sf))


@query("drawdown_summary", f'SELECT series_id, {n6("min(max_dd)", "max_dd")}, arg_min(valley, (max_dd, start)) AS valley, arg_min(start, (max_dd, start)) AS start, arg_min("end", (max_dd, start)) AS "end", max(days) AS longest_days, {n6("avg(max_dd)", "avg_dd")}, {n6("avg(days)", "avg_days")} FROM episodes GROUP BY 1', EPISODES)
def _(spark, sf):
    return D.drawdown_summary(_drawdowns(spark, sf))


# Against a benchmark.


def _both(spark, sf):
    return B.on_common_dates(returns_by_priority(spark, sf), market(spark, sf))


@query("greeks", f"SELECT series_id, {n6('coalesce(beta, 0)', 'beta')}, {n6('coalesce((mr - beta * mb) * 252, 0)', 'alpha')} FROM (SELECT series_id, covar_samp(r, b) / nullif(var_samp(b), 0) AS beta, avg(r) AS mr, avg(b) AS mb FROM both_ GROUP BY 1)")
def _(spark, sf):
    return B.greeks(_both(spark, sf))


@query("r_squared", f"SELECT series_id, {n6('pow(corr(r, b), 2)', 'r_squared')} FROM both_ GROUP BY 1")
def _(spark, sf):
    return B.r_squared(_both(spark, sf))


@query("information_ratio", f"SELECT series_id, {n6('coalesce(avg(r - b) / nullif(stddev_samp(r - b), 0), 0)', 'information_ratio')} FROM both_ GROUP BY 1")
def _(spark, sf):
    return B.information_ratio(_both(spark, sf))


@query("treynor_ratio", f"SELECT series_id, {n6('coalesce((product(1 + r) - 1) / nullif(covar_samp(r, b) / nullif(var_samp(b), 0), 0), 0)', 'treynor_ratio')} FROM both_ GROUP BY 1")
def _(spark, sf):
    return B.treynor_ratio(_both(spark, sf))


_COMPARE = """SELECT coalesce(m.series_id, s.series_id) AS series_id, coalesce(m.period, t.period) AS period, round(t.b + 1.7e-10, 6) + 0.0 AS benchmark, round(m.r + 1.7e-10, 6) + 0.0 AS returns,
  round(m.r / nullif(t.b, 0) + 1.7e-10, 6) + 0.0 AS multiplier, CASE WHEN m.r >= t.b THEN '+' ELSE '-' END AS won
FROM (SELECT DISTINCT series_id FROM ret) s CROSS JOIN (SELECT {key} AS period, (product(1 + b) - 1) * 100 AS b FROM mkt GROUP BY 1) t
FULL JOIN (SELECT series_id, {key} AS period, (product(1 + r) - 1) * 100 AS r FROM ret GROUP BY 1, 2) m ON m.series_id = s.series_id AND m.period = t.period"""
for _period, _x in (("year", "date_trunc('year', dt)::DATE"), ("month", "date_trunc('month', dt)::DATE")):
    query(f"compare_{_period}", _COMPARE.format(key=_x))(lambda spark, sf, period=_period: B.compare(returns_by_priority(spark, sf), market(spark, sf), period))


@query(
    "align_benchmark",
    f"""SELECT series_id, dt, {n6('r', 'r')}, {n6(f'coalesce(p / lag(p) OVER {_W} - 1, 0)', 'b')} FROM ret LEFT JOIN (
  SELECT dt, first_value(p IGNORE NULLS) OVER (ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM (
    SELECT CAST(unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY)) AS DATE) AS dt FROM bench) LEFT JOIN bench USING (dt)) USING (dt)""",
    WITH + ", bench AS (SELECT dt, product(1 + r) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING) AS p FROM ret WHERE series_id = '1-URGENT')",
)
def _(spark, sf):
    rows = returns_by_priority(spark, sf)  # one of the series as the benchmark: it lacks dates that others have
    return B.align_benchmark(rows, rows.where("series_id = '1-URGENT'").select("dt", F.col("r").alias("b")))


# Monte Carlo: 1000 paths of each daily series; 20 where every row of every path is returned.

SIMS, SHOWN, SEED = 1000, 20, 7


def _mixed(x: str, shift: int, factor: int) -> str:
    return f"((xor({x}, {x} >> {shift}) * {factor}) % {M.PRIME})"


def _rounds() -> str:
    """The rounds of the permutation, one inside the other."""
    key = lambda k: f"((sim * 48271 + {(SEED * 69621 + k * 1298837 + 12345) % M.PRIME}) % {M.PRIME})"
    rows = f"SELECT series_id, r, i, n, sim, (i * {M.STRIDE} + {_mixed(key(M.ROUNDS), 13, 40692)}) % n AS x FROM placed CROSS JOIN (SELECT unnest(range(0, {SIMS})) AS sim)"
    for k in range(M.ROUNDS):
        rows = f"SELECT *, {_mixed(key(k), 13, 40692)} AS z FROM ({rows})"
        rows = f"SELECT *, (z % n - x + n) % n AS y FROM ({rows})"
        rows = f"SELECT *, (greatest(x, y) * 16807 + z) % {M.PRIME} AS t FROM ({rows})"
        rows = f"SELECT * EXCLUDE (y, z, t) REPLACE (CASE WHEN ({_mixed('t', 15, 1103515245)} >> 11) & 1 = 1 THEN y ELSE x END AS x) FROM ({rows})"
    return f"SELECT series_id, sim, r, CASE WHEN sim = 0 THEN i ELSE x END AS step FROM ({rows})"


PATHS = (
    WITH
    + f""", placed AS (SELECT series_id, r, row_number() OVER (PARTITION BY series_id ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM ret
), keyed AS (
  {_rounds()}
), paths AS (
  SELECT series_id, sim, step, r, product(1 + r) OVER (PARTITION BY series_id, sim ORDER BY step ROWS UNBOUNDED PRECEDING) - 1 AS v FROM keyed
), mc AS (
  SELECT series_id, sim, arg_max(v, step) AS terminal, min(dd) AS max_dd FROM (SELECT *, (1 + v) / nullif(max(1 + v) OVER (PARTITION BY series_id, sim ORDER BY step ROWS UNBOUNDED PRECEDING), 0) - 1 AS dd FROM paths) GROUP BY 1, 2
)"""
)


def _paths(spark, sf):
    return M.paths(returns_by_priority(spark, sf), SIMS, SEED)


def _five(c: str) -> str:
    return ", ".join([n6(f"min({c})", "min"), n6(f"max({c})", "max"), n6(f"avg({c})", "mean"), n6(f"median({c})", "median"), n6(f"stddev_samp({c})", "std"), *(n6(f"quantile_cont({c}, {p / 100})", f"percentile_{p}") for p in (5, 25, 75, 95))])


@query("montecarlo_paths", f"SELECT series_id, sim, step, {n6('r', 'r')}, {n6('v', 'v')} FROM paths", PATHS.replace(f"range(0, {SIMS})", f"range(0, {SHOWN})"))
def _(spark, sf):
    return M.paths(returns_by_priority(spark, sf), SHOWN, SEED)


@query("montecarlo_stats", f"SELECT series_id, {_five('terminal')} FROM mc GROUP BY 1", PATHS)
def _(spark, sf):
    return M.terminal_stats(M.path_summary(_paths(spark, sf)))


@query("montecarlo_drawdown", f"SELECT series_id, {_five('max_dd')} FROM mc GROUP BY 1", PATHS)
def _(spark, sf):
    return M.montecarlo_drawdown(returns_by_priority(spark, sf), SIMS, SEED)


@query("montecarlo_bust", f"SELECT series_id, {n6('avg(CASE WHEN max_dd <= -0.02 THEN 1.0 ELSE 0.0 END)', 'bust_probability')} FROM mc GROUP BY 1", PATHS)
def _(spark, sf):
    return M.bust_probability(M.path_summary(_paths(spark, sf)), -0.02)


@query("montecarlo_goal", f"SELECT series_id, {n6('avg(CASE WHEN terminal >= 0.0 THEN 1.0 ELSE 0.0 END)', 'goal_probability')} FROM mc GROUP BY 1", PATHS)
def _(spark, sf):
    return M.goal_probability(M.path_summary(_paths(spark, sf)), 0.0)


@query("montecarlo_percentile", f"SELECT series_id, step, {n6('quantile_cont(v, 0.25)', 'v')} FROM paths GROUP BY 1, 2", PATHS)
def _(spark, sf):
    return M.percentile_path(_paths(spark, sf), 25)


@query("montecarlo_band", f"SELECT series_id, step, {n6('quantile_cont(v, 0.025)', 'lower')}, {n6('quantile_cont(v, 0.975)', 'upper')} FROM paths GROUP BY 1, 2", PATHS)
def _(spark, sf):
    return M.confidence_band(_paths(spark, sf))


@query("montecarlo_sharpe", f"SELECT series_id, {_five('x')} FROM (SELECT series_id, sim, avg(r) / stddev_samp(r) * sqrt(252.0) AS x FROM paths WHERE step > 0 GROUP BY 1, 2 HAVING stddev_samp(r) > 0) GROUP BY 1", PATHS)
def _(spark, sf):
    return M.montecarlo_sharpe(returns_by_priority(spark, sf), SIMS, seed=SEED)


@query("montecarlo_cagr", f"SELECT series_id, {_five('x')} FROM (SELECT series_id, sim, pow(1 + arg_max(v, step), 252.0 / count(*)) - 1 AS x FROM paths GROUP BY 1, 2) GROUP BY 1", PATHS)
def _(spark, sf):
    return M.montecarlo_cagr(returns_by_priority(spark, sf), SIMS, seed=SEED)


# Chart data.


@query("chart_snapshot", f"SELECT series_id, dt, {n6('(g - 1) * 100', 'cumulative')}, {n6('dd * 100', 'drawdown')}, {n6('r * 100', 'daily')} FROM under")
def _(spark, sf):
    return H.snapshot(returns_by_priority(spark, sf))


@query("chart_earnings", f"SELECT *, dt = arg_max(dt, (balance, dt)) OVER (PARTITION BY series_id) AS highest FROM (SELECT series_id, CAST(min(dt) - 1 AS DATE) AS dt, 100000.0::DOUBLE AS balance FROM ret GROUP BY 1 UNION ALL SELECT series_id, dt, round(100000.0 * g + {shift(3)!r}, 3) + 0.0 FROM grown)", digits=3)
def _(spark, sf):
    return H.earnings(returns_by_priority(spark, sf))


@query("chart_returns_sum", f"SELECT series_id, dt, {n6(f'sum(r) OVER {_CUM}', 'value')} FROM ret")
def _(spark, sf):
    return H.cumulative(returns_by_priority(spark, sf), compounded=False)


@query("chart_returns_volatility", f"SELECT series_id, dt, {n6(f'product(1 + r) OVER {_CUM} - 1', 'value')} FROM (SELECT series_id, dt, r / stddev_samp(r) OVER (PARTITION BY series_id) * (SELECT stddev_samp(b) FROM mkt) AS r FROM ret)")
def _(spark, sf):
    return H.cumulative(returns_by_priority(spark, sf), benchmark=market(spark, sf), same_volatility=True)


@query("chart_daily_active", f"SELECT series_id, dt, {n6(f'sum(r - b) OVER {_CUM}', 'value')} FROM both_")
def _(spark, sf):
    return H.daily_active(_both(spark, sf), active=True)


@query("chart_yearly_returns", f"SELECT series_id, dt, {n6('coalesce(r, 0)', 'r')}, {n6('avg(coalesce(r, 0)) OVER (PARTITION BY series_id)', 'mean')} FROM {_bins('YE', 'product(1 + r) - 1')}")
def _(spark, sf):
    return H.period_bars(returns_by_priority(spark, sf))


_BIN = "CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((x - lo) / nullif(w, 0)), {n} - 1) END AS BIGINT)"


def _histogram(rows: str, x: str, n: int) -> str:
    at = _BIN.format(n=n)
    spread = f"max({x}) OVER s - min({x}) OVER s"
    return f"SELECT series_id, {at} AS bin, {n6(f'any_value(lo + {at} * w)', 'low')}, count(*) AS n FROM (SELECT series_id, {x} AS x, min({x}) OVER s AS lo, CASE WHEN {spread} > 1e-9 * greatest(abs(max({x}) OVER s), abs(min({x}) OVER s)) THEN ({spread}) / {n} ELSE 0 END AS w FROM {rows} WINDOW s AS (PARTITION BY series_id)) GROUP BY 1, 2"


@query("chart_histogram", _histogram(_bins("ME", "product(1 + r) - 1"), "coalesce(r, 0)", 20))
def _(spark, sf):
    return H.histogram(returns_by_priority(spark, sf))


@query("chart_returns_resampled", f"SELECT series_id, dt, {n6(f'product(1 + coalesce(r, 0)) OVER {_CUM} - 1', 'value')} FROM {_bins('W-MON', 'product(1 + r) - 1')}")
def _(spark, sf):
    return H.cumulative(returns_by_priority(spark, sf), freq="W-MON")


@query(
    "chart_density",
    f"""SELECT b.series_id, {n6('w.lo + (w.hi - w.lo) * i / 63.0', 'x', 9)}, {n6('sum(exp(-pow((w.lo + (w.hi - w.lo) * i / 63.0 - b.r) / w.h, 2) / 2)) / any_value(w.n * w.h * sqrt(2 * pi()))', 'density', 3)}
FROM bins b JOIN (SELECT series_id, min(r) AS lo, max(r) AS hi, stddev_samp(r) * pow(count(r), -0.2) AS h, count(r) AS n FROM bins GROUP BY 1) w USING (series_id) CROSS JOIN (SELECT unnest(range(0, 64)) AS i) GROUP BY 1, i, w.lo, w.hi""",
    WITH + f", bins AS (SELECT series_id, coalesce(r, 0) AS r FROM {_bins('ME', 'product(1 + r) - 1')})",
    9,
)
def _(spark, sf):
    rows = H.density(returns_by_priority(spark, sf))
    return rows.withColumn("density", F.round(F.col("density") + shift(3), 3) + 0.0)


@query("chart_histogram_both", _histogram(_bins("ME", "product(1 + r) - 1", "(SELECT series_id, dt, r FROM ret UNION ALL SELECT 'Benchmark', dt, b FROM mkt)"), "coalesce(r, 0)", 20))
def _(spark, sf):
    return H.histogram(H.with_benchmark(returns_by_priority(spark, sf), market(spark, sf)))


@query("chart_box_data", f"SELECT series_id, dt, {n6('last_value(r IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY dt ROWS UNBOUNDED PRECEDING)', 'r')} FROM (SELECT series_id, CAST(unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY)) AS DATE) AS dt FROM bins GROUP BY 1) LEFT JOIN bins USING (series_id, dt)", WITH + f", bins AS (SELECT series_id, dt, coalesce(r, 0) AS r FROM {_bins('ME', 'product(1 + r) - 1')})")
def _(spark, sf):
    return H.box_data(returns_by_priority(spark, sf))


@query("chart_tables", "SELECT name, CAST(n AS BIGINT) AS n FROM (SELECT 'snapshot' AS name, count(*) AS n FROM ret UNION ALL SELECT 'heatmap', count(DISTINCT (series_id, year(dt))) FROM ret UNION ALL SELECT 'returns', (SELECT count(*) FROM ret) + (SELECT count(*) FROM mkt) UNION ALL SELECT 'underwater', count(*) FROM ret UNION ALL SELECT 'active', count(*) FROM both_)")
def _(spark, sf):
    tables, counts = H.charts(returns_by_priority(spark, sf), market(spark, sf)), None
    for name in ("snapshot", "heatmap", "returns", "underwater", "active"):
        n = tables[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = n if counts is None else counts.unionByName(n)
    return counts


@query("distribution_rows", " UNION ALL ".join(
        f"SELECT series_id, '{name}' AS period, dt, {n6('r', 'r')}, NOT r BETWEEN q[1] - 1.5 * (q[2] - q[1]) AND q[2] + 1.5 * (q[2] - q[1]) AS outlier FROM (SELECT series_id, dt, coalesce(r, 0) AS r, quantile_cont(coalesce(r, 0), [0.25, 0.75]) OVER (PARTITION BY series_id) AS q FROM {rows})"
        for name, rows in (("Daily", "ret"), ("Weekly", _bins("W-MON", "product(1 + r) - 1")), ("Monthly", _bins("ME", "product(1 + r) - 1")), ("Quarterly", _bins("QE", "product(1 + r) - 1")), ("Yearly", _bins("YE", "product(1 + r) - 1")))
    ))
def _(spark, sf):
    return K.distribution_rows(returns_by_priority(spark, sf))


@query("stacked", f"SELECT series_id, dt, {n6('r', 'r')}, NULL::DOUBLE AS b FROM ret UNION ALL SELECT NULL, dt, NULL, {n6('b', 'b')} FROM mkt")
def _(spark, sf):
    return stack(validate(returns_by_priority(spark, sf)), market(spark, sf))


@query("naive_times", "SELECT event_type AS series_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS dt, count(*) AS n FROM events GROUP BY 1, 2", "")
def _(spark, sf):
    zoned = table(spark, sf, "events").select(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").cast("timestamp").alias("dt"))
    return naive_utc(zoned).groupBy("series_id", "dt").agg(F.count("*").alias("n"))


@query("texts", f"SELECT series_id, CAST(year(dt) AS BIGINT) AS year, {n6('round_even(100 * sum(r) / 0.25, 0) * 0.25', 'rounded')}, CASE WHEN contains(printf('%.1f', 100 * sum(r)), '-') THEN '' ELSE '+' END || printf('%.1f', 100 * sum(r)) AS signed, CASE WHEN n >= 1e3 THEN regexp_replace(printf('%.1f', n / 1e3), '\\.0$', '') || 'K%' ELSE printf('%.0f', n) || '%' END AS label FROM ret JOIN (SELECT o_orderpriority AS series_id, year(o_orderdate) AS y, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2) USING (series_id) WHERE y = year(dt) GROUP BY 1, 2, n")
def _(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.year("o_orderdate").alias("year")).agg(F.count("*").cast("double").alias("n"))
    sums = returns_by_priority(spark, sf).groupBy("series_id", F.year("dt").alias("year")).agg((100 * F.sum("r")).alias("x"))
    return sums.join(counts, ["series_id", "year"]).select("series_id", "year", C.round_to("x", 0.25).alias("rounded"), C.signed(F.format_string("%.1f", F.col("x"))).alias("signed"), C.percent_label("n").alias("label"))


@query("chart_underwater", f"SELECT series_id, dt, {n6('dd', 'dd')}, {n6('avg(dd) OVER (PARTITION BY series_id)', 'mean')} FROM under")
def _(spark, sf):
    return H.underwater(returns_by_priority(spark, sf))


@query("chart_rolling_beta", " UNION ALL ".join(f"SELECT series_id, dt, CAST({n} AS BIGINT) AS \"window\", {n6(_full(f'covar_samp(r, b) OVER {_roll(n)} / nullif(var_samp(b) OVER {_roll(n)}, 0)', n), 'beta')} FROM both_" for n in (126, 252)))
def _(spark, sf):
    return H.rolling_beta(_both(spark, sf))


@query("chart_rolling_lines", f"SELECT series_id, dt, {n6(_RV, 'rolling_volatility')}, {n6(_RS, 'rolling_sharpe')}, {n6(_RT, 'rolling_sortino')} FROM ret")
def _(spark, sf):
    return H.rolling_lines(returns_by_priority(spark, sf))


_HEAT = ", ".join(n6(f"coalesce(product(1 + r) FILTER (month(dt) = {i}) - 1, 0) * 100", m) for i, m in enumerate(K.MONTHS, 1))
_ACTIVE = ", ".join(n6(f"m.c{i} - coalesce(t.c{i}, 0)", m) for i, m in enumerate(K.MONTHS, 1))
_CELLS = lambda c: ", ".join(f"coalesce(product(1 + {c}) FILTER (month(dt) = {i}) - 1, 0) * 100 AS c{i}" for i in range(1, 13))


@query("chart_monthly_heatmap", f"SELECT series_id, CAST(year(dt) AS BIGINT) AS year, {_HEAT} FROM ret GROUP BY 1, 2")
def _(spark, sf):
    return H.monthly_heatmap(returns_by_priority(spark, sf))


@query("chart_active_heatmap", f"SELECT series_id, CAST(year AS BIGINT) AS year, {_ACTIVE} FROM (SELECT series_id, year(dt) AS year, {_CELLS('r')} FROM ret GROUP BY 1, 2) m LEFT JOIN (SELECT year(dt) AS year, {_CELLS('b')} FROM mkt GROUP BY 1) t USING (year)")
def _(spark, sf):
    return H.active_heatmap(returns_by_priority(spark, sf), market(spark, sf))


@query("chart_montecarlo_lines", f"SELECT series_id, step, {n6('quantile_cont(v, 0.025)', 'lower')}, {n6('quantile_cont(v, 0.5)', 'median')}, {n6('quantile_cont(v, 0.975)', 'upper')}, {n6('max(v) FILTER (sim = 0)', 'original')} FROM paths GROUP BY 1, 2", PATHS)
def _(spark, sf):
    return H.montecarlo_lines(_paths(spark, sf))


for _column in ("terminal", "max_dd"):
    query("chart_montecarlo_histogram" + ("_max_dd" if _column == "max_dd" else ""), _histogram("mc", _column, 50), PATHS)(lambda spark, sf, column=_column: H.montecarlo_histogram(_paths(spark, sf), column=column))


@query("labels", """SELECT DISTINCT o_orderpriority AS series_id, CAST(year(o_orderdate) AS BIGINT) AS year, CASE WHEN t >= 1e9 THEN '$' || regexp_replace(printf('%.1f', t / 1e9), '\\.0$', '') || 'B' WHEN t >= 1e6 THEN '$' || regexp_replace(printf('%.1f', t / 1e6), '\\.0$', '') || 'M' WHEN t >= 1e3 THEN '$' || regexp_replace(printf('%.1f', t / 1e3), '\\.0$', '') || 'K' ELSE '$' || printf('%.0f', t) END AS total
FROM (SELECT o_orderpriority, o_orderdate, sum(o_totalprice) OVER (PARTITION BY o_orderpriority, year(o_orderdate)) AS t FROM orders)""", "")
def _(spark, sf):
    sums = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("t"))
    return sums.select("series_id", "year", C.currency_label("t").alias("total"))


# Reports.


@query("hourly_sharpe", f"SELECT event_type AS series_id, {n6('avg(r) / nullif(stddev_samp(r), 0) * sqrt(8760.0)', 'sharpe')} FROM (SELECT event_type, date_trunc('hour', ts) AS h, (avg(value) / 50.0 - 1) * 0.05 AS r FROM events GROUP BY 1, 2) GROUP BY 1", "")
def _(spark, sf):
    return compute(returns_by_event(spark, sf), "sharpe", settings=Settings(periods=8760))


_FLAG = ["n", "sharpe", "sortino", "cagr", "max_drawdown", "value_at_risk", "exposure"]


@query("flagship", f"SELECT series_id, {', '.join(n6(STAT_SQL[n], n) for n in _FLAG[1:])} FROM e GROUP BY 1")
def _(spark, sf):
    return compute(returns_by_priority(spark, sf), *_FLAG[1:])


_LAST = "(SELECT max(dt) FROM ret)"


def _since(x: str) -> str:
    return f"(product(CASE WHEN dt >= {x} THEN 1 + r ELSE 1.0 END) - 1)"


def _ago(months: int) -> str:
    return f"CAST({_LAST} - INTERVAL {months} MONTH AS DATE)"


def _yearly(months: int) -> str:
    return f"(pow(abs({_since(_ago(months))} + 1), 252.0 / nullif(count(*) FILTER (dt >= {_ago(months)}), 0)) - 1)"


@query("horizons", f"""SELECT series_id, {n6(_since(f"date_trunc('month', {_LAST})"), 'mtd')}, {n6(_since(f"date_trunc('year', {_LAST})"), 'ytd')}, {n6(_since(_ago(3)), 'm3')}, {n6(_since(_ago(6)), 'm6')}, {n6(_since(_ago(12)), 'y1')}, {n6(_yearly(35), 'y3')}, {n6(_yearly(59), 'y5')}, {n6(_yearly(120), 'y10')} FROM ret GROUP BY 1""")
def _(spark, sf):
    return T.horizons(returns_by_priority(spark, sf))


def _streak(losses: bool) -> str:
    return _STREAK.format(name="x", sign="<" if losses else ">", rows="ret")


_YEAR, _QUARTER = (f"SELECT series_id, date_trunc('{_p}', dt)::DATE AS period, product(1 + r) - 1 AS r FROM ret GROUP BY 1, 2" for _p in ("year", "quarter"))
_WORST = '(max_dd, "start")'
#: Statistics that no single aggregate over e gives: rows, and what is worked out of them for each series.
METRIC_SQL = {
    "start": ("ret", "min(dt)"), "end": ("ret", "max(dt)"), "rf": ("ret", "0.0"), "total": ("ret", _CG), "dd_date": ("episodes", f"arg_min(valley, {_WORST})"), "dd_start": ("episodes", f'arg_min("start", {_WORST})'), "dd_end": ("episodes", f'arg_min("end", {_WORST})'),
    "longest_days": ("episodes", "max(days)"), "avg_dd": ("episodes", "avg(max_dd)"), "avg_days": ("episodes", "avg(days)"), "r_squared": ("both_", "pow(corr(r, b), 2)"), "correlation": ("both_", "corr(r, b)"), "information_ratio": ("both_", "coalesce(avg(r - b) / nullif(stddev_samp(r - b), 0), 0)"),
    "beta": ("both_", "coalesce(covar_samp(r, b) / nullif(var_samp(b), 0), 0)"), "alpha": ("both_", "coalesce((avg(r) - covar_samp(r, b) / nullif(var_samp(b), 0) * avg(b)) * 252, 0)"), "treynor": ("both_", f"coalesce({_CG} / nullif(covar_samp(r, b) / nullif(var_samp(b), 0), 0), 0)"),
    "expected_monthly": (f"({_MONTH})", STAT_SQL["expected_return"]), "expected_yearly": (f"({_YEAR})", STAT_SQL["expected_return"]), "gain_to_pain_monthly": ("(SELECT series_id, date_trunc('month', dt) AS m, sum(r) AS r FROM ret GROUP BY 1, 2)", STAT_SQL["gain_to_pain_ratio"]),
    "consecutive_wins": (f"({_streak(False)})", "max(x)"), "consecutive_losses": (f"({_streak(True)})", "max(x)"), "mtd": ("ret", _since(f"date_trunc('month', {_LAST})")), "ytd": ("ret", _since(f"date_trunc('year', {_LAST})")), "m3": ("ret", _since(_ago(3))), "m6": ("ret", _since(_ago(6))), "y1": ("ret", _since(_ago(12))), "y3": ("ret", _yearly(35)), "y5": ("ret", _yearly(59)), "y10": ("ret", _yearly(120)),
    "best_month": (f"({_MONTH})", "max(r)"), "worst_month": (f"({_MONTH})", "min(r)"), "best_year": (f"({_YEAR})", "max(r)"), "worst_year": (f"({_YEAR})", "min(r)"), "avg_up_month": (f"({_MONTH})", _AW), "avg_down_month": (f"({_MONTH})", _AL), "win_month": (f"({_MONTH})", _WIN), "win_quarter": (f"({_QUARTER})", _WIN), "win_year": (f"({_YEAR})", _WIN),
}


def _metrics_sql(full: bool, only: bool = False) -> str:
    """The table of metrics, from the same pieces as the single queries; only: no rows but those of single statistics of e."""
    rows = []
    for i, (label, stat, pct, _) in enumerate(x for x in T.LAYOUT if full or not x[3]):
        if stat in STAT_SQL:
            source, x = "e", f"-abs({STAT_SQL[stat]})" if stat in ("value_at_risk", "conditional_value_at_risk") else STAT_SQL[stat]
        elif only or stat not in METRIC_SQL:
            continue
        else:
            source, x = METRIC_SQL[stat]
        shown = "NULL::DOUBLE AS value, x AS date" if stat in T.DATES else f"round(CAST(x AS DOUBLE) * {100.0 if pct else 1.0} + {shift(DIGITS)!r}, {DIGITS}) + 0.0 AS value, NULL::DATE AS date"
        rows.append(f"SELECT series_id, {i}::BIGINT AS ord, '{label}' AS metric, {shown} FROM (SELECT series_id, {x} AS x FROM {source} GROUP BY 1)")
    return " UNION ALL ".join(rows)


@query("metrics_basic_scan", f"SELECT series_id, ord, metric, value FROM ({_metrics_sql(False, only=True)})")
def _(spark, sf):
    rows = T.metrics(returns_by_priority(spark, sf), full=False)
    return rows.where(F.col("metric").isin([label for label, s, _, f in T.LAYOUT if s in STAT_SQL and not f])).drop("date")


@query("metrics_full", _metrics_sql(True), EPISODES)
def _(spark, sf):
    return T.metrics(returns_by_priority(spark, sf), market(spark, sf))


_SIMPLE = ["Total Return %", "CAGR %", "All-time (ann.) %", "Best Month %", "MTD %"]


@query(
    "metrics_simple",
    f"SELECT series_id, metric, {n6('x * 100', 'value')} FROM (" + " UNION ALL ".join(f"SELECT series_id, '{m}' AS metric, {x} AS x FROM {rows} GROUP BY 1" for m, x, rows in (("Total Return %", "sum(r)", "ret"), ("CAGR %", f"pow(abs(sum(r) + 1), 252.0 / {_N}) - 1", "ret"), ("All-time (ann.) %", f"pow(abs(sum(r) + 1), 252.0 / {_N}) - 1", "ret"), ("Best Month %", "max(r)", "(SELECT series_id, date_trunc('month', dt) AS m, sum(r) AS r FROM ret GROUP BY 1, 2)"), ("MTD %", f"sum(CASE WHEN dt >= date_trunc('month', {_LAST}) THEN r ELSE 0 END)", "ret"))) + ")",
)
def _(spark, sf):
    return T.metrics(returns_by_priority(spark, sf), settings=Settings(compounded=False)).where(F.col("metric").isin(_SIMPLE)).select("series_id", "metric", "value")

"""The table of metrics, and reports made from it."""

from __future__ import annotations

import html as _html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import correlation, growth
from ..operators.benchmark import beta
from ..operators.calendar import aggregate_returns, monthly_returns
from ..operators.drawdown import drawdown_summary, longest_drawdowns, to_drawdown_series
from ..operators.filters import match_dates
from ..operators.stats import STATS, Settings, compute, longest_streak, total

#: Fixed values: (name, statistic, whether it is a percentage, full table only), in the order of the table.
LAYOUT = [
    ("Start Period", "start", False, False),
    ("End Period", "end", False, False),
    ("Risk-Free Rate %", "rf", True, False),
    ("Time in Market %", "exposure", True, False),
    ("Cumulative Return %", "total", True, False),
    ("CAGR %", "cagr", True, False),
    ("Sharpe", "sharpe", False, False),
    ("Prob. Sharpe Ratio %", "probabilistic_sharpe_ratio", True, False),
    ("Smart Sharpe", "smart_sharpe", False, True),
    ("Sortino", "sortino", False, False),
    ("Smart Sortino", "smart_sortino", False, True),
    ("Sortino/√2", "adjusted_sortino", False, False),
    ("Smart Sortino/√2", "smart_adjusted_sortino", False, True),
    ("Omega", "omega", False, False),
    ("Max Drawdown %", "max_drawdown", True, False),
    ("Max DD Date", "dd_date", False, False),
    ("Max DD Period Start", "dd_start", False, False),
    ("Max DD Period End", "dd_end", False, False),
    ("Longest DD Days", "longest_days", False, False),
    ("Volatility (ann.) %", "volatility", True, True),
    ("R^2", "r_squared", False, True),
    ("Information Ratio", "information_ratio", False, True),
    ("Calmar", "calmar", False, True),
    ("Skew", "skew", False, True),
    ("Kurtosis", "kurtosis", False, True),
    ("Ulcer Performance Index", "ulcer_performance_index", False, True),
    ("Risk-Adjusted Return %", "rar", True, True),
    ("Risk-Return Ratio", "risk_return_ratio", False, True),
    ("Avg. Return %", "avg_return", True, True),
    ("Avg. Win %", "avg_win", True, True),
    ("Avg. Loss %", "avg_loss", True, True),
    ("Win/Loss Ratio", "payoff_ratio", False, True),
    ("Profit Ratio", "profit_ratio", False, True),
    ("Expected Daily %", "expected_return", True, True),
    ("Expected Monthly %", "expected_monthly", True, True),
    ("Expected Yearly %", "expected_yearly", True, True),
    ("Kelly Criterion %", "kelly_criterion", True, True),
    ("Risk of Ruin %", "risk_of_ruin", True, True),
    ("Daily Value-at-Risk %", "value_at_risk", True, True),
    ("Expected Shortfall (cVaR) %", "conditional_value_at_risk", True, True),
    ("Max Consecutive Wins", "consecutive_wins", False, True),
    ("Max Consecutive Losses", "consecutive_losses", False, True),
    ("Gain/Pain Ratio", "gain_to_pain_ratio", False, False),
    ("Gain/Pain (1M)", "gain_to_pain_monthly", False, False),
    ("Payoff Ratio", "payoff_ratio", False, False),
    ("Profit Factor", "profit_factor", False, False),
    ("Common Sense Ratio", "common_sense_ratio", False, False),
    ("CPC Index", "cpc_index", False, False),
    ("Tail Ratio", "tail_ratio", False, False),
    ("Outlier Win Ratio", "outlier_win_ratio", False, False),
    ("Outlier Loss Ratio", "outlier_loss_ratio", False, False),
    ("MTD %", "mtd", True, False),
    ("3M %", "m3", True, False),
    ("6M %", "m6", True, False),
    ("YTD %", "ytd", True, False),
    ("1Y %", "y1", True, False),
    ("3Y (ann.) %", "y3", True, False),
    ("5Y (ann.) %", "y5", True, False),
    ("10Y (ann.) %", "y10", True, False),
    ("All-time (ann.) %", "cagr", True, False),
    ("Best Day %", "best", True, True),
    ("Worst Day %", "worst", True, True),
    ("Best Month %", "best_month", True, True),
    ("Worst Month %", "worst_month", True, True),
    ("Best Year %", "best_year", True, True),
    ("Worst Year %", "worst_year", True, True),
    ("Avg. Drawdown %", "avg_dd", False, False),
    ("Avg. Drawdown Days", "avg_days", False, False),
    ("Recovery Factor", "recovery_factor", False, False),
    ("Ulcer Index", "ulcer_index", False, False),
    ("Serenity Index", "serenity_index", False, False),
    ("Avg. Up Month %", "avg_up_month", True, True),
    ("Avg. Down Month %", "avg_down_month", True, True),
    ("Win Days %", "win_rate", True, True),
    ("Win Month %", "win_month", True, True),
    ("Win Quarter %", "win_quarter", True, True),
    ("Win Year %", "win_year", True, True),
    ("Beta", "beta", False, True),
    ("Alpha", "alpha", False, True),
    ("Correlation %", "correlation", True, True),
    ("Treynor Ratio %", "treynor", True, True),
]
#: Fixed value: the name of the total where returns are added up.
SIMPLE_TOTAL = "Total Return %"
DATES = ("start", "end", "dd_date", "dd_start", "dd_end")
#: Months back from the last date, and whether the return is brought to a year.
HORIZONS = {"m3": (3, False), "m6": (6, False), "y1": (12, False), "y3": (35, True), "y5": (59, True), "y10": (120, True)}


def trading_periods(periods: int = 252) -> tuple[int, int]:
    """(periods of a year, of half a year)."""
    return periods, -(-periods // 2)


def horizons(returns: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(series_id, mtd, ytd, m3 ...): returns since dates counted back from the last date of all series."""
    last = returns.agg(F.max("dt").alias("_last"))  # one row
    r = F.col("r")
    since_then = lambda on: (F.product(F.when(on, 1 + r).otherwise(1.0)) - 1) if settings.compounded else F.sum(F.when(on, r).otherwise(0.0))
    since = {"mtd": F.col("dt") >= F.trunc("_last", "month"), "ytd": F.col("dt") >= F.trunc("_last", "year")}
    out = [since_then(on).alias(name) for name, on in since.items()]
    for name, (months, yearly) in HORIZONS.items():
        on = F.col("dt") >= F.add_months("_last", -months)
        value = F.pow(F.abs(since_then(on) + 1), F.try_divide(F.lit(float(settings.periods)), F.count_if(on))) - 1 if yearly else since_then(on)
        out.append(value.alias(name))
    return returns.join(F.broadcast(last)).groupBy("series_id").agg(*out)


def metric_columns(returns: DataFrame, benchmark: DataFrame | None = None, settings: Settings = Settings(), full: bool = True) -> DataFrame:
    """One row for each series with a column for each statistic of LAYOUT that is wanted."""
    own = sorted({s for _, s, _, f in LAYOUT if s in STATS and (full or not f)})
    out = compute(returns, *own, settings=settings)
    plain = returns.groupBy("series_id").agg(F.min("dt").cast("date").alias("start"), F.max("dt").cast("date").alias("end"), F.lit(float(settings.rf)).alias("rf"), total(settings).alias("total"))
    monthly = aggregate_returns(returns, "month", settings.compounded)
    m = lambda c: F.avg(F.when(c, F.col("r")))
    months = monthly.groupBy("series_id").agg(
        (F.try_divide(F.sum("r"), F.abs(F.coalesce(F.sum(F.when(F.col("r") < 0, F.col("r"))), F.lit(0.0))))).alias("_gp"), F.max("r").alias("best_month"), F.min("r").alias("worst_month"),
        m(F.col("r") > 0).alias("avg_up_month"), m(F.col("r") < 0).alias("avg_down_month"), STATS["win_rate"](settings).alias("win_month"), (F.pow(growth(), F.lit(1.0) / F.count("r")) - 1).alias("expected_monthly"),
    )
    pain = returns.groupBy("series_id", F.trunc("dt", "month").alias("_m")).agg(F.sum("r").alias("r")).groupBy("series_id").agg(STATS["gain_to_pain_ratio"](settings).alias("gain_to_pain_monthly"))
    years = aggregate_returns(returns, "year", settings.compounded).groupBy("series_id").agg(F.max("r").alias("best_year"), F.min("r").alias("worst_year"), STATS["win_rate"](settings).alias("win_year"), (F.pow(growth(), F.lit(1.0) / F.count("r")) - 1).alias("expected_yearly"))
    quarters = aggregate_returns(returns, "quarter", settings.compounded).groupBy("series_id").agg(STATS["win_rate"](settings).alias("win_quarter"))
    worst = [F.col(c).cast("date").alias(name) for c, name in (("valley", "dd_date"), ("start", "dd_start"), ("end", "dd_end"))]
    episodes = drawdown_summary(to_drawdown_series(returns)).select("series_id", *worst, "longest_days", "avg_dd", "avg_days")
    parts = [plain, months.drop("_gp"), pain, years, quarters, episodes, horizons(returns, settings), longest_streak(returns), longest_streak(returns, losses=True)]
    if benchmark is not None:
        both = returns.join(benchmark, "dt")
        d = F.col("r") - F.col("b")
        c = correlation("r", "b")
        parts.append(both.groupBy("series_id").agg((c * c).alias("r_squared"), c.alias("correlation"), F.coalesce(F.try_divide(F.avg(d), F.stddev_samp(d)), F.lit(0.0)).alias("information_ratio"), F.coalesce(beta(), F.lit(0.0)).alias("beta"), F.coalesce((F.avg("r") - beta() * F.avg("b")) * settings.periods, F.lit(0.0)).alias("alpha"), F.coalesce(F.try_divide(growth() - 1 - settings.rf, beta()), F.lit(0.0)).alias("treynor")))
    for part in parts:
        out = out.join(part, "series_id", "left")
    return out


def metrics(returns: DataFrame, benchmark: DataFrame | None = None, settings: Settings = Settings(), full: bool = True) -> DataFrame:
    """(series_id, ord, metric, value, date): the table of metrics, percentages times 100; risk in percent below 0.

    Rows that are dates have them in date and a null value.
    """
    wide = metric_columns(returns, benchmark, settings, full)
    shown = [(SIMPLE_TOTAL if s == "total" and not settings.compounded else name, s, pct) for name, s, pct, f in LAYOUT if (full or not f) and s in wide.columns]
    value = lambda s, pct: (-F.abs(F.col(s)) if s in ("value_at_risk", "conditional_value_at_risk") else F.col(s).cast("double")) * (100.0 if pct else 1.0)
    cell = lambda s, pct: (F.lit(None).cast("double").alias("value"), F.col(s).alias("date")) if s in DATES else (value(s, pct).alias("value"), F.lit(None).cast("date").alias("date"))
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(name).alias("metric"), *cell(s, pct)) for i, (name, s, pct) in enumerate(shown))))
    return wide.select("series_id", rows.alias("m")).select("series_id", "m.*")


def basic(returns: DataFrame, benchmark: DataFrame | None = None, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Tables of the short report."""
    return {"metrics": metrics(returns, benchmark, settings, full=False), "monthly": monthly_returns(returns, compounded=settings.compounded)}


def full(returns: DataFrame, benchmark: DataFrame | None = None, settings: Settings = Settings(), worst: int = 5) -> dict[str, DataFrame]:
    """Tables of the long report: metrics, worst drawdowns, months and years."""
    return basic(returns, benchmark, settings) | {"metrics": metrics(returns, benchmark, settings), "drawdowns": longest_drawdowns(to_drawdown_series(returns), worst), "years": aggregate_returns(returns, "year", settings.compounded)}


def parameters(settings: Settings = Settings(), benchmark: str | None = None) -> dict[str, str]:
    """What a report was made with."""
    shown = {"Benchmark": benchmark or "-", "Periods/Year": f"{settings.periods:g}", "Risk-Free Rate": f"{settings.rf:.1%}", "Compounded": "Yes" if settings.compounded else "No"}
    return {k: v for k, v in shown.items() if k != "Benchmark" or benchmark}


def html_table(rows: list, columns: list[str]) -> str:
    cell = lambda v: "-" if v is None else f"{v:,.2f}" if isinstance(v, float) else _html.escape(str(v))
    head = "".join(f"<th>{_html.escape(c)}</th>" for c in columns)
    return f"<table><thead><tr>{head}</tr></thead><tbody>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows) + "</tbody></table>"


def polyline(*lines: list[tuple[float, float]], width: int = 640, height: int = 160) -> str:
    """SVG lines on common axes; all but the first are dashed."""
    points = [p for line in lines for p in line]
    if not points:
        return ""
    xs, ys = zip(*points)
    sx, sy = (max(xs) - min(xs)) or 1, (max(ys) - min(ys)) or 1
    at = lambda line: " ".join(f"{(x - min(xs)) / sx * width:.1f},{height - (y - min(ys)) / sy * height:.1f}" for x, y in line)
    drawn = "".join(f'<polyline fill="none" stroke="currentColor"{" stroke-dasharray=\'4\'" * (k > 0)} points="{at(line)}"/>' for k, line in enumerate(lines) if line)
    return f'<svg viewBox="0 0 {width} {height}">{drawn}</svg>'


def html(returns: DataFrame, series: str, benchmark: DataFrame | None = None, settings: Settings = Settings(), title: str = "Strategy Tearsheet", output: str | None = None, worst: int = 10) -> str:
    """Tear sheet of one series, beside a benchmark (dt, b) on the dates from which both have returns.

    The driver gets its metrics, its worst drawdowns, and a row for each month and year.
    """
    own = returns.where(F.col("series_id") == series)
    facts, both = parameters(settings), [own]
    if benchmark is not None:
        own, benchmark = match_dates(own, benchmark)
        both = [own, benchmark.select(F.lit("Benchmark").alias("series_id"), "dt", F.col("b").alias("r"))]
        facts |= {"Dates": "matched"}
    table = {}
    for k, rows in enumerate(both):
        for name, value, date in metrics(rows, benchmark if k == 0 else None, settings).orderBy("ord").select("metric", "value", "date").collect():
            table.setdefault(name, [None] * len(both))[k] = date if value is None else value
    deep = longest_drawdowns(to_drawdown_series(own), worst).orderBy("rank").select("start", "valley", "end", "days", "max_dd").collect()
    years, lines = {}, []
    for k, rows in enumerate(both):
        level, line = 1.0, []
        for i, row in enumerate(aggregate_returns(rows, "month", settings.compounded).orderBy("period").collect()):
            level = level * (1 + row["r"]) if settings.compounded else level + row["r"]
            line.append((i, level))
        lines.append(line)
        for year, r in aggregate_returns(rows, "year", settings.compounded).select(F.year("period"), F.col("r") * 100).collect():
            years.setdefault(year, [None] * len(both))[k] = r
    names = [series, "Benchmark"][: len(both)]
    shown = " · ".join(f"{k}: {v}" for k, v in facts.items())
    parts = [f"<h1>{_html.escape(title)}</h1><p>{_html.escape(series)} · {shown}</p>", polyline(*lines), "<h2>Metrics</h2>", html_table([(k, *v) for k, v in table.items()], ["Metric", *names]), "<h2>Years (%)</h2>", html_table([(str(y), *years[y]) for y in sorted(years)], ["Year", *names]), "<h2>Worst drawdowns</h2>", html_table(deep, ["Start", "Valley", "End", "Days", "Max %"])]
    page = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{_html.escape(title)}</title></head><body>{''.join(parts)}</body></html>"
    if output:
        with open(output, "w", encoding="utf-8") as f:
            f.write(page)
    return page

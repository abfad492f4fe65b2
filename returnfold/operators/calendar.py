"""Grouping by calendar periods: occupied groups, and bins with empty ones between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import growth, running

#: Names of period lengths, old ones and new ones.
ALIASES = {"D": "D", "W": "W-MON", "W-MON": "W-MON", "M": "ME", "ME": "ME", "Q": "QE", "QE": "QE", "A": "YE", "Y": "YE", "YE": "YE"}
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def frequency(name: str) -> str:
    """The present name of a period length."""
    return ALIASES.get(name, name)


def period_key(period: str, dt: str = "dt") -> Column | None:
    """Group of a date: a calendar year, quarter, month or ISO week, as its first day; month_of_year and quarter_of_year pool the years; None for days."""
    d = F.to_date(dt)
    names = {"year": "year", "YE": "year", "eoy": "year", "yoy": "year", "quarter": "quarter", "QE": "quarter", "eoq": "quarter", "month": "month", "ME": "month", "eom": "month", "week": "week", "W": "week", "eow": "week"}
    if period in names:
        return F.trunc(d, names[period])
    return {"month_of_year": F.month(d), "quarter_of_year": F.quarter(d)}.get(period)


def period_end(freq: str, dt: str = "dt") -> Column:
    """Last day of the bin of a date; weeks end on Mondays."""
    d, freq = F.to_date(dt), frequency(freq)
    return {
        "D": d,
        "W-MON": F.next_day(F.date_sub(d, 1), "Mon"),
        "ME": F.last_day(d),
        "QE": F.last_day(F.add_months(F.trunc(d, "quarter"), 2)),
        "YE": F.last_day(F.add_months(F.trunc(d, "year"), 11)),
    }[freq]


def _total(compounded: bool) -> Column:
    return growth() - 1 if compounded else F.sum("r")


def group_returns(returns: DataFrame, key: Column, compounded: bool = False) -> DataFrame:
    """(series_id, period, r) for any key."""
    return returns.groupBy("series_id", key.alias("period")).agg(_total(compounded).alias("r"))


def aggregate_returns(returns: DataFrame, period: str | Column | None = None, compounded: bool = True) -> DataFrame:
    """(series_id, period, r) for periods that have rows; days, or an unknown period, give the rows themselves."""
    key = period if isinstance(period, Column) else period_key(period or "day")
    if key is None:
        return returns.select("series_id", F.col("dt").alias("period"), "r")
    return group_returns(returns, key, compounded)


def spine(df: DataFrame, freq: str = "D") -> DataFrame:
    """(series_id, dt): the end of every bin from each series' first to its last."""
    step = {"D": "interval 1 day", "W-MON": "interval 7 days", "ME": "interval 1 month", "QE": "interval 3 months", "YE": "interval 1 year"}[frequency(freq)]
    ends = df.groupBy("series_id").agg(F.min(period_end(freq)).alias("lo"), F.max(period_end(freq)).alias("hi"))
    days = F.explode(F.sequence("lo", "hi", F.expr(step)))
    return ends.select("series_id", days.alias("dt")).withColumn("dt", F.col("dt") if frequency(freq) in ("D", "W-MON") else F.last_day("dt"))


def resample(df: DataFrame, freq: str, how: str | Column = "sum", value: str = "r", empty: float | None = None) -> DataFrame:
    """(series_id, dt, value) for every bin, also those without rows, which get `empty`; how: an aggregate's name, comp, or a column."""
    named = {"comp": growth(value) - 1, "last": F.max_by(value, "dt"), "first": F.min_by(value, "dt"), "sum": F.sum(value), "mean": F.avg(value), "std": F.stddev_samp(value), "min": F.min(value), "max": F.max(value), "count": F.count(value), "prod": F.product(value)}
    agg = named[how] if isinstance(how, str) else how
    binned = df.groupBy("series_id", period_end(freq).alias("_end")).agg(agg.alias(value)).withColumnRenamed("_end", "dt")
    out = spine(df, freq).join(binned, ["series_id", "dt"], "left")
    return out if empty is None else out.withColumn(value, F.coalesce(value, F.lit(empty)))


def as_frequency(df: DataFrame, freq: str = "D") -> DataFrame:
    """The rows that stand on a bin's end, nulls for the other bins."""
    return spine(df, freq).join(df, ["series_id", "dt"], "left")


def filled_daily(df: DataFrame, value: str = "r") -> DataFrame:
    """Every calendar day, with the last value known."""
    return as_frequency(df, "D").withColumn(value, F.last(value, True).over(running()))


def monthly_returns(returns: DataFrame, eoy: bool = True, compounded: bool = True) -> DataFrame:
    """(series_id, year, JAN to DEC, EOY): months without rows are 0."""
    months = returns.groupBy("series_id", F.year("dt").alias("year"), F.month("dt").alias("m")).agg(_total(compounded).alias("r"))
    out = months.groupBy("series_id", "year").pivot("m", list(range(1, 13))).agg(F.first("r"))
    out = out.select("series_id", "year", *(F.coalesce(F.col(f"`{i}`"), F.lit(0.0)).alias(name) for i, name in enumerate(MONTHS, 1)))
    if not eoy:
        return out
    years = returns.groupBy("series_id", F.year("dt").alias("year")).agg(_total(compounded).alias("EOY"))
    return out.join(years, ["series_id", "year"])


def distribution_rows(returns: DataFrame, compounded: bool = True) -> DataFrame:
    """(series_id, period, dt, r, outlier) of days, weeks, months, quarters and years: outliers lie beyond 1.5 quartile ranges.

    Quartiles come from a count of each value, which is summed up before rows move.
    """
    out = None
    for name, freq in (("Daily", None), ("Weekly", "W-MON"), ("Monthly", "ME"), ("Quarterly", "QE"), ("Yearly", "YE")):
        rows = returns.select("series_id", "dt", "r") if freq is None else resample(returns, freq, "comp" if compounded else "sum", empty=0.0)
        part = rows.select("series_id", F.lit(name).alias("period"), "dt", "r")
        out = part if out is None else out.unionByName(part)
    q = F.percentile("r", F.array(F.lit(0.25), F.lit(0.75)))
    fences = out.groupBy("series_id", "period").agg(q.alias("q"))
    width = 1.5 * (F.col("q")[1] - F.col("q")[0])
    inside = (F.col("r") >= F.col("q")[0] - width) & (F.col("r") <= F.col("q")[1] + width)
    return out.join(fences, ["series_id", "period"]).select("series_id", "period", "dt", "r", (~inside).alias("outlier"))


def distribution(returns: DataFrame, compounded: bool = True) -> DataFrame:
    """(series_id, period, values, outliers): the rows of distribution_rows() as lists, for series short enough to be drawn."""
    rows = distribution_rows(returns, compounded)
    listed = lambda on: F.array_sort(F.collect_list(F.when(on, F.struct("dt", "r"))))
    lists = rows.groupBy("series_id", "period").agg(listed(~F.col("outlier")).alias("v"), listed(F.col("outlier")).alias("o"))
    return lists.select("series_id", "period", F.col("v.r").alias("values"), F.col("o.r").alias("outliers"))

"""Choosing rows by value or date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import whole
from .quantile import quantiles


def _beside_quantile(returns: DataFrame, q: float) -> DataFrame:
    """returns with _q, the exact quantile of the row's series, however long that is."""
    found = quantiles(returns, ["series_id"], "r", [q])
    return returns.alias("r").join(found.alias("q"), F.expr("r.series_id <=> q.series_id")).select("r.*", F.col("q.q")[0].alias("_q"))


def outliers(returns: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Rows above the series' quantile."""
    return _beside_quantile(returns, quantile).where("r > _q").drop("_q")


def remove_outliers(returns: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Rows below the series' quantile."""
    return _beside_quantile(returns, quantile).where("r < _q").drop("_q")


def _as_of(day) -> Column:
    return F.current_date() if day is None else F.lit(day).cast("date")


def since(df: DataFrame, unit: str, as_of=None) -> DataFrame:
    """Rows from the start of as_of's month, quarter or year (today's, if not given)."""
    return df.where(F.col("dt") >= F.trunc(_as_of(as_of), unit))


def month_to_date(df: DataFrame, as_of=None) -> DataFrame:
    return since(df, "month", as_of)


def quarter_to_date(df: DataFrame, as_of=None) -> DataFrame:
    return since(df, "quarter", as_of)


def year_to_date(df: DataFrame, as_of=None) -> DataFrame:
    return since(df, "year", as_of)


def current_month(df: DataFrame, as_of=None) -> DataFrame:
    """Rows of as_of's month up to as_of."""
    return month_to_date(df, as_of).where(F.to_date("dt") <= _as_of(as_of))


def on_dates(df: DataFrame, dates) -> DataFrame:
    """Rows of these dates: one, some, or a DataFrame with dt."""
    if isinstance(dates, DataFrame):
        return df.join(dates.select("dt").distinct(), "dt", "left_semi")
    return df.where(F.col("dt").isin(list(dates) if isinstance(dates, (list, tuple, set)) else [dates]))


def match_dates(returns: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(returns, benchmark (dt, b)): each series from the later of its and the benchmark's first date that is not 0."""
    first_b = benchmark.agg(F.min(F.when(F.col("b") != 0, F.col("dt"))).alias("first_b"))
    first = F.min(F.when(F.col("r") != 0, F.col("dt"))).over(whole())
    both = returns.withColumn("_first", first).join(F.broadcast(first_b))  # one row
    kept = both.where(F.col("dt") >= F.greatest("_first", "first_b")).select(*returns.columns)
    start = kept.agg(F.min("dt").alias("start"))  # one row
    return kept, benchmark.join(F.broadcast(start)).where("dt >= start").drop("start")

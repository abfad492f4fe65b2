"""Measures of a series against a benchmark (dt, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import correlation, growth, ratio
from .calendar import period_key
from .scan import BLOCK, blocks, in_block, in_blocks, out_of_blocks, running_growth


def benchmark_prices(benchmark: DataFrame) -> DataFrame:
    """(series_id, dt, p) for each day from a benchmark's first to its last date: the price of the next date that it has.

    The growth of 1 and the date before are found in blocks of time; a block's first row takes the last date of the blocks
    before it. A row then stands for the days since the date before.
    """
    grown = running_growth(benchmark.select("series_id", F.to_date("dt").alias("dt"), F.coalesce("b", F.lit(0.0)).alias("b")), "p", "b")
    rows = in_blocks(grown).withColumn("_prev", F.lag("dt").over(in_block()))
    carried = rows.groupBy(BLOCK).agg(F.max("dt").alias("_end")).select(BLOCK, F.lag("_end").over(blocks()).alias("_before"))
    first = F.coalesce(F.date_add(F.coalesce("_prev", "_before"), 1), F.col("dt"))
    return out_of_blocks(rows.join(carried, BLOCK), ["series_id"], {"p": F.col("p"), "dt": F.explode(F.sequence(F.least(first, F.col("dt")), F.col("dt")))})


def align_benchmark(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(series_id, dt, r, b): the benchmark's return over each of the series' own steps.

    benchmark has (dt, b), or (series_id, dt, b) if each series has its own. It becomes prices; a date that it lacks takes
    the next later price, as in a backward fill; the return is from one date of the series to its next. Spark broadcasts
    the prices if they are small.
    """
    own = "series_id" in benchmark.columns
    prices = benchmark_prices(benchmark if own else benchmark.withColumn("series_id", F.lit("")))
    key = ["series_id", "dt"] if own else ["dt"]
    joined = in_blocks(returns.join(prices.select(*key, "p"), key, "left").select("series_id", "dt", "r", "p"))
    rows = joined.withColumns({"_lag": F.lag("p").over(in_block()), "_first": F.row_number().over(in_block()) == 1})
    carried = rows.groupBy(BLOCK).agg(F.max_by("p", "dt").alias("_end")).select(BLOCK, F.lag("_end").over(blocks()).alias("_before"))
    before = F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag"))
    return out_of_blocks(rows.join(carried, BLOCK), ["series_id", "dt", "r"], {"b": F.coalesce(ratio(F.col("p"), before) - 1, F.lit(0.0))})


def on_common_dates(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(series_id, dt, r, b) on dates that both have."""
    return returns.join(benchmark, "dt").select("series_id", "dt", "r", "b")


def beta():
    return ratio(F.covar_samp("r", "b"), F.var_samp("b"))


def greeks(joined: DataFrame, periods: float = 252.0) -> DataFrame:
    """(series_id, beta, alpha); 0 where undefined."""
    rows = joined.groupBy("series_id").agg(beta().alias("beta"), F.avg("r").alias("_r"), F.avg("b").alias("_b"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select("series_id", zero(F.col("beta")).alias("beta"), zero((F.col("_r") - F.col("beta") * F.col("_b")) * periods).alias("alpha"))


def r_squared(joined: DataFrame) -> DataFrame:
    c = correlation("r", "b")
    return joined.groupBy("series_id").agg((c * c).alias("r_squared"))


r2 = r_squared


def information_ratio(joined: DataFrame) -> DataFrame:
    """Mean over deviation of the difference, 0 where it has none."""
    d = F.col("r") - F.col("b")
    return joined.groupBy("series_id").agg(F.coalesce(ratio(F.avg(d), F.stddev_samp(d)), F.lit(0.0)).alias("information_ratio"))


def treynor_ratio(joined: DataFrame, rf: float = 0.0) -> DataFrame:
    """Total return less rf, over beta; 0 where beta is 0."""
    return joined.groupBy("series_id").agg(F.coalesce(ratio(growth() - 1 - rf, beta()), F.lit(0.0)).alias("treynor_ratio"))


def compare(returns: DataFrame, benchmark: DataFrame, period: str | None = None, compounded: bool = True, digits: int | None = None) -> DataFrame:
    """(series_id, period, benchmark, returns, multiplier, won) by period, in percent; benchmark on its own dates."""
    total = lambda c: (growth(c) - 1 if compounded else F.sum(c)) * 100
    key = period_key(period or "day")
    key = F.col("dt") if key is None else key
    mine = returns.groupBy("series_id", key.alias("period")).agg(total("r").alias("returns"))
    theirs = benchmark.groupBy(key.alias("period")).agg(total("b").alias("benchmark"))
    grid = returns.select("series_id").distinct().join(theirs)  # every series has every period of the benchmark
    out = grid.join(mine, ["series_id", "period"], "full_outer")
    won = F.when(F.col("returns") >= F.col("benchmark"), "+").otherwise("-")
    out = out.select("series_id", "period", "benchmark", "returns", ratio(F.col("returns"), F.col("benchmark")).alias("multiplier"), won.alias("won"))
    return out if digits is None else out.withColumns({c: F.round(c, digits) for c in ("benchmark", "returns", "multiplier")})

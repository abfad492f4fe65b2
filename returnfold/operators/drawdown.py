"""Drawdown series, episodes and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ordered, whole
from .quantile import quantiles
from .scan import BLOCK, before, blocks, growth_and_peak, in_block, in_blocks, inside, out_of_blocks, running_max


def price_drawdowns(prices: DataFrame, guess_baseline: bool = False, block: Column | None = None) -> DataFrame:
    """(series_id, dt, dd): price over the highest so far, less 1.

    The first peak is the first price; guess_baseline takes it from the size of that price instead, as 100000, 100 or 1.
    """
    rows = running_max(prices, "_peak", "p", block)
    peak = F.col("_peak")
    if guess_baseline:
        first = prices.groupBy("series_id").agg(F.min_by("p", "dt").alias("_first"))
        rows = rows.alias("r").join(first.alias("f"), F.expr("r.series_id <=> f.series_id")).select("r.*", "f._first")
        least = F.when(F.col("_first") > 1000, 1e5).when(F.col("_first") > 10, 100.0).otherwise(1.0)
        peak = F.greatest(peak, least)
    return rows.select("series_id", "dt", F.coalesce(F.try_divide(F.col("p"), peak) - 1, F.lit(0.0)).alias("dd"))


def to_drawdown_series(returns: DataFrame, carry: tuple[str, ...] = (), block: Column | None = None) -> DataFrame:
    """(series_id, dt, dd): growth of 1 over the highest so far (1 at least), less 1."""
    grown = growth_and_peak(returns, "_g", "_peak", block=block)
    return grown.select("series_id", "dt", *carry, (F.col("_g") / F.greatest("_peak", F.lit(1.0)) - 1).alias("dd"))


def max_drawdown(returns: DataFrame) -> DataFrame:
    return to_drawdown_series(returns).groupBy("series_id").agg(F.min("dd").alias("max_drawdown"))


def episodes(drawdowns: DataFrame, block: Column | None = None) -> DataFrame:
    """(series_id, dt, dd, episode) of the rows under water: episode numbers the runs of a series from 1.

    Runs are found block by block. A run that is open to the left, in a block before which the last row was
    under water, goes on with the last episode of the blocks before; so only a block's number of runs and its
    first and last row are scanned along the series.
    """
    under = F.col("dd") != 0
    rows = in_blocks(drawdowns.select("series_id", "dt", "dd"), block).withColumn("_under", under)
    starts = F.col("_under") & ~F.coalesce(F.lag("_under").over(in_block()), F.lit(False))
    rows = rows.withColumn("_start", starts.cast("long")).withColumn("_run", F.sum("_start").over(inside()))
    totals = rows.groupBy(BLOCK).agg(F.sum("_start").alias("runs"), F.min_by("_under", "dt").alias("first"), F.max_by("_under", "dt").alias("last"))
    goes_on = (F.col("first") & F.coalesce(F.lag("last").over(blocks()), F.lit(False))).cast("long")
    carried = totals.withColumn("_on", goes_on)
    carried = carried.select(BLOCK, (F.coalesce(F.sum(F.col("runs") - F.col("_on")).over(before()), F.lit(0)) - F.col("_on")).alias("_past"))
    return out_of_blocks(rows.where("_under").join(carried, BLOCK), ["series_id", "dt", "dd"], {"episode": F.col("_past") + F.col("_run")})


def drawdown_details(drawdowns: DataFrame, block: Column | None = None, counted: bool = False) -> DataFrame:
    """(series_id, episode, start, valley, end, days, max_dd, max_dd_99): a row for each run of rows under water.

    end is the last row under water, days count both ends. max_dd_99, in percent like max_dd, leaves out
    the deepest rows, at or beyond the 99 % quantile; null where none are left. Its rows are put in order
    episode by episode, which a task does on disk if it must; counted finds the quantile by counts of cells
    instead, so that one very long episode is many tasks', at the price of more passes.
    """
    rows = episodes(drawdowns, block)
    depth = -F.col("dd")
    if counted:
        deep = quantiles(rows.withColumn("_depth", depth), ["series_id", "episode"], "_depth", [0.99])
        rows = rows.alias("r").join(deep.alias("d"), F.expr("r.series_id <=> d.series_id and r.episode = d.episode")).select("r.*", F.col("d.q")[0].alias("q"))
    else:
        each = whole("series_id", "episode")
        h = (F.count("*").over(each) - 1) * 0.99
        rank = F.row_number().over(each.orderBy(depth)) - 1
        at = lambda k: F.max(F.when(F.col("_rank") == k, depth)).over(each)
        rows = rows.withColumns({"_h": h, "_rank": rank})
        low, high = at(F.floor("_h")), at(F.ceil("_h"))
        rows = rows.withColumn("q", low + (F.col("_h") - F.floor("_h")) * (high - low))
    return rows.groupBy("series_id", "episode").agg(
        F.min("dt").alias("start"),
        F.min_by("dt", F.struct("dd", "dt")).alias("valley"),
        F.max("dt").alias("end"),
        (F.datediff(F.max("dt"), F.min("dt")) + 1).cast("long").alias("days"),
        (F.min("dd") * 100).alias("max_dd"),
        (F.min(F.when(depth < F.col("q"), F.col("dd"))) * 100).alias("max_dd_99"),
    )


def longest_drawdowns(drawdowns: DataFrame, n: int = 5) -> DataFrame:
    """The n longest episodes of each series, with their rank."""
    order = ordered(by="days").orderBy(F.desc("days"), "start")
    return drawdown_details(drawdowns).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def drawdown_summary(drawdowns: DataFrame) -> DataFrame:
    """(series_id, max_dd, valley, start, end, longest_days, avg_dd, avg_days) over each series' episodes."""
    worst = F.struct("max_dd", "start")
    return drawdown_details(drawdowns).groupBy("series_id").agg(
        F.min("max_dd").alias("max_dd"),
        *(F.min_by(c, worst).alias(c) for c in ("valley", "start", "end")),
        F.max("days").alias("longest_days"),
        F.avg("max_dd").alias("avg_dd"),
        F.avg("days").alias("avg_days"),
    )

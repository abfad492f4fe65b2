"""Monte Carlo by permutation: every simulated path has a series' returns in another order.

The order is a keyed permutation of 0 .. n - 1 in whole numbers, so a row's place in a path is worked out
where the row is, and a seed gives the same paths at any parallelism, in any engine. It is a swap-or-not
shuffle: each round has a key k below n, which pairs place x with (k - x) mod n, and a bit of the pair, by a
hash of its larger place, says whether the two swap. That is one-to-one for every n. Path 0 is the series
itself. Paths are dealt by (series, path), so more paths need more tasks, not larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import growth, ordered
from .quantile import quantiles

ROUNDS = 6
#: Modulus of all hashes, so that no product of two of them leaves 63 bits.
PRIME = (1 << 31) - 1
#: A prime above every n, so that steps of it reach every place.
STRIDE = 2147483629
#: Values of a group that a quantile may hold at once; with more paths, they are counted in cells.
BUFFER = 100_000


def _mixed(x: Column, shift: int, factor: int) -> Column:
    return (x.bitwiseXOR(F.shiftright(x, shift)) * factor) % PRIME


def shuffled(df: DataFrame, place: str, n: str, sim: str, seed: int, name: str = "step") -> DataFrame:
    """df with name: where the permutation of 0 .. n - 1 that sim and seed choose sends place; sim 0 leaves it. n is below PRIME.

    All is one stretch of generated code, which the JVM compiles only while it is short; hence few rounds, after a step by
    STRIDE and a turn that tear neighbours apart.
    """
    key = lambda r: (F.col(sim) * 48271 + ((seed * 69621 + r * 1298837 + 12345) % PRIME)) % PRIME
    out = df.withColumn("_z", key(ROUNDS)).withColumn("_x", (F.col(place) * STRIDE + _mixed(F.col("_z"), 13, 40692)) % F.col(n))
    for r in range(ROUNDS):
        out = out.withColumn("_z", key(r)).withColumn("_z", _mixed(F.col("_z"), 13, 40692))
        out = out.withColumn("_y", (F.col("_z") % F.col(n) - F.col("_x") + F.col(n)) % F.col(n))
        out = out.withColumn("_t", (F.greatest("_x", "_y") * 16807 + F.col("_z")) % PRIME)
        bit = F.shiftright(_mixed(F.col("_t"), 15, 1103515245), 11).bitwiseAND(F.lit(1))
        out = out.withColumn("_x", F.when(bit == 1, F.col("_y")).otherwise(F.col("_x")))
    return out.withColumn(name, F.when(F.col(sim) == 0, F.col(place)).otherwise(F.col("_x"))).drop("_x", "_y", "_z", "_t")


def paths(returns: DataFrame, sims: int = 1000, seed: int = 0) -> DataFrame:
    """(series_id, sim, step, r, v): v is the path's compounded return up to step (from 0). Rows without a return are left out."""
    w = ordered()
    rows = returns.where("r is not null and not isnan(r)").select("series_id", "r", (F.row_number().over(w) - 1).cast("long").alias("i"), F.count("*").over(Window.partitionBy("series_id")).alias("n"))
    each = rows.select("series_id", "i", "n", "r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sims - 1).cast("long"))).alias("sim"))
    placed = shuffled(each.repartition("series_id", "sim"), "i", "n", "sim", seed).select("series_id", "sim", "step", "r")
    path = Window.partitionBy("series_id", "sim").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    # step comes out of the window, so that a caller's condition on it is not pushed into the rounds, which it would multiply
    return placed.select("series_id", "sim", F.max("step").over(path).alias("step"), "r", (growth().over(path) - 1).alias("v"))


def quantile_paths(simulated: DataFrame, probabilities: list[float], sims: int = 1000) -> DataFrame:
    """(series_id, step, q): quantiles over the paths, step by step. sims says how many paths there are: up to BUFFER of them, a group's values are held at once."""
    if sims > BUFFER:
        return quantiles(simulated, ["series_id", "step"], "v", probabilities)
    return simulated.groupBy("series_id", "step").agg(F.percentile("v", F.array(*map(F.lit, probabilities))).alias("q"))


def path_summary(simulated: DataFrame) -> DataFrame:
    """(series_id, sim, terminal, max_dd): max_dd is against the path's own highest point, not the start."""
    w = Window.partitionBy("series_id", "sim").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    dd = simulated.withColumn("g", 1 + F.col("v")).withColumn("dd", F.try_divide(F.col("g"), F.max("g").over(w)) - 1)
    return dd.groupBy("series_id", "sim").agg(F.max_by("v", "step").alias("terminal"), F.min("dd").alias("max_dd"))


def _summary(df: DataFrame, c: str) -> DataFrame:
    q = F.percentile(c, F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95))))
    rows = df.groupBy("series_id").agg(F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), q.alias("q"))
    return rows.select("series_id", "min", "max", "mean", F.col("q")[2].alias("median"), "std", *(F.col("q")[i].alias(f"percentile_{p}") for i, p in ((0, 5), (1, 25), (3, 75), (4, 95))))


def terminal_stats(summary: DataFrame) -> DataFrame:
    return _summary(summary, "terminal")


def drawdown_stats(summary: DataFrame) -> DataFrame:
    return _summary(summary, "max_dd")


def bust_probability(summary: DataFrame, bust: float) -> DataFrame:
    """Share of paths whose max_dd is at or below bust."""
    return summary.groupBy("series_id").agg(F.avg((F.col("max_dd") <= bust).cast("double")).alias("bust_probability"))


def goal_probability(summary: DataFrame, goal: float) -> DataFrame:
    """Share of paths that end at or above goal."""
    return summary.groupBy("series_id").agg(F.avg((F.col("terminal") >= goal).cast("double")).alias("goal_probability"))


def percentile_path(simulated: DataFrame, p: float, sims: int = 1000) -> DataFrame:
    """(series_id, step, v): percentile p (0 to 100) over the paths, step by step."""
    return quantile_paths(simulated, [p / 100], sims).select("series_id", "step", F.col("q")[0].alias("v"))


def confidence_band(simulated: DataFrame, level: float = 0.95, sims: int = 1000) -> DataFrame:
    """(series_id, step, lower, upper)."""
    return quantile_paths(simulated, [(1 - level) / 2, (1 + level) / 2], sims).select("series_id", "step", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


def path_sharpes(simulated: DataFrame, rf: float = 0.0, periods: float = 252) -> DataFrame:
    """(series_id, sim, sharpe) without each path's first return; paths without deviation are left out."""
    rows = simulated.where("step > 0").groupBy("series_id", "sim").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    return rows.where("s > 0").select("series_id", "sim", ((F.col("m") - rf / periods) / F.col("s") * periods**0.5).alias("sharpe"))


def path_cagrs(simulated: DataFrame, periods: float = 252) -> DataFrame:
    """(series_id, sim, cagr); paths that lose all are left out."""
    rows = simulated.groupBy("series_id", "sim").agg(F.max_by("v", "step").alias("t"), F.count("*").alias("n"))
    return rows.where("t > -1").select("series_id", "sim", (F.pow(1 + F.col("t"), periods / F.col("n")) - 1).alias("cagr"))


def montecarlo_sharpe(returns: DataFrame, sims: int = 1000, rf: float = 0.0, periods: float = 252, seed: int = 0) -> DataFrame:
    return _summary(path_sharpes(paths(returns, sims, seed), rf, periods), "sharpe")


def montecarlo_cagr(returns: DataFrame, sims: int = 1000, periods: float = 252, seed: int = 0) -> DataFrame:
    return _summary(path_cagrs(paths(returns, sims, seed), periods), "cagr")


def montecarlo_drawdown(returns: DataFrame, sims: int = 1000, seed: int = 0) -> DataFrame:
    return drawdown_stats(path_summary(paths(returns, sims, seed)))

"""Exact quantiles of groups of any size, without a buffer of a group's values.

A group's values are counted in cells of equal width between its least and its greatest; only the cells
that hold a wanted rank are looked into again, with their own least and greatest value, pass after pass.
At last, the distinct values of those cells are counted and ordered. A cell is a monotone function of
the value, so ranks are exact whatever rounding does. What one task orders is a cell of the last pass:
some 1 / CELLS ** passes of a group's distinct values, unless they crowd.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 4096


def _cell(v: Column, lo: Column, hi: Column) -> Column:
    """Number of the cell of v between lo and hi; halves keep the width finite."""
    width = hi / 2 - lo / 2
    return F.when(width > 0, F.least(F.floor((v / 2 - lo / 2) / width * CELLS), F.lit(CELLS - 1))).otherwise(F.lit(0).cast("long"))


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float], name: str = "q", passes: int = 1) -> DataFrame:
    """(keys, name): an array of the quantiles of each group, between ranks in proportion; nulls don't count. Null keys are a group too.

    Groups without a value have no row. df is read passes + 2 times.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("_k"), F.col(value).cast("double").alias("_v"))
    size = rows.groupBy("_k").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    place = [(F.col("n") - 1) * p for p in probabilities]
    ranks = F.array_distinct(F.array(*(F.floor(h) for h in place), *(F.ceil(h) for h in place)))
    spans = size.select("_k", F.col("n").alias("_n"), ranks.alias("ranks"), F.lit(0).cast("long").alias("below"), "lo", "hi")
    held = lambda below, n: F.filter("ranks", lambda r: (r >= below) & (r < below + n))
    for _ in range(passes):
        at = ["_k", "below"]
        counts = rows.join(spans, "_k").where("_v between lo and hi").groupBy(*at, _cell(F.col("_v"), F.col("lo"), F.col("hi")).alias("cell")).agg(F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.first("ranks").alias("ranks"), F.first("_n").alias("_n"))
        so_far = F.col("below") + F.coalesce(F.sum("c").over(Window.partitionBy(*at).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        spans = counts.withColumn("_b", so_far).withColumn("ranks", held(F.col("_b"), F.col("c"))).where(F.size("ranks") > 0).select("_k", "_n", "ranks", F.col("_b").alias("below"), "lo", "hi")
    values = rows.join(spans, "_k").where("_v between lo and hi").groupBy("_k", "below", "_v").agg(F.count("*").alias("c"), F.first("ranks").alias("ranks"), F.first("_n").alias("_n"))
    so_far = F.col("below") + F.coalesce(F.sum("c").over(Window.partitionBy("_k", "below").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = values.withColumn("_b", so_far).withColumn("ranks", held(F.col("_b"), F.col("c"))).where(F.size("ranks") > 0)
    each = found.select("_k", "_n", F.explode("ranks").alias("rank"), "_v").groupBy("_k").agg(F.first("_n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "_v"))).alias("m"))  # a few ranks a group
    low, high = lambda h: F.col("m")[F.floor(h)], lambda h: F.col("m")[F.ceil(h)]
    out = F.array(*(low(h) + (h - F.floor(h)) * (high(h) - low(h)) for h in place))
    return each.select(*(F.col("_k")[k].alias(k) for k in keys), out.alias(name))

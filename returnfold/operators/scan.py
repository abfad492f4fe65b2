"""Running products, sums and maxima of one series in many tasks: blocks, a scan of their totals, and blocks with what they carry.

A block is what lies in one span of time of one series, so rows know their block without being counted.
Rows are shuffled once, by (series, block); a block's total is its last running value; the totals of a
series, one row for each block, are scanned by block, and each block gets what lies before it. A product
and a running maximum of it are one monoid: (p, m) and then (q, n) is (p q, max(m, p n)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import growth

#: Days of a block; a fraction of a day makes shorter blocks.
SPAN = 512.0
BLOCK = "_block"


def block_of(span: float = SPAN) -> Column:
    """Number of the span of days that dt lies in."""
    return F.floor(F.unix_micros(F.col("dt").cast("timestamp")) / int(span * 86_400_000_000))


def in_blocks(df: DataFrame, block: Column | None = None) -> DataFrame:
    """df with the key of its block, series and number, in place of series_id: one struct, so that null series are a series too.

    A block holds dates that no other block lies between. Rows and totals read the same columns, so that they share one shuffle.
    """
    return df.select(F.struct(F.col("series_id").alias("s"), (block_of() if block is None else block).alias("n")).alias(BLOCK), *(c for c in df.columns if c != "series_id"))


def out_of_blocks(df: DataFrame, columns: list[str], made: dict[str, Column]) -> DataFrame:
    """These columns of df as it was, and those made."""
    return df.select(*((F.col(BLOCK)["s"].alias(c) if c == "series_id" else F.col(c)) for c in columns), *(v.alias(k) for k, v in made.items()))


def inside():
    """Rows of the block up to this one."""
    return Window.partitionBy(BLOCK).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)


def in_block():
    return Window.partitionBy(BLOCK).orderBy("dt")


def blocks():
    """Blocks of a series in their order."""
    return Window.partitionBy(F.col(BLOCK)["s"]).orderBy(F.col(BLOCK)["n"])


def before():
    """Blocks of the series before this one."""
    return blocks().rowsBetween(Window.unboundedPreceding, -1)


def running_growth(df: DataFrame, name: str = "g", c: str = "r", block: Column | None = None) -> DataFrame:
    """df with name: the running product of 1 + c over the series."""
    local = in_blocks(df, block).withColumn("_p", growth(c).over(inside()))
    totals = local.groupBy(BLOCK).agg(growth(c).alias("p"))
    carried = totals.select(BLOCK, F.coalesce(F.product("p").over(before()), F.lit(1.0)).alias("_c"))
    return out_of_blocks(local.join(carried, BLOCK), df.columns, {name: F.col("_c") * F.col("_p")})


def running_max(df: DataFrame, name: str, c: str, block: Column | None = None) -> DataFrame:
    """df with name: the highest c of the series so far."""
    local = in_blocks(df, block).withColumn("_m", F.max(c).over(inside()))
    carried = local.groupBy(BLOCK).agg(F.max(c).alias("m")).select(BLOCK, F.max("m").over(before()).alias("_c"))
    return out_of_blocks(local.join(carried, BLOCK), df.columns, {name: F.greatest("_m", "_c")})


def running_sum(df: DataFrame, sums: dict[str, Column], block: Column | None = None) -> DataFrame:
    """df with a running sum of each of sums over the series; a null counts as 0."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    local = in_blocks(df, block).withColumns({f"_v_{k}": zero(v) for k, v in sums.items()})
    local = local.withColumns({f"_s_{k}": F.sum(f"_v_{k}").over(inside()) for k in sums})
    totals = local.groupBy(BLOCK).agg(*(F.sum(f"_v_{k}").alias(k) for k in sums))
    carried = totals.select(BLOCK, *(zero(F.sum(k).over(before())).alias(f"_c_{k}") for k in sums))
    return out_of_blocks(local.join(carried, BLOCK), df.columns, {k: F.col(f"_s_{k}") + F.col(f"_c_{k}") for k in sums})


def growth_and_peak(df: DataFrame, g: str = "g", peak: str = "peak", c: str = "r", block: Column | None = None) -> DataFrame:
    """df with g, the running product of 1 + c, and peak, the highest of it so far."""
    local = in_blocks(df, block).withColumn("_p", growth(c).over(inside())).withColumn("_m", F.max("_p").over(inside()))
    totals = local.groupBy(BLOCK).agg(growth(c).alias("p"), F.max("_p").alias("m"))
    carried = totals.withColumn("_c", F.coalesce(F.product("p").over(before()), F.lit(1.0)))
    carried = carried.select(BLOCK, "_c", F.max(F.col("_c") * F.col("m")).over(before()).alias("_d"))
    return out_of_blocks(local.join(carried, BLOCK), df.columns, {g: F.col("_c") * F.col("_p"), peak: F.greatest(F.col("_c") * F.col("_m"), "_d")})

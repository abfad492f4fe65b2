"""Moments and ranks over the last n rows, with work a row that doesn't grow with n, and one series in many tasks.

Rows get their place in the series by a scan of counts and are dealt out in chunks of places; a chunk
also holds the n - 1 rows before it. Within a chunk, places fall in blocks of n: the last n rows are the
end of one block and the beginning of the next, so a running aggregate forwards and one backwards, both
within blocks, are merged. Nothing is subtracted from a longer sum, so no digits are lost where returns
are small or equal: values are taken from the block's value nearest the seam, and a flat window has a
deviation of exactly 0.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scan import running_sum

#: Least rows of a chunk.
ROWS = 1 << 14
CHUNK = "_chunk"


def in_chunks(df: DataFrame, n: int, rows: int = ROWS) -> DataFrame:
    """df with _i, a row's place in its series from 0, dealt out by CHUNK; _own is false for the rows before a chunk, which are copies."""
    size = -(-rows // n) * n
    placed = running_sum(df, {"_i": F.lit(1)}).withColumn("_i", F.col("_i") - 1)
    number = F.floor(F.col("_i") / size)
    both = F.when(F.pmod("_i", F.lit(size)) > size - n, F.array(number, number + 1)).otherwise(F.array(number))
    dealt = placed.withColumn("_c", F.explode(both)).withColumn("_own", F.col("_c") == number)
    return dealt.withColumn(CHUNK, F.struct(F.col("series_id").alias("s"), F.col("_c").alias("n"))).drop("_c")


def _half(df: DataFrame, order: Column, name: str, values: Iterable[str], pairs: Iterable[tuple[str, str]], sums: Iterable[str]) -> DataFrame:
    """df with a struct name: counts, means, squares, products and sums of the block's rows up to this one in this order."""
    w = Window.partitionBy(CHUNK, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_z_{v}": F.first(f"_v_{v}", ignorenulls=True).over(w) for v in values})
    off = {v: F.col(f"_v_{v}") - F.col(f"_z_{v}") for v in values}
    parts = [F.count(f"_v_{v}").over(w).alias(f"n_{v}") for v in values]
    parts += [(F.col(f"_z_{v}") + F.avg(off[v]).over(w)).alias(f"mean_{v}") for v in values]
    parts += [(F.var_pop(off[v]).over(w) * F.count(f"_v_{v}").over(w)).alias(f"m2_{v}") for v in values]
    parts += [(F.covar_pop(off[x], off[y]).over(w) * F.count(f"_v_{x}").over(w)).alias(f"co_{x}_{y}") for x, y in pairs]
    parts += [F.sum(f"_v_{s}").over(w).alias(f"sum_{s}") for s in sums]
    return df.withColumn(name, F.struct(*parts)).drop(*(f"_z_{v}" for v in values))


def sliding(df: DataFrame, n: int, values: dict[str, Column], pairs: Iterable[tuple[str, str]] = (), sums: dict[str, Column] | None = None, rows: int = ROWS) -> DataFrame:
    """df with what the last n rows hold: n_, mean_ and m2_ (squares about the mean) of each of values, co_x_y (products about the means) of pairs, sum_ of sums.

    Nulls don't count; both values of a pair must be null in the same rows. The first windows of a series are short.
    """
    sums, pairs = sums or {}, list(pairs)
    given = in_chunks(df, n, rows).withColumn("_block", F.floor(F.col("_i") / n)).withColumns({f"_v_{k}": v for k, v in (values | sums).items()})
    both = _half(_half(given, F.col("_i").desc(), "_end", values, pairs, sums), F.col("_i").asc(), "_a", values, pairs, sums)
    behind = F.lag("_end", n - 1).over(Window.partitionBy(CHUNK).orderBy("_i"))
    both = both.withColumn("_b", F.when(F.pmod("_i", F.lit(n)) < n - 1, behind)).where("_own")
    a, b, zero = F.col("_a"), F.col("_b"), F.lit(0.0)
    count = lambda h, v: F.coalesce(h[f"n_{v}"], F.lit(0))
    share = lambda v: F.try_divide(count(b, v), count(a, v) + count(b, v))
    step = lambda v: b[f"mean_{v}"] - a[f"mean_{v}"]
    added = lambda name, more: F.coalesce(a[name], zero) + F.coalesce(b[name], zero) + F.coalesce(more, zero)
    out = {}
    for v in values:
        out[f"n_{v}"] = count(a, v) + count(b, v)
        out[f"mean_{v}"] = F.coalesce(a[f"mean_{v}"] + step(v) * share(v), a[f"mean_{v}"], b[f"mean_{v}"])
        out[f"m2_{v}"] = added(f"m2_{v}", step(v) * step(v) * count(a, v) * share(v))
    out |= {f"co_{x}_{y}": added(f"co_{x}_{y}", step(x) * step(y) * count(a, x) * share(x)) for x, y in pairs}
    out |= {f"sum_{s}": added(f"sum_{s}", zero) for s in sums}
    return both.select(*df.columns, *(c.alias(k) for k, c in out.items()))


def counts_below(ranks: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each rank, how many of ranks[lo:hi] are below it and how many equal: bit by bit, ranges of zeros before ones."""
    x, below = ranks, np.zeros(len(ranks), np.int64)
    for bit in reversed(range(int(ranks.max(initial=0)).bit_length())):
        one = (x >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        up, lo0, hi0 = (ranks >> bit & 1).astype(bool), zeros[lo], zeros[hi]
        below += np.where(up, hi0 - lo0, 0)
        lo, hi = np.where(up, zeros[-1] + lo - lo0, lo0), np.where(up, zeros[-1] + hi - hi0, hi0)
        x = np.concatenate([x[~one], x[one]])
    return below, hi - lo


def sliding_rank(df: DataFrame, n: int, value: str, name: str, rows: int = ROWS) -> DataFrame:
    """(series_id, dt, name): percent rank of value among the last n rows, ties in the middle; nulls have none and don't count."""
    schema = StructType([df.schema["series_id"], df.schema["dt"]]).add(name, "double")

    def rank(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("_i")
        given = np.asarray(chunk.column("_v").is_valid())
        upto = np.concatenate([[0], np.cumsum(given)])
        at = np.flatnonzero(given)
        lo, hi = upto[np.maximum(at - n + 1, 0)], upto[at + 1]
        below, same = counts_below(np.unique(chunk.column("_v").drop_null().to_numpy(), return_inverse=True)[1].astype(np.int64), lo, hi)
        out = np.zeros(len(given))
        out[at] = (below + (same + 1) / 2) / (hi - lo) * 100
        dt = chunk.column("dt")
        dt = dt.cast(pa.timestamp("us", "UTC")) if pa.types.is_timestamp(dt.type) and dt.type.tz else dt  # the zone's name differs between sessions
        return pa.table([chunk.column("series_id"), dt, pa.array(out, mask=~given)], ["series_id", "dt", name]).filter(chunk.column("_own"))

    given = df.select("series_id", "dt", F.col(value).cast("double").alias("_v"))
    return in_chunks(given, n, rows).groupBy(CHUNK).applyInArrow(rank, schema)

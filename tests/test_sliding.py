"""Rolling moments and ranks against plain loops, with chunks cut anywhere."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_scans import DAY, series

from returnfold.operators import rolling as L
from returnfold.operators import sliding as W


def windows(vs, n):
    return [[x for x in vs[max(0, i - n + 1) : i + 1] if x is not None] for i in range(len(vs))]


def placed(df, *columns):
    return {(r["series_id"], (r["dt"] - DAY).days): tuple(r[c] for c in columns) for r in df.collect()}


def values():
    rng = np.random.default_rng(3)
    plain = rng.normal(0, 0.01, 61).round(3).tolist()
    return {"plain": plain, "holes": [None if i % 7 == 3 else x for i, x in enumerate(plain)], "short": plain[:2], "one": [0.1], "none": [None] * 5, "far": [1e6 + x for x in plain], None: plain[::-1]}


@pytest.mark.parametrize("n,rows", [(1, 1), (2, 1), (5, 1), (5, 11), (5, 1000), (20, 1), (100, 1)])
def test_moments_by_loops(spark, n, rows):
    given = values()
    df = series(spark, given).withColumn("b", F.sin(F.datediff("dt", F.lit(DAY)).cast("double")))
    paired = df.withColumn("b", F.when(F.col("r").isNotNull(), F.col("b")))
    out = placed(W.sliding(paired, n, {"r": F.col("r"), "b": F.col("b")}, [("r", "b")], {"sq": F.col("r") * F.col("r")}, rows), "n_r", "mean_r", "m2_r", "co_r_b", "sum_sq")
    assert len(out) == sum(map(len, given.values()))
    for k, vs in given.items():
        bs = [None if x is None else math.sin(i) for i, x in enumerate(vs)]
        for i, (x, y) in enumerate(zip(windows(vs, n), windows(bs, n))):
            count, mean, m2, co, sq = out[k, i]
            assert count == len(x)
            if x:
                assert mean == pytest.approx(np.mean(x), rel=1e-12, abs=1e-15)
                assert m2 == pytest.approx(np.var(x) * len(x), rel=1e-6, abs=1e-9 if k == "far" else 1e-15)
                assert co == pytest.approx(np.sum((np.array(x) - np.mean(x)) * (np.array(y) - np.mean(y))), rel=1e-6, abs=1e-9 if k == "far" else 1e-14)
                assert sq == pytest.approx(np.sum(np.square(x)), rel=1e-12)
            else:
                assert mean is None and m2 == 0


def test_flat_windows_have_no_deviation(spark):
    flat = [0.05] * 3 + [0.1] * 40 + [1e-9] * 30 + [7.3e5] * 30
    out = placed(L.rolling_measures(series(spark, {"a": flat}), ["rolling_volatility", "rolling_sharpe"], window=7), "rolling_volatility", "rolling_sharpe")
    for i, x in enumerate(windows(flat, 7)):
        vol, sharpe = out["a", i]
        if len(x) < 7:
            assert vol is None
        elif len(set(x)) == 1:
            assert vol == 0 and sharpe is None
        else:
            assert vol == pytest.approx(np.std(x, ddof=1) * 252**0.5, rel=1e-9)


@pytest.mark.parametrize("n,rows", [(1, 1), (4, 1), (4, 10), (60, 1), (60, 1000), (5000, 1)])
def test_ranks_by_loops(spark, n, rows):
    given = values() | {"ties": [1.0, 2.0, 2.0, 1.0, math.nan, 2.0, math.nan, 3.0] * 6}
    out = placed(W.sliding_rank(series(spark, given), n, "r", "rank", rows), "rank")
    for k, vs in given.items():
        key = lambda x: (1, 0.0) if math.isnan(x) else (0, x)
        for i, x in enumerate(windows(vs, n)):
            if vs[i] is None:
                assert out[k, i] == (None,)
            else:
                mine = key(vs[i])
                assert out[k, i][0] == pytest.approx((sum(key(y) < mine for y in x) + (sum(key(y) == mine for y in x) + 1) / 2) / len(x) * 100)


@pytest.mark.parametrize("zone", ["UTC", "Etc/UTC", "Europe/Berlin"])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_ranks_keep_dates(spark, zone, kind):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = series(spark, {"a": [3.0, 1.0, 2.0]}).withColumn("dt", F.col("dt").cast(kind))
        out = W.sliding_rank(df, 2, "r", "rank")
        assert out.schema["dt"].dataType == df.schema["dt"].dataType
        assert df.join(out, ["series_id", "dt"]).orderBy("dt").select("rank").collect() == [(100.0,), (50.0,), (100.0,)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_no_series_is_one_task(spark):
    df = series(spark, {"a": [0.01, 0.02]})
    for made in (L.rolling_measures(df, ["rolling_sharpe", "rolling_sortino"], 2), L.pct_rank(df.withColumnRenamed("r", "p"), 2)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        for line in plan.splitlines():
            if " Window " in line and "windowspecdefinition(series_id" in line:
                raise AssertionError(line)
    empty = df.where("false")
    assert L.rolling_sharpe(empty).isEmpty() and L.pct_rank(empty.withColumnRenamed("r", "p")).isEmpty()

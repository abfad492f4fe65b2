"""Two-level scans, stitched episodes, exact quantiles and permutations against plain loops, cut at every place."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from returnfold.operators import drawdown as D
from returnfold.operators import montecarlo as M
from returnfold.operators import quantile as Z
from returnfold.operators import scan as S

DAY = dt.date(2024, 1, 1)


def series(spark, values):
    """One series a key; a value a day."""
    rows = [(k, DAY + dt.timedelta(days=i), v) for k, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series_id string, dt date, r double")


def drawdowns(values):
    g = np.cumprod(1 + np.array(values))
    return g / np.maximum(1.0, np.maximum.accumulate(g)) - 1


def test_a_cut_anywhere_changes_nothing(spark):
    rng = random.Random(1)
    values = {"a": [0.1, -0.2, -0.1, 0.3, 0.2, -0.05, -0.05, 0.0, 0.2, -0.1, 0.4, -0.3], "any": [rng.uniform(-0.2, 0.2) for _ in range(12)], "total": [0.1, -1.0] + [0.5] * 10}
    values = {f"{cut}|{k}": vs for cut in range(12) for k, vs in values.items()} | {None: values["any"]}
    df = series(spark, values)
    day, cut = F.datediff("dt", F.lit(DAY)), F.coalesce(F.split("series_id", "[|]")[0].cast("int"), F.lit(5))
    block = F.when(day < cut, 0).when(day < cut + 4, 1).otherwise(3)
    got = {(r["series_id"], (r["dt"] - DAY).days): (r["g"], r["peak"]) for r in S.growth_and_peak(df, block=block).collect()}
    sums = {(r["series_id"], (r["dt"] - DAY).days): r["s"] for r in S.running_sum(df, {"s": F.col("r")}, block=block).collect()}
    tops = {(r["series_id"], (r["dt"] - DAY).days): r["m"] for r in S.running_max(df, "m", "r", block=block).collect()}
    for k, vs in values.items():
        g = np.cumprod(1 + np.array(vs))
        for i, top in enumerate(np.maximum.accumulate(g)):
            assert got[k, i] == pytest.approx((g[i], top))
            assert sums[k, i] == pytest.approx(sum(vs[: i + 1])) and tops[k, i] == max(vs[: i + 1])
    dd = D.to_drawdown_series(df, block=block)
    plain = sorted(map(tuple, D.drawdown_details(D.to_drawdown_series(df, block=F.lit(0)), F.lit(0)).collect()), key=repr)
    for counted in (False, True):
        rows = sorted(map(tuple, D.drawdown_details(dd, block, counted).collect()), key=repr)
        assert [r[:6] for r in rows] == [r[:6] for r in plain]
        for x, y in zip(rows, plain):
            assert x[6] == pytest.approx(y[6]) and (x[7] == y[7] or x[7] == pytest.approx(y[7]))
    runs = [0 if x == 0 else 1 for x in drawdowns(values["3|a"])]
    assert sum(r[0] == "3|a" for r in plain) == sum(b and not a for a, b in zip([0, *runs], runs))


def test_one_episode_over_many_blocks(spark):
    df = series(spark, {"a": [-0.5] + [0.001] * 400})
    rows = D.drawdown_details(D.to_drawdown_series(df, block=S.block_of(3)), S.block_of(7)).collect()
    assert len(rows) == 1 and rows[0]["days"] == 401 and rows[0]["start"] == DAY


def test_growth_has_no_window_over_a_whole_series(spark):
    plan = D.to_drawdown_series(series(spark, {"a": [0.1] * 5}))._jdf.queryExecution().optimizedPlan().toString()
    wide = [line for line in plan.splitlines() if "Window" in line and "dt#" in line and "_block#" not in line]
    assert not wide


@pytest.mark.parametrize("passes", [1, 2])
def test_quantiles_are_exact(spark, monkeypatch, passes):
    monkeypatch.setattr(Z, "CELLS", 5)
    rng = random.Random(passes)
    groups = {"ties": [rng.choice([0.0, 1.0, 1.0, 2.0]) for _ in range(101)], "one": [3.5], None: [rng.gauss(0, 1) for _ in range(50)], "far": [1e300, -1e300, 0.0, 1e-300, 5e-324] * 3, "same": [7.0] * 9, "crowd": [1.0 + k * 1e-16 for k in range(40)] + [1e9]}
    rows = [(k, v) for k, vs in groups.items() for v in [*vs, None]]
    rng.shuffle(rows)
    ps = [0.0, 0.01, 0.25, 0.5, 0.95, 0.99, 1.0]
    got = {r["k"]: r["q"] for r in Z.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", ps, passes=passes).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        if k != "far":
            assert got[k] == pytest.approx(list(np.quantile(vs, ps)))
    assert got["far"][0] == -1e300 and got["far"][-1] == 1e300 and got["far"][3] == sorted(groups["far"])[7]


def test_quantile_paths_agree(spark, monkeypatch):
    sim = M.paths(series(spark, {"a": [0.1, -0.2, 0.05, 0.3, -0.1, 0.02, 0.0]}), 60, 3)
    held = sorted(map(tuple, M.confidence_band(sim).collect()))
    monkeypatch.setattr(M, "BUFFER", 10)
    assert [pytest.approx(x[2:]) for x in held] == [x[2:] for x in sorted(map(tuple, M.confidence_band(sim, sims=60).collect()))]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 997, 2405])
def test_permutations_are_one_to_one_and_differ(spark, n):
    rows = spark.range(n).select(F.col("id").alias("i"), F.lit(n).cast("long").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(40).cast("long"))).alias("sim"))
    to = {}
    for r in M.shuffled(rows, "i", "n", "sim", 9).collect():
        to.setdefault(r["sim"], {})[r["i"]] = r["step"]
    assert all(sorted(p.values()) == list(range(n)) for p in to.values())
    assert all(to[0][i] == i for i in range(n))
    if n >= 64:
        orders = np.array([[to[s][i] for i in range(n)] for s in range(1, 41)])
        assert len({tuple(o) for o in orders}) == 40
        steps = np.abs(np.diff(orders, axis=1))  # neighbours go apart as in a random order: a third of n on average
        assert 0.3 < steps.mean() / n < 0.37 and abs(np.mean([np.corrcoef(np.arange(n), o)[0, 1] for o in orders])) < 0.1
        assert abs(orders.mean(0) / n - 0.5).max() < 0.25  # every place goes everywhere

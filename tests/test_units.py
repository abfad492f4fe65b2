"""Edge cases, by hand-made series."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from returnfold.functions import columns as C
from returnfold.operators import benchmark, calendar, drawdown, filters, montecarlo, portfolio, prepare, rolling
from returnfold.operators.stats import STATS, Settings, compute, longest_streak
from returnfold.plans import chart_data, report
from returnfold.sources import series
from returnfold.streaming import running

DAY = dt.date(2024, 1, 1)


def frame(spark, values, name="a", start=DAY):
    return spark.createDataFrame([(name, start + dt.timedelta(i), v) for i, v in enumerate(values)], "series_id string, dt date, r double")


def one(df):
    return df.head().asDict()


def test_flat_series_has_undefined_ratios(spark):
    got = one(compute(frame(spark, [0.0] * 20), *STATS))
    assert got["sharpe"] is None and got["sortino"] is None and got["win_rate"] == 0 and got["max_drawdown"] == 0 and got["exposure"] == 0


def test_all_up_and_all_down(spark):
    up = one(compute(frame(spark, [0.01, 0.02, 0.03]), "profit_factor", "win_rate", "payoff_ratio", "max_drawdown"))
    assert up == {"series_id": "a", "profit_factor": None, "win_rate": 1.0, "payoff_ratio": None, "max_drawdown": 0.0}
    down = one(compute(frame(spark, [-0.01, -0.02]), "profit_ratio", "comp", "win_rate"))
    assert down["profit_ratio"] == 0 and down["win_rate"] == 0 and down["comp"] == pytest.approx(0.99 * 0.98 - 1)


def test_total_loss(spark):
    got = one(compute(frame(spark, [0.1, -1.0, 0.2]), "comp", "max_drawdown", "cagr"))
    assert got["comp"] == -1 and got["max_drawdown"] == -1 and got["cagr"] == -1


def test_every_statistic_survives_one_row_and_none(spark):
    assert compute(frame(spark, [0.01]), *STATS).count() == 1
    assert compute(series.empty(spark), *STATS).count() == 0


def test_clean_and_kinds(spark):
    rows = prepare.prepare(frame(spark, [math.nan, math.inf, None, 0.5]))
    assert [r["r"] for r in rows.orderBy("dt").collect()] == [0, 0, 0, 0.5]
    prices = frame(spark, [100.0, 110.0, 99.0])
    for kind in ("price", "infer"):
        assert [round(r["r"], 9) for r in prepare.prepare(prices, kind).orderBy("dt").collect()] == [0, 0.1, -0.1]


def test_rate_is_taken_off_each_period(spark):
    got = prepare.prepare(frame(spark, [0.01]), rf=0.02, periods=252).head()["r"]
    assert got == pytest.approx(0.01 - (1.02 ** (1 / 252) - 1))


def test_sharpe_by_hand(spark):
    r = [0.01, -0.02, 0.03, 0.005]
    m = sum(r) / 4
    s = math.sqrt(sum((x - m) ** 2 for x in r) / 3)
    assert one(compute(frame(spark, r), "sharpe"))["sharpe"] == pytest.approx(m / s * math.sqrt(252))
    assert one(compute(frame(spark, r), "sharpe", settings=Settings(annualize=False)))["sharpe"] == pytest.approx(m / s)


def test_invariants(spark):
    f = frame(spark, [0.01, -0.02, 0.03, -0.01, 0.02] * 10)
    got = one(compute(f, "comp", "conditional_value_at_risk", "value_at_risk", "sharpe"))
    assert got["conditional_value_at_risk"] <= got["value_at_risk"]
    assert rolling.compsum(f).orderBy(F.desc("dt")).head()["compsum"] == pytest.approx(got["comp"])
    assert one(compute(f, "sharpe", settings=Settings(rf=0.05)))["sharpe"] < got["sharpe"]


@pytest.mark.parametrize(
    "dds, want",
    [
        ([-0.1, -0.2, 0.0], [(0, 1, 1, 2)]),
        ([-0.1, 0.0, -0.2], [(0, 0, 0, 1), (2, 2, 2, 1)]),
        ([0.0, -0.1, 0.0], [(1, 1, 1, 1)]),
        ([0.0, 0.0], []),
    ],
)
def test_drawdown_episodes(spark, dds, want):
    rows = frame(spark, dds).withColumnRenamed("r", "dd")
    got = drawdown.drawdown_details(rows).orderBy("episode").collect()
    day = lambda i: DAY + dt.timedelta(i)
    assert [(r["start"], r["valley"], r["end"], r["days"]) for r in got] == [(day(a), day(b), day(c), n) for a, b, c, n in want]
    assert all(r["max_dd_99"] is None for r in got if r["days"] == 1)


def test_price_baseline(spark):
    rows = frame(spark, [50.0, 40.0]).withColumnRenamed("r", "p")
    assert [round(r["dd"], 9) for r in drawdown.price_drawdowns(rows).orderBy("dt").collect()] == [0, -0.2]
    assert [round(r["dd"], 9) for r in drawdown.price_drawdowns(rows, True).orderBy("dt").collect()] == [-0.5, -0.6]


def test_empty_bins_and_streaks(spark):
    rows = frame(spark, [0.1]).unionByName(frame(spark, [0.2], start=DAY + dt.timedelta(17)))
    assert [r["r"] for r in calendar.resample(rows, "W", "sum", empty=0.0).orderBy("dt").collect()][1:-1] == [0.0, 0.0]
    assert longest_streak(frame(spark, [0.1, 0.2, -0.1, 0.0, 0.3])).head()["consecutive_wins"] == 2
    assert longest_streak(frame(spark, [0.1, 0.2])).head()["consecutive_wins"] == 2


def test_percent_rank_ties(spark):
    rows = frame(spark, [1.0, 1.0, 2.0]).withColumnRenamed("r", "p")
    assert [r["pct_rank"] for r in rolling.pct_rank(rows).orderBy("dt").collect()] == [100.0, 75.0, 100.0]


def test_date_filters(spark):
    rows = frame(spark, [0.1] * 200)
    assert filters.quarter_to_date(rows, "2024-05-20").agg(F.min("dt")).head()[0] == dt.date(2024, 4, 1)
    assert filters.current_month(rows, "2024-05-20").count() == 20
    assert filters.on_dates(rows, DAY).count() == 1


def test_index_needs_all_constituents(spark):
    rows = frame(spark, [0.1, 0.2], "a").unionByName(frame(spark, [0.3], "b"))
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "ticker string, weight double")
    assert [round(r["r"], 9) for r in portfolio.make_index(rows, weights).collect()] == [0.2]


def test_benchmark_is_filled_backward(spark):
    own, b = frame(spark, [0.0, 0.0, 0.0]), frame(spark, [0.0, 0.1, 0.2]).where(F.col("dt") != F.lit(DAY + dt.timedelta(1))).select("dt", F.col("r").alias("b"))
    assert [round(r["b"], 9) for r in benchmark.align_benchmark(own, b).orderBy("dt").collect()] == [0, 0.2, 0]


def test_montecarlo(spark):
    rows = frame(spark, [0.01, -0.02, 0.03, 0.0, 0.05])
    p = montecarlo.paths(rows, 6, 1)
    summary = montecarlo.path_summary(p).collect()
    assert len(summary) == 6 and len({round(r["terminal"], 9) for r in summary}) == 1
    assert [r["r"] for r in p.where("sim = 0").orderBy("step").collect()] == [0.01, -0.02, 0.03, 0.0, 0.05]
    again, other = montecarlo.paths(rows, 6, 1), montecarlo.paths(rows, 6, 2)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(p) == key(again) != key(other)
    first = frame(spark, [-0.1, 0.0])
    assert montecarlo.path_summary(montecarlo.paths(first, 1)).head()["max_dd"] == 0 and drawdown.max_drawdown(first).head()["max_drawdown"] == pytest.approx(-0.1)


def test_normal_cdf(spark):
    got = spark.range(1).select(*(C.normal_cdf(F.lit(float(x))).alias(f"c{i}") for i, x in enumerate((-8, -1.96, 0, 1, 9)))).head()
    assert [round(v, 6) for v in got] == [0.0, 0.024998, 0.5, 0.841345, 1.0]


def test_labels(spark):
    got = spark.range(1).select(C.currency_label(F.lit(1_500_000.0)), C.percent_label(F.lit(20_000.0)), C.currency_label(F.lit(7.0)), C.signed(F.lit("3")), C.signed(F.lit("-3")), C.round_to(F.lit(7.3), 0.5)).head()
    assert list(got) == ["$1.5M", "20K%", "$7", "+3", "-3", 7.5]


def test_validation(spark, tmp_path):
    with pytest.raises(series.SeriesError):
        series.validate(spark.range(1))
    with pytest.raises(series.EmptySeriesError):
        series.validate(series.empty(spark), allow_empty=False)
    rows = frame(spark, [0.1, 0.2])
    series.write_series(rows, str(tmp_path / "r"))
    assert series.read_series(spark, str(tmp_path / "r"), since="2024-01-02").count() == 1


def test_wide_round_trip(spark):
    rows = frame(spark, [0.1, 0.2], "a").unionByName(frame(spark, [0.3, 0.4], "b"))
    assert sorted(map(tuple, series.from_wide(series.to_wide(rows, ["a", "b"])).collect())) == sorted(map(tuple, rows.collect()))


def test_html(spark, tmp_path):
    page = report.html(frame(spark, [0.01, -0.02, 0.015] * 40), "a", title="A & B", output=str(tmp_path / "t.html"))
    assert "A &amp; B" in page and "Sharpe" in page and (tmp_path / "t.html").read_text(encoding="utf-8") == page


def test_metrics_of_nothing(spark):
    assert report.metrics(series.empty(spark)).count() == 0


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 1 + i // 24, i % 24), 0.01) for i in range(24 * 20)], "series_id string, ts timestamp, r double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = running.start(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() >= 1 and got.where("n <> 24").count() == 0


def test_metrics_of_added_returns_and_dates(spark):
    rows = frame(spark, [0.1, -0.2, 0.05, 0.3])
    got = {r["metric"]: r for r in report.metrics(rows, settings=Settings(compounded=False, rf=0.02)).collect()}
    assert "Cumulative Return %" not in got and got["Total Return %"]["value"] == pytest.approx(25.0) and got["Risk-Free Rate %"]["value"] == 2.0
    assert [got[k]["date"] - got["Start Period"]["date"] for k in ("End Period", "Max DD Date", "Max DD Period Start", "Max DD Period End")] == [dt.timedelta(d) for d in (3, 1, 1, 2)]


def test_tear_sheet_beside_a_benchmark(spark):
    rows = frame(spark, [0.0, 0.01, -0.02, 0.015] * 30)
    page = report.html(rows, "a", rows.select("dt", (rows["r"] / 2).alias("b")))
    assert page.count("<polyline") == 2 and "<th>Benchmark</th>" in page and "Dates: matched" in page and "Beta" in page


def test_exponential_deviation_equals_pandas(spark):
    values = [0.01 * math.sin(i * i) + (0.5 if i == 300 else 0) for i in range(1500)]
    for args in ({"window": 30}, {"window": 5, "halflife": True}):
        got = [r["ewm_std"] for r in prepare.exponential_stdev(frame(spark, values), **args).orderBy("dt").collect()]
        ewm = pd.Series(values).ewm(halflife=5, min_periods=5) if "halflife" in args else pd.Series(values).ewm(span=30, min_periods=30)
        for x, y in zip(got, ewm.std()):
            assert (x is None and math.isnan(y)) or x == pytest.approx(y, rel=1e-6, abs=1e-9)


def test_all_charts_have_rows(spark):
    rows = frame(spark, [0.01, -0.02, 0.015] * 100)
    tables = chart_data.charts(rows, rows.select("dt", (rows["r"] / 2).alias("b")))
    assert len(tables) == 17 and all(t.limit(1).count() == 1 for t in tables.values())
    assert set(chart_data.charts(rows, full=False)) == {"snapshot", "heatmap"}


def test_small_helpers(spark):
    from returnfold.operators.calendar import frequency

    assert [frequency(x) for x in ("M", "A", "D", "2H")] == ["ME", "YE", "D", "2H"]
    assert report.parameters(Settings(), "X")["Benchmark"] == "X" and "Benchmark" not in report.parameters()

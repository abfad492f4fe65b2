"""Operators and statistics as steps of transform."""

import pytest
from test_scans import series

from returnfold import fluent
from returnfold.operators import filters, prepare, rolling
from returnfold.operators.stats import ALIASES, STATS, Settings, compute


def test_steps_equal_calls(spark):
    df = series(spark, {"a": [0.01, -0.02, 0.03, 0.01, -0.01], None: [0.02, 0.01, -0.03, 0.0, 0.01]})
    for got, want in (
        (df.transform(fluent.rolling_volatility(window=3)), rolling.rolling_volatility(df, 3)),
        (df.transform(fluent.year_to_date("2024-01-03")).transform(fluent.to_prices(base=10.0)), prepare.to_prices(filters.year_to_date(df, "2024-01-03"), 10.0)),
        (df.transform(fluent.sharpe(rf=0.02, periods=52)), compute(df, "sharpe", settings=Settings(rf=0.02, periods=52))),
        (df.transform(fluent.max_drawdown()), compute(df, "max_drawdown")),
    ):
        assert got.schema == want.schema
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_every_name_is_a_step():
    assert {*STATS, *ALIASES} <= set(fluent.STEPS)
    assert {"to_returns", "rebase", "monthly_returns", "outliers", "drawdown_details", "pct_rank", "compsum"} <= set(dir(fluent))
    assert not [k for k in fluent.STEPS if k.startswith("_")]


def test_wrong_arguments_fail_at_once():
    for make in (lambda: fluent.rolling_volatility(days=3), lambda: fluent.sharpe(risk=1), lambda: fluent.nothing):
        with pytest.raises((TypeError, AttributeError)):
            make()

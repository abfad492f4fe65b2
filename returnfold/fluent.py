"""Operators as steps of DataFrame.transform, their table left out: returns.transform(year_to_date()).transform(sharpe(rf=0.02)).

Every public operator that takes a table first and gives one is a step of the same name and arguments.
A statistic is a step that takes the fields of Settings and a period; where an operator has its name
too, the step is the statistic.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame

from .operators import benchmark, calendar, drawdown, filters, portfolio, prepare, rolling
from .operators.stats import ALIASES, STATS, Settings, compute

Step = Callable[[DataFrame], DataFrame]


def step(operator: Callable[..., DataFrame]) -> Callable[..., Step]:
    """operator without its first argument; the others are checked when they are given, not when the step runs."""

    def given(*args, **kwargs) -> Step:
        inspect.signature(operator).bind(None, *args, **kwargs)
        return lambda df: operator(df, *args, **kwargs)

    given.__name__, given.__doc__ = operator.__name__, operator.__doc__
    return given


def statistic(name: str, period: str | None = None, **settings) -> Step:
    """(series_id, name) of returns."""
    chosen = Settings(**settings)
    return lambda df: compute(df, name, settings=chosen, period=period)


def _operators() -> dict[str, Callable[..., DataFrame]]:
    found = {}
    for module in (prepare, calendar, filters, drawdown, rolling, portfolio, benchmark):
        for name, f in inspect.getmembers(module, inspect.isfunction):
            kinds = [p.annotation for p in inspect.signature(f).parameters.values()]
            if f.__module__ == module.__name__ and not name.startswith("_") and kinds[:1] == ["DataFrame"] == [inspect.signature(f).return_annotation]:
                found[name] = f
    return found


STEPS: dict[str, Callable[..., Step]] = {k: step(f) for k, f in _operators().items()} | {k: partial(statistic, k) for k in (*STATS, *ALIASES)}


def __getattr__(name: str) -> Callable[..., Step]:
    if name in STEPS:
        return STEPS[name]
    raise AttributeError(f"no step {name}")


def __dir__() -> list[str]:
    return sorted({*globals(), *STEPS})

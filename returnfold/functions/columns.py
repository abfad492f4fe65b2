"""Windows, guarded arithmetic, distributions and labels as columns."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY, TIME = "series_id", "dt"


def ordered(*keys: str, by: str = TIME) -> WindowSpec:
    return Window.partitionBy(*(keys or (KEY,))).orderBy(by)


def running(*keys: str, by: str = TIME) -> WindowSpec:
    """All rows of the series up to this one."""
    return ordered(*keys, by=by).rowsBetween(Window.unboundedPreceding, 0)


def onward(*keys: str, by: str = TIME) -> WindowSpec:
    """This row of the series and all after it."""
    return ordered(*keys, by=by).rowsBetween(0, Window.unboundedFollowing)


def whole(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or (KEY,)))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """Null for NaN and infinities."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def growth(c: Column | str = "r") -> Column:
    """Aggregate: product of 1 + c."""
    return F.product(1 + col(c))


def correlation(a: str, b: str) -> Column:
    """Aggregate: Pearson's correlation over rows that have both; null where one doesn't vary."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_samp(a, b), F.sqrt(F.var_samp(x)) * F.sqrt(F.var_samp(y)))


def skewness(c: str) -> Column:
    """Aggregate: sample skewness, corrected for bias; null below three rows."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def excess_kurtosis(c: str) -> Column:
    """Aggregate: sample excess kurtosis, corrected for bias; null below four rows."""
    n = F.count(c)
    return F.when(n > 3, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution: density times the series x + x^3/3 + x^5/15 ... plus a half; 0 or 1 beyond 7."""
    step = lambda acc, k: F.struct((acc["t"] * x * x / (2 * k + 1)).alias("t"), (acc["s"] + acc["t"] * x * x / (2 * k + 1)).alias("s"))
    x0 = F.coalesce(x, F.lit(None).cast("double"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(150)), F.struct(x0.alias("t"), x0.alias("s")), step)["s"]
    inside = 0.5 + F.exp(-x * x / 2) / (2 * 3.141592653589793) ** 0.5 * total
    return F.when(x > 7, 1.0).when(x < -7, 0.0).otherwise(inside)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def daily_rate(rf: float, periods: float | None) -> float:
    """The rate for one period whose compound over a year of periods is rf; rf itself where periods is None."""
    return rf if periods is None else (1 + rf) ** (1 / periods) - 1


def signed(s: Column | str) -> Column:
    """A plus sign before texts without a minus sign."""
    s = col(s)
    return F.when(s.contains("-"), s).otherwise(F.concat(F.lit("+"), s))


def round_to(c: Column | str, step: float, digits: int | None = None) -> Column:
    """Nearest multiple of step, halves to even."""
    out = F.bround(col(c) / step) * step
    return out if digits is None else F.bround(out, digits)


#: Limits and letters of large numbers in labels.
SIZES = [(1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")]


def short_number(c: Column | str, before: str = "", after: str = "") -> Column:
    """Labels like $1.5M or 20K%: at most one decimal, dropped when 0, above a thousand; none below."""
    c = col(c)
    label = lambda v, letter: F.concat(F.lit(before), F.regexp_replace(F.format_string("%.1f", v), r"\.0$", ""), F.lit(letter + after))
    out = None
    for size, letter in SIZES:
        out = (F if out is None else out).when(c >= size, label(c / size, letter))
    return out.otherwise(F.concat(F.lit(before), F.format_string("%.0f", c), F.lit(after)))


def currency_label(c: Column | str) -> Column:
    return short_number(c, before="$")


def percent_label(c: Column | str) -> Column:
    return short_number(c, after="%")

"""Reading and shaping return and price series; checks of what comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import finite, ordered

RETURNS = "series_id string, dt date, r double"
PRICES = "series_id string, dt date, p double"


class SeriesError(ValueError):
    """The data can't be read as series."""


class EmptySeriesError(SeriesError):
    """There is no value at all."""


def validate(df: DataFrame, value: str = "r", allow_empty: bool = True) -> DataFrame:
    """df, if it has series_id, dt and a numeric value; not allow_empty costs an action that looks for one value."""
    types = dict(df.dtypes)
    if missing := [c for c in ("series_id", "dt", value) if c not in types]:
        raise SeriesError(f"columns are missing: {missing}")
    if types["dt"] not in ("date", "timestamp", "timestamp_ntz"):
        raise SeriesError(f"dt is {types['dt']}, not a date or time")
    if not (types[value] in ("double", "float", "int", "bigint", "smallint", "tinyint") or types[value].startswith("decimal")):
        raise SeriesError(f"{value} is {types[value]}, not a number")
    if not allow_empty and df.where(finite(F.col(value).cast("double")).isNotNull()).isEmpty():
        raise EmptySeriesError("no value")
    return df


def read_series(spark: SparkSession, path: str, kind: str = "parquet", value: str = "r", since=None, until=None, series: list[str] | None = None, **options) -> DataFrame:
    """(series_id, dt, value) from files of any kind that Spark reads.

    since, until and series reach the scan; where the files lie in folders by year, as write_series() puts them, the
    years outside the limits aren't listed.
    """
    df = spark.read.format(kind).options(**options).load(path)
    for limit, low in ((since, True), (until, False)):
        if limit is not None:
            day = F.lit(limit).cast("date") if dict(df.dtypes)["dt"] == "date" else F.lit(limit)
            df = df.where(F.col("dt") >= day if low else F.col("dt") <= day)
            if "year" in df.columns:
                year = int(str(limit)[:4])
                df = df.where(F.col("year") >= year if low else F.col("year") <= year)
    if series is not None:
        df = df.where(F.col("series_id").isin(series))
    return validate(df.select("series_id", "dt", F.col(value).cast("double").alias(value)), value)


def download_returns(spark: SparkSession, path: str, series: list[str] | None = None, since=None, **options) -> DataFrame:
    """Daily returns from stored closing prices (series_id, dt, close): the change to the row before, 0 for the first.

    since leaves out rows before it only after the change is known; series reach the scan.
    """
    prices = read_series(spark, path, value="close", series=series, **options)
    change = F.try_divide(F.col("close"), F.lag("close").over(ordered())) - 1
    out = prices.select("series_id", "dt", F.coalesce(finite(change), F.lit(0.0)).alias("r"))
    return out if since is None else out.where(F.col("dt") >= F.lit(since))


def empty(spark: SparkSession, schema: str = RETURNS) -> DataFrame:
    return spark.createDataFrame([], schema)


def from_wide(df: DataFrame, time: str = "dt", value: str = "r") -> DataFrame:
    """One column for each series to one row for each value."""
    series = [c for c in df.columns if c != time]
    return df.unpivot(time, series, "series_id", value).select("series_id", F.col(time).alias("dt"), F.col(value).cast("double").alias(value))


def to_wide(df: DataFrame, series: list[str], value: str = "r") -> DataFrame:
    """One row for each dt, one column for each of the named series."""
    return df.groupBy("dt").pivot("series_id", series).agg(F.first(value))


def stack(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, by column name; columns that one lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def beside(left: DataFrame, right: DataFrame, on: str = "dt") -> DataFrame:
    """Columns of both frames, on all their dates."""
    return left.join(right, on, "full_outer")


def naive_utc(df: DataFrame, column: str = "dt") -> DataFrame:
    """A time with zone as the time without zone that clocks show in UTC."""
    return df.withColumn(column, F.to_utc_timestamp(F.col(column), F.current_timezone()).cast("timestamp_ntz")) if dict(df.dtypes)[column] == "timestamp" else df


def write_series(df: DataFrame, path: str, mode: str = "error", by_year: bool = True) -> None:
    """Parquet, by year of dt, so that a reader's date limits prune folders."""
    if by_year:
        df.withColumn("year", F.year("dt")).write.mode(mode).partitionBy("year").parquet(path)
    else:
        df.write.mode(mode).parquet(path)

"""Running statistics of series that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import growth


def windowed_stats(stream: DataFrame, size: str = "1 day", late: str = "7 days") -> DataFrame:
    """(series_id, start, n, total, mean, std, worst, best) of each window of (series_id, ts, r).

    Rows later than `late` behind the newest are left out; a window is final, and its state gone, then.
    """
    rows = stream.withWatermark("ts", late).groupBy("series_id", F.window("ts", size))
    out = rows.agg(F.count("r").alias("n"), (growth() - 1).alias("total"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.min("r").alias("worst"), F.max("r").alias("best"))
    return out.select("series_id", F.col("window.start").alias("start"), "n", "total", "mean", "std", "worst", "best")


def start(stream: DataFrame, path: str, checkpoint: str, size: str = "1 day", late: str = "7 days"):
    """Writes final windows to Parquet at path, each once."""
    return windowed_stats(stream, size, late).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()

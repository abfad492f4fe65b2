"""What several operators share: inputs, shared scratch tables, dealing rows out."""

from __future__ import annotations

import re
import tempfile
import uuid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): only these columns, whatever else the table holds; a null text becomes empty."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share, under spark.checkpoint.dir; what is there stays until that is cleared.

    Where that is unset, a local folder serves a session whose executors are threads of the driver; any other session fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a shared Parquet table and read again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that stored() gave and that nothing reads any more, so that scratch holds what is in use alone."""
    for df in tables:
        jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def ranges(docs: DataFrame, text: str = "text", most_bytes: int = 8 << 20, most: int = 1000) -> int:
    """How many ranges of rows to deal docs out in, so that each has some most_bytes of text; rows of a range needn't fit in memory."""
    size = docs.agg(F.sum(F.octet_length(text))).head()[0] or 0
    return max(1, min(most, -(-size // most_bytes)))


def sliced(batch, column: str, most_bytes: int = 4 << 20):
    """Slices of an Arrow batch with at most most_bytes of column each (one row at least)."""
    import numpy as np

    ends, at = np.cumsum(_sizes(batch.column(column))), 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def trim() -> None:
    """Gives memory that this Python worker has freed back to the system, as far as its C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(work, *args):
    """What work gives; the memory that it took meanwhile is given back, for a worker keeps it as long as it lives."""
    out = work(*args)
    trim()
    return out


def _sizes(column):
    import numpy as np
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)

"""Product codes of integer vectors by ball k-means.

A vector is cut into PARTS equal parts, and each part position has a codebook of ENTRIES entries. A
part's home is the entry that it had last. Entries and their parts are balls: by the triangle
inequality, an entry can be as near as the home only if its distance from the home is at most twice the
part's own. So a ball's neighbour entries are those within twice its radius, that of its parts in the
batch; parts nearer than half way to the nearest neighbour are its stable core and stay without a look;
the others lie in rings between the half distances of the neighbours, in order, and are compared with
the neighbours inside their ring alone. All distances are squares of whole numbers, so nothing is lost
by rounding, and ties go to the lower index. In the first round, where no part has a home yet, every
entry is looked at.

Each round is a stored table of vectors and codes. Sums of a round are made a batch at a time and then
by part and entry, so what reaches the driver and goes out again is the codebooks: ENTRIES times the
dimension. A component beyond LIMIT makes the batch count in Python's unbounded integers.

Rows are left out whose vector is null or holds null or non-finite components; rows with equal or null
vec_id each count. Vectors shorter than the longest, or whose length PARTS doesn't divide, are filled up
with zeros. The first entries are the parts of the vectors of least vec_id (nulls last, then by vector).
Fewer than ENTRIES vectors make smaller codebooks. Sums beyond a long are null. Columns but those named
are left out. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components up to this size keep sums of squares of 2^14 dimensions within 63 bits.
LIMIT = 1 << 23
#: A label with one row in this many goes out with a broadcast; there are no more such labels than this.
HOT = 200


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of (vec_id, label, embedding): v holds floor(scale * x), exactly; rows that don't count are left out.

    A component beyond 2^62 counts as 2^62.
    """
    x = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    most = float(1 << 62)
    v = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(most)), F.lit(-most))))
    return vectors.where(F.coalesce(sound, F.lit(False))).select("vec_id", "label", v.alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column, filled up to width; whole numbers of 64 bits, or Python's where one is beyond LIMIT."""
    flat, n = np.asarray(column.flatten(), np.int64), np.asarray(column.value_lengths(), np.int64)
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out.astype(object) if len(flat) and max(-int(flat.min()), int(flat.max())) > LIMIT else out


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of each of a and each of b."""
    out = 0
    for d in range(a.shape[1]):
        step = a[:, d, None] - b[None, :, d]
        out = out + step * step
    return out


class Balls:
    """The codebook of one part position, with each entry's others in order of distance."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.apart = entries, squares(entries, entries)
        self.near = np.argsort(self.apart, axis=1, kind="stable")  # itself first, or an equal entry of lower index
        self.ordered = np.take_along_axis(self.apart, self.near, 1)

    def first(self, parts: np.ndarray) -> np.ndarray:
        """Nearest entry of each part, all entries looked at."""
        return np.concatenate([np.argmin(squares(parts[k : k + 2000], self.entries), axis=1) for k in range(0, len(parts), 2000)]) if len(parts) else np.empty(0, np.int64)

    def own(self, parts: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Squared distance of each part from its home."""
        step = parts - self.entries[home]
        return (step * step).sum(1)

    def again(self, parts: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Nearest entry of each part, from its home of the last round."""
        own, out = self.own(parts, home), home.copy()
        for ball in np.unique(home):
            rows = np.flatnonzero(home == ball)
            reach = self.ordered[ball]
            radius = own[rows].max()
            near = self.near[ball][: int(np.searchsorted(reach, 4 * radius, side="right"))]  # neighbour entries, itself among them
            ring = np.searchsorted(reach, 4 * own[rows], side="right")  # how many of these may be as near
            outside = ring > 1  # the others are the stable core
            if not outside.any():
                continue
            rows, ring = rows[outside], ring[outside]
            order = np.argsort(ring, kind="stable")
            for some in np.array_split(order, max(1, len(order) // 256)):  # rings of like size together
                look = near[: int(ring[some].max())]
                by_index = np.sort(look)  # ties to the lower index
                out[rows[some]] = by_index[np.argmin(squares(parts[rows[some]], self.entries[by_index]), axis=1)]
        return out


def _cut(v: np.ndarray) -> list[np.ndarray]:
    return np.split(v, PARTS, axis=1)


def coded(vectors: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """vectors (with v) with code, the entry of each part, and error, of books (parts, entries, components); from their last code if they have one."""
    others, again = [c for c in vectors.columns if c not in ("code", "error")], "code" in vectors.columns
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([vectors.schema[c] for c in others]).add("code", "binary").add("error", "long")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = [Balls(b) for b in sent.value]
        for batch in batches:
            v = _matrix(batch.column("v"), width)
            home = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, PARTS) if again else None
            code, error = np.empty((len(v), PARTS), np.uint8), 0
            for k, parts in enumerate(_cut(v)):
                code[:, k] = balls[k].again(parts, home[:, k].astype(np.int64)) if again else balls[k].first(parts)
                error = error + balls[k].own(parts, code[:, k].astype(np.int64))
            errors = [int(e) if e < 1 << 63 else None for e in error] if len(v) else []
            yield pa.record_batch([*(batch.column(c) for c in others), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(errors, pa.int64())], schema.names)

    return vectors.mapInArrow(assign, schema)


def _sums(rows: DataFrame, width: int) -> list:
    """(part, entry, n, sums) of coded rows: at most PARTS * ENTRIES rows; sums as decimal text, as they may be beyond a long."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, width // PARTS), object)
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)
            for k, parts in enumerate(_cut(_matrix(batch.column("v"), width))):
                here = np.zeros(total[k].shape, parts.dtype)
                np.add.at(here, code[:, k], parts)
                total[k] += here
                n[k] += np.bincount(code[:, k], minlength=ENTRIES)
        part, entry = np.nonzero(n)
        yield pa.record_batch([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry], pa.int64()), pa.array([[str(int(x)) for x in total[p, e]] for p, e in zip(part, entry)], pa.list_(pa.string()))], ["part", "entry", "n", "sums"])

    sums = F.array(*(F.sum(F.col("sums")[d].cast("decimal(38,0)")).cast("string") for d in range(width // PARTS)))
    partial = rows.select("v", "code").mapInArrow(add, "part int, entry int, n long, sums array<string>")
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), sums.alias("sums")).collect()


def fit(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vectors with code and error, codebooks of shape (parts, entries, components)) of (vec_id, label, v)."""
    vectors = stored(vectors, "vectors")
    width = -(-(vectors.agg(F.max(F.size("v"))).head()[0] or 0) // PARTS) * PARTS
    first = [r["v"] for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()]
    if not first:
        return vectors.select("*", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((PARTS, 0, 0), np.int64)
    books = np.stack(_cut(_matrix(pa.array(first, pa.list_(pa.int64())), max(width, PARTS))))
    width = max(width, PARTS)
    for _ in range(rounds):
        vectors = stored(coded(vectors, books, width), "coded")
        books = books.astype(object)
        for r in _sums(vectors, width):
            books[r["part"], r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
        if max(abs(int(x)) for x in books.ravel()) <= LIMIT:
            books = books.astype(np.int64)
    return stored(coded(vectors, books, width), "coded"), books


def by_label(rows: DataFrame) -> DataFrame:
    """rows (with label and error) with label_error, the sum over equal labels; nulls are one label.

    Labels that hold a HOT-th of the rows, HOT at most, are broadcast; the others, none of which is large, meet in a shuffle.
    """
    totals = stored(rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"), F.count("*").alias("_n")), "labels")
    least = (totals.agg(F.sum("_n")).head()[0] or 0) / HOT
    hot, cold = totals.where(F.col("_n") > least), totals.where(F.col("_n") <= least)
    as_ = lambda df, n: df.select(F.col("label").alias(f"_{n}"), "label_error", F.lit(True).alias("_found"))
    one = rows.join(F.broadcast(as_(hot, "h")), F.col("label").eqNullSafe(F.col("_h")), "left")
    rest = one.where("_found is null").drop("_h", "label_error", "_found").join(as_(cold, "c"), F.col("label").eqNullSafe(F.col("_c")))
    return one.where("_found").select(*rows.columns, "label_error").unionByName(rest.select(*rows.columns, "label_error"))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def op12_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sound row of embeddings with its product code, what it loses, and what its label loses."""
    rows, books = fit(whole_vectors(table(spark, sf_dir, "embeddings")))
    return by_label(rows).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assigned(books: str, out: str) -> str:
    return f"""{out}_d AS (
  SELECT p.k, p.part, p.x, b.entry, b.e, list_sum(list_transform(range(1, len(p.x) + 1), lambda d: (p.x[d] - b.e[d]) * (p.x[d] - b.e[d])))::BIGINT AS dist FROM parts p JOIN {books} b USING (part)
), {out} AS (
  SELECT k, part, any_value(x) AS x, arg_min(entry, dist * 64 + entry) AS entry, min(dist) AS dist FROM {out}_d GROUP BY k, part
)"""


def _moved(books: str, codes: str, out: str) -> str:
    return f"""{out} AS (
  SELECT b.part, b.entry, CASE WHEN m.e IS NULL THEN b.e ELSE m.e END AS e FROM {books} b LEFT JOIN (
    SELECT part, entry, list(q ORDER BY d) AS e FROM (SELECT part, entry, d, floor(sum(v) / count(*))::BIGINT AS q FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS d FROM {codes}) GROUP BY 1, 2, 3) GROUP BY 1, 2) m USING (part, entry))"""


ORACLE = {
    "op12_ball_codes": f"""WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS k, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT k, part, v[part * len(v) // 16 + 1:(part + 1) * len(v) // 16] AS x FROM kept, unnest(range(16)) AS t(part)
), b0 AS (SELECT part, k AS entry, x AS e FROM parts WHERE k < 64
), {_assigned('b0', 'a0')}, {_moved('b0', 'a0', 'b1')}, {_assigned('b1', 'a1')}, {_moved('b1', 'a1', 'b2')}, {_assigned('b2', 'a2')},
codes AS (
  SELECT k, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a2 GROUP BY k
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256 FROM codes JOIN kept USING (k)"""
}

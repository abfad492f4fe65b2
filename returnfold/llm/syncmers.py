"""Document fingerprints from closed syncmers.

A k-mer of a text's UTF-8 bytes is chosen if the smallest hash among its s-mers is the first or the
last one. The choice depends on the k-mer alone, so an edit moves or loses no anchor that it does not
touch, and equal passages carry equal anchors at equal distances. A fingerprint keeps, for each of
SLOTS classes of anchor hashes, the smallest; likeness is the share of slots in use that agree,
an estimate of the Jaccard index of the two anchor sets.

Texts without an anchor (short ones) count as one anchor, the whole text; the empty text has none.

Null texts count as empty. Rows without a doc_id come first in the order of documents; rows of equal
doc_id are ordered by a hash of their text, and repeated rows follow one another. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ranges, table
from .token_shards import bucket_of, range_limits

K, S, SLOTS = 20, 12, 128
EMPTY = 0xFFFFFFFF
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose high and low bits are both even."""
    out = h >> np.uint64(29)
    out ^= h
    out *= _B
    out ^= out >> np.uint64(32)
    return out


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of each run of width bytes."""
    if len(data) < width:
        return np.empty(0, np.uint64)
    power, doubled, size = _A, data.astype(np.uint64) + np.uint64(1), 1
    out, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                n = len(data) - width + 1
                if out is None:
                    out, done = doubled, size
                else:
                    out = out[: len(data) - done - size + 1] * power
                    out += doubled[done : done + len(out)]
                    done += size
                if done == width:
                    return out[:n]
            longer = doubled[:-size] * power
            longer += doubled[size:]
            doubled, longer = longer, None
            power, size = power * power, size * 2


def closed_syncmers(data: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the chosen k-mers of a byte array."""
    if len(data) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = mixed(rolling(data, s))
    window = k - s + 1
    n, least, size = len(h) - window + 1, h, 1
    while size * 2 <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:n], least[window - size : window - size + n])
    at = np.flatnonzero((h[:n] == least) | (h[window - 1 :] == least))
    with np.errstate(over="ignore"):
        return at, mixed(h[at] * _A + h[at + window - 1])  # the two s-mers cover the k-mer when 2 s >= k


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """One row of SLOTS 32-bit numbers for each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    at, h = closed_syncmers(data)
    doc = np.searchsorted(ends, at, side="right")
    inside = at + K <= ends[doc] if len(at) else np.empty(0, bool)
    doc, h = doc[inside], h[inside]
    none = np.flatnonzero((np.bincount(doc, minlength=len(texts)) == 0) & (sizes > 0))
    whole = np.array([int.from_bytes(hashlib.blake2b(texts[i], digest_size=8).digest(), "little") for i in none], np.uint64)
    doc, h = np.concatenate([doc, none]), np.concatenate([h, whole])
    slot, value = (h & np.uint64(SLOTS - 1)).astype(np.int64), np.minimum(h >> np.uint64(32), EMPTY - 1).astype(np.uint32)
    order = np.argsort(value, kind="stable")[::-1]
    out = np.full(len(texts) * SLOTS, EMPTY, np.uint32)
    out[(doc * SLOTS + slot)[order]] = value[order]  # the last to be written is the smallest
    return out.reshape(len(texts), SLOTS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: the share of slots used by either that agree; 1 for two empty texts."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(1)
    same = ((a == b) & (a != EMPTY)).sum(1)
    return np.where(used == 0, 1.0, same / np.maximum(used, 1))


def shown(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows.astype(">u4")]


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, position, anchor): every chosen k-mer of (doc_id, text), for positional matching."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t in zip(batch.column("doc_id"), batch.column("text")):
                at, h = closed_syncmers(np.frombuffer((t.as_py() or "").encode(), np.uint8))
                yield pa.record_batch([pa.array([d.as_py()] * len(at), pa.int64()), pa.array(at), pa.array(h.view(np.int64))], ["doc_id", "position", "anchor"])

    return docs.select("doc_id", "text").mapInArrow(choose, "doc_id long, position long, anchor long")


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of (doc_id, text); a null text is empty."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.record_batch([part.column("doc_id"), pa.array(shown(fingerprints([(t or "").encode() for t in part.column("text").to_pylist()])))], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(make, "doc_id long, fingerprint string")


def with_following(docs: DataFrame, parts: int) -> DataFrame:
    """docs dealt by ranges of doc_id and sorted, each range ending with a peek row: the row that comes next.

    After the last row of all comes the first. Rows of equal doc_id are ordered by a hash of their text.
    The driver gets one row for each range.
    """
    dealt = docs.withColumn("h", F.xxhash64("text")).withColumn("bucket", bucket_of("doc_id", range_limits(docs, "doc_id", parts)))
    firsts = sorted((tuple(r) for r in dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("f")).select("bucket", "f.doc_id", "f.h").collect()), key=lambda r: r[0])
    peeks = docs.sparkSession.createDataFrame([(d, h, firsts[i - 1][0]) for i, (_, d, h) in enumerate(firsts)], "first long, first_h long, to int")
    peek = dealt.drop("bucket").join(F.broadcast(peeks), F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("h") == F.col("first_h"))).dropDuplicates(["to"]).withColumnRenamed("to", "bucket").withColumn("peek", F.lit(True))
    return dealt.withColumn("peek", F.lit(False)).unionByName(peek.select("doc_id", "text", "h", "bucket", "peek")).repartition(parts, "bucket").sortWithinPartitions("bucket", "peek", "doc_id", "h").select("bucket", "peek", "doc_id", "text")


def _compared(batches: Iterator[pa.RecordBatch], most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket in order, the peek row last; works on some MB of texts at a time."""

    def work(held: list) -> pa.RecordBatch:
        ids, texts = [d for _, d, _ in held[:-1]], [t for _, _, t in held]
        edited = [(t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode() for t, n in zip(texts, texts[1:])]
        own, new = fingerprints([t.encode() for t in texts]), fingerprints(edited)
        return pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]), pa.array(shown(own[:-1])), pa.array(shown(new)), pa.array(likeness(own[:-1], new)), pa.array(likeness(own[:-1], own[1:]))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    held, size = [], 0
    for batch in batches:
        for bucket, doc_id, text in zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
            if held and (bucket != held[-1][0] or size >= most_bytes):
                if len(held) > 1:
                    yield work(held)
                held, size = held[-1:] if bucket == held[-1][0] else [], 0
            held.append((bucket, doc_id, text.as_py()))
            size += len(held[-1][2])
    if len(held) > 1:
        yield work(held)


def compare_edits(docs: DataFrame, parts: int) -> DataFrame:
    """For each (doc_id, text): its fingerprint, that of its edited text, and both likenesses."""
    return with_following(docs, parts).mapInArrow(_compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _edits(docs: DataFrame) -> DataFrame:
    return compare_edits(docs, ranges(docs))


def op4_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fingerprints of documents and of their edited texts."""
    return _edits(documents(table(spark, sf_dir, "documents")))

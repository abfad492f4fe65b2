"""Token-id output as wavelet-matrix shards.

A shard holds the ids of some whole documents, in ascending doc_id, as one self-contained file body:
header, document table, sorted alphabet, and one bit plane per bit of the alphabet's codes, each with
a rank directory. From it a token is read at any place, counted up to any place, and all its places
are found by reading a few blocks of each plane, without decoding the rest. Shards are the rows of a
Parquet table: Spark's committer then gives whole files even when executors are lost, and any store
that Spark reads will do.

Documents without a doc_id come first. Null and empty texts have no ids but the end id. Rows of equal
doc_id, repeated rows among them, follow one another in the order of their ids' crc32. A text of any
length stays in one shard. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import documents, ranges, scratch, sliced, table, trim
from .words import WordIds, tokenizer_path

#: Fixed values of the file format.
MAGIC, BLOCK, NO_ID = b"WVM2", 512, -(1 << 63)
SHARD_TOKENS = 1 << 18


class WaveletMatrix:
    """Bit planes of a sequence of small codes, with rank and select."""

    def __init__(self, planes: list[np.ndarray], n: int, alphabet: np.ndarray, ranks: list[np.ndarray] | None = None):
        self.planes, self.n, self.alphabet = planes, n, alphabet
        self.ranks = [self._directory(p) for p in planes] if ranks is None else ranks
        self.zeros = [n - int(r[-1]) for r in self.ranks]

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each block of BLOCK bits, and at the end."""
        ones = np.bitwise_count(plane).astype(np.uint32)
        pad = -len(ones) % (BLOCK // 8)
        return np.concatenate([[0], np.cumsum(np.pad(ones, (0, pad)).reshape(-1, BLOCK // 8).sum(1))]).astype("<u4")

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        alphabet = np.flatnonzero(np.bincount(ids)) if len(ids) else np.empty(0, np.int64)
        dense = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.uint32)
        dense[alphabet] = np.arange(len(alphabet))
        codes = dense[ids].astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        levels, planes = max(1, (len(alphabet) - 1).bit_length()), []
        for level in reversed(range(levels)):
            one = ((codes >> level) & 1).astype(bool)
            planes.append(np.packbits(one))
            codes = np.concatenate([codes.take(np.flatnonzero(~one)), codes.take(np.flatnonzero(one))])
        return cls(planes, len(ids), alphabet.astype(np.uint32))

    def decode(self) -> np.ndarray:
        """All ids: codes gain a bit at each plane, from the last to the first."""
        codes = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for level, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            one = np.unpackbits(plane, count=self.n).view(bool)
            above = np.empty_like(codes)
            above[np.flatnonzero(~one)] = codes[:zeros]
            above[np.flatnonzero(one)] = codes[zeros:] | codes.dtype.type(1 << level)
            codes = above
        return self.alphabet[codes] if self.n else np.empty(0, np.uint32)

    def _rank1(self, level: int, i: int) -> int:
        block = i // BLOCK
        at = block * BLOCK // 8
        inside = np.unpackbits(self.planes[level][at : at + BLOCK // 8])[: i - block * BLOCK]
        return int(self.ranks[level][block]) + int(inside.sum())

    def access(self, i: int) -> int:
        code = 0
        for level in range(len(self.planes)):
            one = self.planes[level][i >> 3] >> (7 - (i & 7)) & 1
            r = self._rank1(level, i)
            i = self.zeros[level] + r if one else i - r
            code = code << 1 | int(one)
        return int(self.alphabet[code])

    def _code(self, token: int) -> int:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else -1

    def _interval(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's places before i stand below the last plane."""
        code, lo, hi = self._code(token), 0, i
        for level in range(len(self.planes)):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if code >> (len(self.planes) - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often token stands before place i."""
        if self._code(token) < 0:
            return 0
        lo, hi = self._interval(token, min(i, self.n))
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Places of the k-th bits of this kind (from 0)."""
        ones = self.ranks[level].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = np.searchsorted(before[:-1], k, side="right") - 1
        used, of = np.unique(block, return_inverse=True)
        bits = np.zeros((len(used), BLOCK // 8), np.uint8)
        for row, b in zip(bits, used.tolist()):
            part = self.planes[level][b * BLOCK // 8 : (b + 1) * BLOCK // 8]
            row[: len(part)] = part
        seen = np.cumsum(np.unpackbits(bits, axis=1) == bit, axis=1, dtype=np.int16)
        inside = [int(np.searchsorted(seen[o], r)) for o, r in zip(of.tolist(), (k - before[block] + 1).tolist())]
        return block * BLOCK + np.array(inside, np.int64)

    def _above(self, token: int, at: np.ndarray) -> np.ndarray:
        """Places of the token whose places below the last plane are at."""
        code = self._code(token)
        for level in reversed(range(len(self.planes))):
            one = code >> (len(self.planes) - 1 - level) & 1
            at = self._select_bit(level, one, at - self.zeros[level] if one else at)
        return at

    def select(self, token: int, k: int) -> int:
        """Place of the token's k-th occurrence (from 0); -1 if it has none."""
        if k < 0 or k >= self.count(token):
            return -1
        return int(self._above(token, np.array([self._interval(token, self.n)[0] + k]))[0])

    def places(self, token: int) -> list[int]:
        """All places of the token, in order."""
        if self._code(token) < 0:
            return []
        lo, hi = self._interval(token, self.n)
        return np.concatenate([np.empty(0, np.int64), *(self._above(token, np.arange(k, min(hi, k + 10_000))) for k in range(lo, hi, 10_000))]).tolist()


def pack_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The file body of these documents."""
    m = WaveletMatrix.build(ids)
    docs = zlib.compress(np.asarray(doc_ids, "<i8").tobytes() + np.asarray(lengths, "<u4").tobytes(), 1)
    alphabet = zlib.compress(np.diff(m.alphabet, prepend=np.uint32(0)).astype("<u4").tobytes(), 1)
    head = MAGIC + struct.pack("<IIIIII", len(doc_ids), m.n, len(m.alphabet), len(m.planes), len(docs), len(alphabet))
    return b"".join([head, docs, alphabet, *(p.tobytes() for p in m.planes), *(r.tobytes() for r in m.ranks)])


def open_shard(body: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """(doc ids, lengths, matrix) of a file body."""
    if body[:4] != MAGIC:
        raise ValueError("not a wavelet shard")
    n_docs, n, sigma, levels, a, b = struct.unpack_from("<IIIIII", body, 4)
    docs, alphabet = zlib.decompress(body[28 : 28 + a]), zlib.decompress(body[28 + a : 28 + a + b])
    ids, lengths = np.frombuffer(docs, "<i8", n_docs), np.frombuffer(docs, "<u4", n_docs, 8 * n_docs)
    size, at = (n + 7) // 8, 28 + a + b
    planes = [np.frombuffer(body, np.uint8, size, at + i * size) for i in range(levels)]
    at, blocks = at + levels * size, -(-size // (BLOCK // 8)) + 1
    ranks = [np.frombuffer(body, "<u4", blocks, at + i * 4 * blocks) for i in range(levels)]
    return ids, lengths, WaveletMatrix(planes, n, np.cumsum(np.frombuffer(alphabet, "<u4", sigma)).astype(np.uint32), ranks)


def _named(doc_ids: np.ndarray) -> pa.Array:
    return pa.array(doc_ids, mask=doc_ids == NO_ID)


def token_rows(docs: DataFrame, path: str, end_id: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers, end_id appended."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        for batch in batches:
            for part in sliced(batch, "text"):
                ids, n = words.encode(part.column("text"))
                if end_id is not None:
                    ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                offsets = np.concatenate([[0], np.cumsum(n)])
                body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((offsets * 4).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), body.cast(pa.binary())], ["doc_id", "n_tokens", "ids"])
        del words
        trim()

    return docs.mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def range_limits(df: DataFrame, column: str, parts: int) -> list[int]:
    """parts - 1 ascending limits that share out the rows by a bounded sketch of column."""
    if parts < 2:
        return []
    return sorted(set(df.select(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10_000)).head()[0] or []))


def bucket_of(column: str, limits: list[int]):
    """The range that a value is in; nulls are in the first."""
    return F.aggregate(F.array(*map(F.lit, limits)), F.lit(0), lambda n, x: n + F.coalesce(F.col(column) >= x, F.lit(False)).cast("int")) if limits else F.lit(0)


def write_shards(tokens: DataFrame, limits: list[int], path: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes (doc_id, ids) as shards of at least shard_tokens ids (but for the last of each range of doc_id).

    Documents are never cut, so a longer one makes a longer shard. start: ids before the shard in its range.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, start, held, size = None, 0, [], 0

        def shard() -> pa.RecordBatch:
            doc_ids, bodies = [d for d, _ in held], [b for _, b in held]
            body = pack_shard(np.array([NO_ID if d is None else d for d in doc_ids], np.int64), np.array([len(b) // 4 for b in bodies]), np.frombuffer(b"".join(bodies), "<u4"))
            return pa.record_batch([[bucket], [start], [doc_ids[0]], [len(doc_ids)], [size], [body]], schema=schema)

        schema = pa.schema([("bucket", pa.int32()), ("start", pa.int64()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("body", pa.binary())])
        for batch in batches:
            for b, d, ids in zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                if held and (b != bucket or size >= shard_tokens):
                    yield shard()
                    start, held, size = start + size, [], 0
                if b != bucket:
                    bucket, start = b, 0
                held.append((d, ids.as_py()))
                size += len(held[-1][1]) // 4
        if held:
            yield shard()

    dealt = tokens.withColumn("bucket", bucket_of("doc_id", limits)).repartition(len(limits) + 1, "bucket").sortWithinPartitions("bucket", "doc_id", F.crc32("ids"))
    dealt.mapInArrow(pack, "bucket int, start long, first_doc long, n_docs long, n_tokens long, body binary").write.parquet(path)


def shard_offsets(shards: DataFrame) -> DataFrame:
    """(bucket, base): ids in all earlier ranges; one row per range, of which there are few."""
    return shards.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).select("bucket", F.coalesce(F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shards at path."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, start, body in zip(batch.column("bucket"), batch.column("start"), batch.column("body")):
                doc_ids, lengths, m = open_shard(body.as_py())
                raw, n = memoryview(m.decode().astype("<u4").tobytes()), lengths.astype(np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.record_batch([pa.array(np.full(len(n), bucket.as_py(), np.int32)), _named(doc_ids), pa.array(start.as_py() + ends - n), pa.array(n), pa.array(crc, pa.int64())], ["bucket", "doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.read.parquet(path)
    docs = shards.select("bucket", "start", "body").mapInArrow(unpack, "bucket int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(shard_offsets(shards)), "bucket").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, position): every place of a token, by select on each shard."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body"):
                doc_ids, lengths, m = open_shard(body.as_py())
                at, ends = np.array(m.places(token), np.int64), np.cumsum(lengths.astype(np.int64))
                doc = np.searchsorted(ends, at, side="right")
                yield pa.record_batch([_named(doc_ids[doc]), pa.array(at - (ends - lengths)[doc])], ["doc_id", "position"])

    return spark.read.parquet(path).select("body").mapInArrow(find, "doc_id long, position long")


def count_token(spark: SparkSession, path: str, token: int) -> int:
    """Occurrences of a token in all shards, by rank."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([open_shard(b.as_py())[2].count(token) for b in batch.column("body")], pa.int64())], ["n"])

    return spark.read.parquet(path).select("body").mapInArrow(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]


def op1_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: encode documents, write shards in ascending doc_id, report what the shards hold."""
    docs = documents(table(spark, sf_dir, "documents"))
    path = scratch(spark, "wavelet")
    tokens = token_rows(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)
    write_shards(tokens, range_limits(docs, "doc_id", ranges(docs)), path)
    return read_documents(spark, path)

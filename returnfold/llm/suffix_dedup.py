"""Removal of long byte strings that repeat across documents, by sorted suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts in a document of smaller doc_id.

Sorting all suffixes would move each byte LENGTH times, so suffixes travel in runs. The anchor of a
suffix is, in its first LENGTH bytes, the K bytes of least hash; equal suffixes have equal anchors at
equal places, and suffixes that follow one another mostly share theirs. A run is the bytes of such
suffixes: some twenty of them in about LENGTH + 20 bytes.

1. Documents are stored in chunks of some MB. Each chunk asks, of its anchors' hashes, which stand in
   several documents; most don't, and their suffixes are done.
2. Sampled splitters range-partition the other runs by their anchors' leading bytes. A chunk sends
   each different run once, with the least doc_id that has it. An anchor with very many different runs
   (the edge of a passage that many documents share) sends its suffixes one by one instead, partitioned
   by their own leading bytes, so that no bucket holds all of them.
3. A bucket takes its runs apart into suffixes, sorts them by multikey quicksort with eight bytes as a
   symbol, to a depth of LENGTH, and gives each string the least doc_id of all that are equal to it.
   Equal strings have one route, so none is divided by a boundary between buckets; the least doc_ids
   go back to each chunk, which compares them with its own documents.

A null text is empty. A null doc_id counts as larger than all others. Rows that share a doc_id don't
take from each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, sliced, stored, table, trim, trimmed
from .syncmers import mixed, rolling

LENGTH, K, LEAD = 50, 16, 16
CHUNK_BYTES, BUCKET_BYTES, HOT, SAMPLE = 2 << 20, 12 << 20, 512, 200_000
NO_DOC = np.iinfo(np.int64).max


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return np.array([a.nbytes for a in arrays], "<u8").tobytes() + zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(raw: bytes, *kinds) -> list[np.ndarray]:
    import zstandard

    sizes = np.frombuffer(raw, "<u8", len(kinds)).tolist()
    body, at, out = zstandard.ZstdDecompressor().decompress(raw[8 * len(kinds) :], max_output_size=max(1, sum(sizes))), 0, []
    for kind, size in zip(kinds, sizes):
        out.append(np.frombuffer(body, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, for each i in turn."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _taken(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at_once: int = 1 << 14) -> np.ndarray:
    """data[starts[i] : starts[i] + sizes[i]] for each i in turn; at_once of them are worked out together, as places take eight times the bytes."""
    out, done = np.empty(int(sizes.sum()), data.dtype), 0
    for k in range(0, len(starts), at_once):
        part = data[_spread(starts[k : k + at_once], sizes[k : k + at_once])]
        out[done : done + len(part)] = part
        done += len(part)
    return out


def _hashes(data: np.ndarray, width: int, at_once: int = 1 << 18) -> np.ndarray:
    """mixed(rolling(data, width)), at_once places at a time."""
    out = np.empty(max(0, len(data) - width + 1), np.uint64)
    for k in range(0, len(out), at_once):
        out[k : k + at_once] = mixed(rolling(data[k : k + at_once + width - 1], width))
    return out


def _least_places(h: np.ndarray, width: int, at_once: int = 1 << 18) -> np.ndarray:
    """Where the least high half of each width hashes stands, the first of equal ones; at_once of them at a time."""
    out = np.empty(len(h) - width + 1, np.uint32)
    for k in range(0, len(out), at_once):
        part, size = h[k : k + at_once + width - 1], 1
        windows = len(part) - width + 1
        least = (part >> np.uint64(32) << np.uint64(32)) | np.arange(k, k + len(part), dtype=np.uint64)
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        out[k : k + windows] = np.minimum(least[:windows], least[width - size : width - size + windows]) & np.uint64(0xFFFFFFFF)
    return out


class Chunk:
    """Some whole documents, and the runs of their suffixes."""

    def __init__(self, body: bytes):
        self.ids, self.sizes, self.data = _unpack(body, np.int64, np.int64, np.uint8)
        self.ends = np.cumsum(self.sizes)

    @staticmethod
    def body(ids: list, texts: list[bytes]) -> bytes:
        return _pack(np.array([NO_DOC if i is None else i for i in ids], np.int64), np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8))

    def find_runs(self) -> None:
        """start, count, anchor and doc of each run; key: a hash of its anchor, mixed anew, as those of anchors are the least of many and crowd at 0."""
        data, windows = self.data, len(self.data) - LENGTH + 1
        self.start = self.count = self.anchor = self.doc = np.empty(0, np.int64)
        self.key = np.empty(0, np.uint64)
        if windows < 1:
            return
        h = _hashes(data, K)
        least = _least_places(h, LENGTH - K + 1)
        inside = np.zeros(windows + 1, np.int32)
        long = self.sizes >= LENGTH
        np.add.at(inside, (self.ends - self.sizes)[long], 1)
        np.add.at(inside, (self.ends - LENGTH + 1)[long], -1)
        inside = np.cumsum(inside[:windows], dtype=np.int32) > 0
        first = inside.copy()
        first[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)) < 0)
        self.start = np.flatnonzero(first)
        self.count = np.minimum(np.append(self.start[1:], windows), edge[np.searchsorted(edge, self.start, side="right")]) - self.start
        self.anchor = least[self.start].astype(np.int64)
        self.key = mixed(h[self.anchor])
        self.doc = self.ids[np.searchsorted(self.ends, self.start, side="right")]

    def questions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(different keys in order, whether several documents have one, number of different runs of each)."""
        if not len(self.key):
            return self.key, np.empty(0, bool), np.empty(0, np.int64)
        whole = _hashes(self.data, LENGTH)
        run = mixed(whole[self.start] + mixed(whole[self.start + self.count - 1] + self.count.astype(np.uint64)))
        order = np.lexsort((run, self.key))
        key, run, doc = self.key[order], run[order], self.doc[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.flatnonzero(new)
        different = np.add.reduceat(new | np.concatenate([[True], run[1:] != run[:-1]]), at)
        return key[at], np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at), different

    def records(self, answers: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What to send, given an answer (0 own, 1 shared, 2 hot) to each question.

        (different records, their leading places, their least doc_ids; and of each occurrence: first suffix, record).
        """
        said = answers[np.searchsorted(np.unique(self.key), self.key)] if len(self.key) else np.empty(0, np.uint8)
        shared, hot = said == 1, said == 2
        single = _spread(self.start[hot], self.count[hot])
        start = np.concatenate([self.start[shared], single])
        count = np.concatenate([self.count[shared], np.ones(len(single), np.int64)])
        lead = np.concatenate([self.anchor[shared], single]) - start
        doc = np.concatenate([self.doc[shared], np.repeat(self.doc[hot], self.count[hot])])
        size = count + LENGTH - 1
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(_taken(self.data, start, size))])
        coded = texts.dictionary_encode()
        code = np.asarray(coded.indices).astype(np.int64)
        least, leads = np.full(len(coded.dictionary), NO_DOC), np.zeros(len(coded.dictionary), np.int64)
        np.minimum.at(least, code, doc)
        leads[code] = lead
        return coded.dictionary, leads, least, start, code


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a large binary array that starts at its buffers' start."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]] if len(texts) else np.empty(0, np.uint8), offsets


def _lead_of(data: np.ndarray, at: np.ndarray, at_once: int = 1 << 14) -> np.ndarray:
    """The LEAD bytes from each place on; at_once of them are taken together."""
    out = np.empty((len(at), LEAD), np.uint8)
    for k in range(0, len(at), at_once):
        out[k : k + at_once] = data[at[k : k + at_once, None] + np.arange(LEAD)]
    return out.view(f"S{LEAD}").ravel()


def multikey_runs(data: np.ndarray, at: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """A number for each suffix; equal for suffixes whose first depth bytes are equal.

    Multikey quicksort with eight bytes as a symbol: sorts by the first symbol, then only those that are
    still equal to another by the next one.
    """
    word = np.ndarray(max(len(data) - 7, 0), ">u8", data, strides=(1,))
    run, active, top = np.zeros(len(at), np.int64), np.arange(len(at)), 0
    for off in [*range(0, depth - 7, 8), depth - 8]:
        if not len(active):
            break
        symbol = word[at[active] + off].astype(np.uint64)
        order = np.lexsort((symbol, run[active])) if off else np.argsort(symbol, kind="stable")
        active, symbol = active[order], symbol[order]
        new = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (run[active][1:] != run[active][:-1])])
        run[active] = top + np.cumsum(new)
        top += int(new.sum())
        alone = new & np.append(new[1:], True)
        active = active[~alone]
    return run


def _store_chunks(docs: DataFrame) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            for piece in sliced(batch, "text", CHUNK_BYTES):
                texts = [t.as_py().encode() for t in piece.column("text")]
                yield pa.record_batch([pa.array([part << 32 | n]), pa.array([sum(map(len, texts))]), pa.array([Chunk.body(piece.column("doc_id").to_pylist(), texts)])], ["chunk", "size", "body"])
                n += 1

    return stored(docs.mapInArrow(pack, "chunk long, size long, body binary"), "chunks")


def _ask(chunks: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, answers): for each chunk and range of hashes, what Chunk.records() needs to know."""

    def questions(number: int, body: bytes) -> pa.RecordBatch:
        chunk = Chunk(body)
        chunk.find_runs()
        key, several, different = chunk.questions()
        cuts = np.searchsorted((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
        note = np.minimum(different, 127).astype(np.uint8) | several.astype(np.uint8) << 7
        some = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
        return pa.record_batch([pa.array(some, pa.int32()), pa.array([number] * len(some), pa.int64()), pa.array([_pack(key[cuts[b] : cuts[b + 1]].astype(np.uint32), note[cuts[b] : cuts[b + 1]]) for b in some], pa.binary())], ["bucket", "chunk", "asked"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch.column("chunk").to_pylist(), batch.column("body")):
                yield trimmed(questions, number, body.as_py())

    def answers(rows: pa.Table) -> pa.Table:
        asked = [_unpack(x.as_py(), np.uint32, np.uint8) for x in rows.column("asked")]
        _, where, chunks_with = np.unique(np.concatenate([k for k, _ in asked]), return_inverse=True, return_counts=True)
        note = np.concatenate([n for _, n in asked])
        different = np.bincount(where, note & 127)
        shared = (chunks_with > 1) | (np.bincount(where, note >> 7) > 0)
        said = (shared.astype(np.uint8) + (shared & (different >= HOT) & (different >= 4 * chunks_with)))[where]
        parts = np.split(said, np.cumsum([len(k) for k, _ in asked])[:-1])
        return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "answers": pa.array([_pack(p) for p in parts], pa.binary())})

    def answer(rows: pa.Table) -> pa.Table:
        return trimmed(answers, rows)

    return chunks.select("chunk", "body").mapInArrow(ask, "bucket int, chunk long, asked binary").groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, answers binary")


def _splitters(chunks: DataFrame, buckets: int, n_chunks: int) -> np.ndarray:
    """buckets - 1 leading strings that share out the anchors, from at most about SAMPLE of them."""
    quota = max(1, SAMPLE // max(1, n_chunks))

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body"):
                chunk = Chunk(body.as_py())
                chunk.find_runs()
                at = chunk.anchor[np.argsort(mixed(chunk.key), kind="stable")[:: max(1, len(chunk.key) // quota)][:quota]]
                yield pa.record_batch([pa.array([bytes(x) for x in chunk.data[at[:, None] + np.arange(LEAD)]] if len(at) else [], pa.binary())], ["lead"])
                del chunk, at
                trim()

    some = chunks.sample(min(1.0, SAMPLE / max(1, n_chunks)), seed=1) if n_chunks > SAMPLE else chunks
    found = np.sort(np.array([r.as_py() for r in some.select("body").mapInArrow(leads, "lead binary").toArrow().column("lead")], f"S{LEAD}"))
    return np.unique(found[np.arange(1, buckets) * len(found) // buckets]) if len(found) else found


def _least_of_equals(texts: pa.Array, leads: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each run, number of suffixes of each different text, for each of those the least doc_id of all that are equal to it)."""
    coded = texts.dictionary_encode()
    code, (data, offsets) = np.asarray(coded.indices), _bytes_of(coded.dictionary)
    first, lead = np.full(len(offsets) - 1, NO_DOC), np.zeros(len(offsets) - 1, np.int64)
    np.minimum.at(first, code, least)
    lead[code] = leads
    count = np.diff(offsets) - LENGTH + 1
    _, kmer, alike = np.unique(_lead_of(data, offsets[:-1] + lead), return_inverse=True, return_counts=True)
    mixed_up = np.flatnonzero(alike[kmer] > 1)  # the others' strings stand in one run only
    answer = np.repeat(first, count)
    if len(mixed_up):
        place = _spread((np.cumsum(count) - count)[mixed_up], count[mixed_up])
        run = multikey_runs(data, _spread(offsets[:-1][mixed_up], count[mixed_up]))
        lowest = np.full(int(run.max()) + 1, NO_DOC)
        np.minimum.at(lowest, run, answer[place])
        answer[place] = lowest[run]
    return code, count, answer


def settled(messages: pa.ChunkedArray, at_once: int = 1 << 18) -> pa.Array:
    """For each message of runs, packed: for each suffix of its runs, the least doc_id that any message has for an equal string, packed.

    Runs are worked through in order of their leads, some at_once suffixes together; equal strings have equal leads, and runs of
    one lead are never divided.
    """
    many, parts = [], [bytearray() for _ in range(4)]
    for x in messages:
        got = _unpack(x.as_py(), np.uint8, np.uint8, np.int64, np.uint8)
        many.append(len(got[0]))
        for whole, part in zip(parts, got):
            whole += part.data
    size, leads, least, data = (np.frombuffer(p, kind) for p, kind in zip(parts, (np.uint8, np.uint8, np.int64, np.uint8)))
    starts = np.cumsum(size, dtype=np.int64) - size
    lead = _lead_of(data, starts + leads)
    order = np.argsort(lead, kind="stable")
    lead, done = lead[order], np.cumsum(size[order] - (LENGTH - 1), dtype=np.int64)
    code, counts, answers, at, n = np.empty(len(size), np.int64), [], bytearray(), 0, 0
    while at < len(order):
        full = int(np.searchsorted(done, (done[at - 1] if at else 0) + at_once))
        to = int(np.searchsorted(lead, lead[min(full, len(order) - 1)], side="right"))
        own = order[at:to]
        offsets = np.concatenate([[0], np.cumsum(size[own], dtype=np.int64)])
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(_taken(data, starts[own], size[own].astype(np.int64)))])
        text, count, answer = _least_of_equals(texts, leads[own].astype(np.int64), least[own])
        code[own] = n + text
        counts.append(count)
        answers += answer.data
        at, n = to, n + len(count)
    del data, parts, lead, order, done
    count, answer = np.concatenate(counts) if counts else np.empty(0, np.int64), np.frombuffer(answers, np.int64)
    begins = np.cumsum(count) - count
    return pa.array([_pack(_taken(answer, begins[own], count[own])) for own in np.split(code, np.cumsum(many)[:-1])], pa.binary())


def _answered(chunk: Chunk, replies: list) -> np.ndarray:
    """The answers to all of a chunk's questions, in order of its keys."""
    said = {b: _unpack(x, np.uint8)[0] for b, x in replies or []}
    return np.concatenate([said[b] for b in sorted(said)]) if said else np.empty(0, np.uint8)


def removed_bytes(docs: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """What finish, a function of Arrow batches (doc_id, bytes, gone) to those of schema, makes of each document.

    gone is a bit for each byte of the text, set where it goes.
    """
    spark, chunks = docs.sparkSession, _store_chunks(docs)
    total, n_chunks = chunks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).head()
    buckets = max(1, -(-total // BUCKET_BYTES))
    listed = lambda df, col: df.groupBy("chunk").agg(F.collect_list(F.struct("bucket", col)).alias(col))
    answers = stored(listed(_ask(chunks, buckets), "answers"), "answers")
    cuts = spark.sparkContext.broadcast(_splitters(chunks, buckets, n_chunks))

    def routed(chunk: Chunk, replies) -> tuple:
        chunk.find_runs()
        texts, leads, least, start, code = chunk.records(_answered(chunk, replies))
        data, offsets = _bytes_of(texts)
        bucket = np.searchsorted(cuts.value, _lead_of(data, offsets[:-1] + leads), side="right") if len(texts) else np.empty(0, np.int64)
        order = np.argsort(bucket, kind="stable")
        return data, offsets, leads, least, start, code, bucket, order

    def sent(number: int, body: bytes, replies: list) -> pa.RecordBatch:
        data, offsets, leads, least, _, _, bucket, order = routed(Chunk(body), replies)
        size, (some, begins) = np.diff(offsets), np.unique(bucket[order], return_index=True)
        runs = []
        for own in np.split(order, begins[1:]) if len(some) else []:
            runs.append(_pack(size[own].astype(np.uint8), leads[own].astype(np.uint8), least[own], _taken(data, offsets[own], size[own])))
        return pa.record_batch([pa.array(some, pa.int32()), pa.array([number] * len(some), pa.int64()), pa.array(runs, pa.binary())], ["bucket", "chunk", "runs"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body, replies in zip(batch.column("chunk").to_pylist(), batch.column("body"), batch.column("answers")):
                yield trimmed(sent, number, body.as_py(), [(r["bucket"], r["answers"]) for r in replies.as_py() or []])

    def settle(rows: pa.Table) -> pa.Table:
        return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "least": trimmed(settled, rows.column("runs"))})

    def judged(body: bytes, replies: list, found: list) -> tuple[Chunk, np.ndarray]:
        chunk = Chunk(body)
        _, offsets, _, _, start, code, bucket, order = routed(chunk, replies)
        count = np.diff(offsets) - LENGTH + 1
        said = {b: _unpack(x, np.int64)[0] for b, x in found}
        least = np.concatenate([said[b] for b in np.unique(bucket).tolist()]) if said else np.empty(0, np.int64)
        begins = np.empty(len(count), np.int64)
        begins[order] = np.cumsum(count[order]) - count[order]
        suffix = _spread(start, count[code])
        earlier = _taken(least, begins[code], count[code]) < np.repeat(chunk.ids[np.searchsorted(chunk.ends, start, side="right")], count[code])
        suffix = suffix[earlier]
        change = np.zeros(len(chunk.data) + 1, np.int32)
        np.add.at(change, suffix, 1)
        np.add.at(change, suffix + LENGTH, -1)
        return chunk, np.cumsum(change[:-1], dtype=np.int32) > 0

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, replies, found in zip(batch.column("body"), batch.column("answers"), batch.column("least")):
                chunk, gone = trimmed(judged, body.as_py(), [(r["bucket"], r["answers"]) for r in replies.as_py() or []], [(r["bucket"], r["least"]) for r in found.as_py() or []])
                for lo in range(0, len(chunk.sizes), 2000):  # a chunk may hold very many short documents
                    part = slice(lo, lo + 2000)
                    spans = list(zip((chunk.ends - chunk.sizes)[part].tolist(), chunk.ends[part].tolist()))
                    yield finish(pa.record_batch(
                        [pa.array([None if i == NO_DOC else i for i in chunk.ids[part].tolist()], pa.int64()), pa.array([chunk.data[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([np.packbits(gone[a:b]).tobytes() for a, b in spans], pa.binary())],
                        ["doc_id", "bytes", "gone"],
                    ))
                del chunk, gone
                trim()

    asked = chunks.join(answers, "chunk", "left").select("chunk", "body", "answers")
    least = listed(asked.mapInArrow(send, "bucket int, chunk long, runs binary").groupBy("bucket").applyInArrow(settle, "chunk long, bucket int, least binary"), "least")
    return asked.join(least, "chunk", "left").select("body", "answers", "least").mapInArrow(apply, schema)


def removals(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text); with_text: and text_md5 and kept, what stays.

    kept_sha256 is of the bytes that stay; of a character that is cut in two, kept has nothing. text_md5
    is that of the whole text, which tells rows apart that share a doc_id.
    """

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["text_md5", "kept"] * with_text]

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for raw, bits in zip(batch.column("bytes"), batch.column("gone")):
            data = np.frombuffer(raw.as_py(), np.uint8)
            gone = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=len(data)).view(bool)
            kept = data[~gone].tobytes() if gone.any() else raw.as_py()
            rows.append((len(data), int(gone.sum()), int((np.diff(gone.view(np.int8), prepend=np.int8(0)) > 0).sum()), hashlib.sha256(kept).hexdigest(), *([hashlib.md5(raw.as_py()).hexdigest(), kept.decode(errors="ignore")] if with_text else [])))
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [()] * 6, [pa.int64()] * 3 + [pa.string()] * 3)]
        return pa.record_batch([batch.column("doc_id"), *columns[: len(names) - 1]], names)

    return removed_bytes(docs, count, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text_md5 string, kept string" * with_text)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: documents without strings of 50 bytes that start in earlier ones."""
    return removals(documents(table(spark, sf_dir, "documents")))

"""What a task takes beside its result, what it leaves to its worker, and rounds that are not needed."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from returnfold.llm import near_copies, suffix_dedup, words


def test_gathering_rows_takes_little_beside_its_result():
    rows = words.Ragged()
    rows.add(range(4))
    tracemalloc.start()
    flat, n = rows.gather(np.zeros(1_000_000, np.int64))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert flat.reshape(-1, 4).tolist()[-1] == [0, 1, 2, 3] and n.sum() == len(flat) == 4_000_000
    assert most < 2 * (flat.nbytes + n.nbytes)


def test_a_task_encodes_without_threads_of_the_library(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    words.WordIds(words.tokenizer_path("word_bpe_49k.json"))
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_runs_of_a_chunk_take_little_a_byte():
    text = np.random.default_rng(4).integers(97, 123, 1 << 20, dtype=np.uint8).tobytes()
    body = suffix_dedup.Chunk.body([1], [text])
    tracemalloc.start()
    chunk = suffix_dedup.Chunk(body)
    chunk.find_runs()
    runs = tracemalloc.get_traced_memory()[1]
    chunk.records(np.ones(len(np.unique(chunk.key)), np.uint8))
    records = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert chunk.count.sum() == len(text) - suffix_dedup.LENGTH + 1
    assert runs < 30 * len(text) and records < 45 * len(text)


def test_first_classes_need_no_rounds(spark, monkeypatch):
    calls, real = [], near_copies.components
    monkeypatch.setattr(near_copies, "components", lambda edges: calls.append(edges.count()) or real(edges))
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join([*base[: 190 + i], f"end{i}"])) for i in range(6)]  # all like one another: one leader joins them
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    bands = texts.select(F.col("doc_id").alias("node"), F.lit(1).cast("long").alias("key"))
    got = {r["node"]: r["component"] for r in near_copies.links(texts, bands)[1].collect()}
    assert got == dict.fromkeys(range(6), 0)
    assert sum(calls) == 0


def test_questions_are_dealt_evenly():
    text = np.random.default_rng(5).integers(97, 123, 1 << 19, dtype=np.uint8).tobytes()
    chunk = suffix_dedup.Chunk(suffix_dedup.Chunk.body([1], [text]))
    chunk.find_runs()
    key, _, _ = chunk.questions()
    assert np.bincount((key >> np.uint64(58)).astype(int), minlength=64).max() < 1.5 * len(key) / 64


def _bucket(size: int, parts: int = 40) -> tuple[list, pa.ChunkedArray]:
    """(doc, runs) and message of each part of two texts that share most strings."""
    text = np.random.default_rng(6).integers(97, 123, size, dtype=np.uint8)
    other = text.copy()
    other[::90] = ord("-")
    said, messages = [], []
    for doc, data in ((7, text), (3, other)):
        chunk = suffix_dedup.Chunk(suffix_dedup.Chunk.body([doc], [data.tobytes()]))
        chunk.find_runs()
        runs, leads, least, *_ = chunk.records(np.ones(len(np.unique(chunk.key)), np.uint8))
        flat, offsets = suffix_dedup._bytes_of(runs)
        for own in np.array_split(np.arange(len(runs)), parts):
            said.append((doc, runs.take(pa.array(own)).to_pylist()))
            messages.append(suffix_dedup._pack(np.diff(offsets)[own].astype(np.uint8), leads[own].astype(np.uint8), least[own], flat[offsets[own[0]] : offsets[own[-1] + 1]]))
    return said, pa.chunked_array([pa.array(messages, pa.binary())])


def test_settling_a_bucket_takes_little_a_byte():
    said, messages = _bucket(1 << 20)
    tracemalloc.start()
    suffix_dedup.settled(messages)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 9 * sum(len(r) for _, runs in said for r in runs)


def test_a_bucket_settled_in_parts_gives_the_least_of_equals():
    said, messages = _bucket(1 << 15)
    strings = [[run[k : k + suffix_dedup.LENGTH] for run in runs for k in range(len(run) - suffix_dedup.LENGTH + 1)] for _, runs in said]
    least: dict = {}
    for (doc, _), own in zip(said, strings):
        for x in own:
            least[x] = min(doc, least.get(x, doc))
    for at_once in (1, 1000, 1 << 18):
        got = [suffix_dedup._unpack(x.as_py(), np.int64)[0].tolist() for x in suffix_dedup.settled(messages, at_once)]
        assert got == [[least[x] for x in own] for own in strings]

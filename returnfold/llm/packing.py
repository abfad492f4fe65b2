"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Pieces are dealt at random into blocks of about BLOCK pieces, each a packing problem of bounded size.
A block is evolved on ISLANDS islands. A chromosome is a list of bins; crossover injects whole
well-filled bins of the other parent, drops the bins that hold any of the same pieces, and best-fits
the pieces so displaced, longest first; mutation dissolves the emptiest bins. After each epoch, an
island's best chromosome moves to the next island. A block that has reached its lower bound (total
length over capacity, rounded up) is done at once. What blocks leave in their emptiest bins is then
packed anew across blocks, 64 blocks to one, until one block is left, so that the number of
sequences stays near the lower bound of the whole table, not of each block.

Null and empty texts are a piece of the end id alone; longer texts than a sequence are cut into pieces
wherever they are. Rows without a doc_id, rows that share one and repeated rows each have their pieces.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, sliced, stored, table, trim
from .words import WordIds, tokenizer_path

CAPACITY, BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION, MERGED = 4096, 2048, 4, 3, 12, 6, 64
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """PIECE rows: each document's ids and end_id, cut into pieces of capacity ids where they are more."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        for batch in batches:
            for part in sliced(batch, "text"):
                ids, n = words.encode(part.column("text"))
                raw, n = memoryview(np.insert(ids, np.cumsum(n), end_id).astype("<u4").tobytes()), n + 1
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(capacity, n[doc] - start)
                at = (np.cumsum(n) - n)[doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
                yield pa.record_batch([part.column("doc_id").take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        del words
        trim()

    return docs.mapInArrow(cut, PIECE)


def best_fit(items, lengths, capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Puts items, in this order, where they leave the least room; new bins where none has room."""
    bins = [list(b) for b in bins or []]
    free = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect_left(free, (lengths[i], -1))
        if at < len(free):
            room, k = free.pop(at)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        insort(free, (room - lengths[i], k))
    return bins


def fitness(bins: list[list[int]], lengths, capacity: int) -> tuple[int, float]:
    """Less is better: bins, then how unevenly they are filled."""
    return len(bins), -sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(a: list[list[int]], b: list[list[int]], lengths, capacity: int, rng: random.Random) -> list[list[int]]:
    fill = sorted(range(len(b)), key=lambda k: -sum(lengths[i] for i in b[k]))
    injected = [b[k] for k in rng.sample(fill[: max(1, len(fill) // 2)], max(1, len(fill) // 6))]
    taken = {i for x in injected for i in x}
    kept = [x for x in a if taken.isdisjoint(x)]
    displaced = sorted((i for x in a if not taken.isdisjoint(x) for i in x if i not in taken), key=lambda i: -lengths[i])
    return best_fit(displaced, lengths, capacity, kept + injected)


def mutate(bins: list[list[int]], lengths, capacity: int, rng: random.Random) -> list[list[int]]:
    """Dissolves the emptiest bins and some others, and fits their items in a disturbed order."""
    order = sorted(range(len(bins)), key=lambda k: sum(lengths[i] for i in bins[k]))
    gone = {*order[: 2 + rng.randrange(3)], *rng.sample(order, min(len(order), 3))}
    loose = sorted((i for k in gone for i in bins[k]), key=lambda i: -lengths[i] * rng.uniform(0.8, 1.2))
    return best_fit(loose, lengths, capacity, [b for k, b in enumerate(bins) if k not in gone])


def first_population(lengths, capacity: int, island: int) -> list[list[list[int]]]:
    """The first island starts with best fit by falling length, the others with disturbed orders."""
    rng, longest = random.Random(island), sorted(range(len(lengths)), key=lambda i: -lengths[i])
    out = [best_fit(longest, lengths, capacity)]
    bound = -(-sum(lengths) // capacity)
    while len(out) < POPULATION and len(out[0]) > bound:
        spread = 0.05 * (1 + island) * len(out)
        out.append(best_fit(sorted(longest, key=lambda i: -lengths[i] * rng.uniform(1 - min(0.9, spread), 1)), lengths, capacity))
    return out


def evolve(population: list[list[list[int]]], lengths, capacity: int, seed: int) -> list[list[list[int]]]:
    rng, bound = random.Random(seed), -(-sum(lengths) // capacity)
    score = lambda x: fitness(x, lengths, capacity)
    population = sorted(population, key=score)
    for _ in range(GENERATIONS):
        if len(population[0]) <= bound:
            break
        a, b = (min(rng.sample(population, min(2, len(population))), key=score) for _ in "ab")
        population += [crossover(a, b, lengths, capacity, rng), mutate(population[0], lengths, capacity, rng)]
        population = sorted(population, key=score)[:POPULATION]
    return population


def _bins(packed: np.ndarray) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(int(packed.max()) + 1 if len(packed) else 0)]
    for i, k in enumerate(packed.tolist()):
        out[k].append(i)
    return out


def _packed(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _pack_blocks(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (PIECE, block) with bin, offset, fill of the bin and open: whether its bin is to be packed anew."""
    spark = pieces.sparkSession
    ordered = ["length", "doc_id", "piece"]

    def start(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths, out = rows["length"].sort_values(ascending=False).tolist(), []
        for k in range(ISLANDS):
            population = first_population(lengths, capacity, k)
            out.append((key[0], k, lengths, [_packed(x, len(lengths)) for x in population]))
            if len(population[0]) <= -(-sum(lengths) // capacity):
                break  # best fit alone has reached the bound
        return pd.DataFrame(out, columns=["block", "island", "lengths", "population"])

    def epoch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            new = []
            for b, k, e, ls, population, guest in zip(rows["block"], rows["island"], rows["epoch"], rows["lengths"], rows["population"], rows["guest"]):
                ls, chromosomes = list(ls), [_bins(np.asarray(p)) for p in population]
                if guest is not None and len(guest):
                    chromosomes.append(_bins(np.asarray(guest)))
                new.append([_packed(x, len(ls)) for x in evolve(chromosomes, ls, capacity, int(b) * 31 + k * 7 + e)])
            yield rows.assign(population=new)[["block", "island", "lengths", "population"]]

    state_type = "block long, island int, lengths array<long>, population array<array<int>>"
    state = stored(pieces.groupBy("block").applyInPandas(start, state_type), "islands")
    islands = state.where("island > 0").count()  # a task each, so that none gets many by chance
    for e in range(EPOCHS):
        if not islands:
            break
        elite = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("population")[0].alias("guest"))
        dealt = state.join(elite, ["block", "island"], "left").withColumn("epoch", F.lit(e)).repartition(min(islands, 20_000), "block", "island")
        state = stored(dealt.mapInPandas(epoch, state_type), "islands")
    best = state.select("block", F.col("population")[0].alias("packed")).groupBy("block").agg(F.min_by("packed", F.array_max("packed")).alias("packed"))

    def settle(key: tuple, rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(ordered, ascending=[False, True, True], kind="stable").reset_index(drop=True)
        rows["bin"] = np.asarray(chosen["packed"][0], np.int64)
        rows["offset"] = rows.groupby("bin")["length"].cumsum() - rows["length"]
        fill = rows.groupby("bin")["length"].transform("sum")
        worst = sorted(set(zip(fill.tolist(), rows["bin"].tolist())))[:3]
        rows["open"] = rows["bin"].isin([k for f, k in worst if f < capacity])
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "block", "bin", "offset", "open"]]

    return pieces.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(settle, PIECE + ", block long, bin long, offset long, open boolean")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """PIECE rows with sequence_id and offset; pieces is read more than once, so store it first."""
    kept, level = None, 0
    blocks = max(1, -(-pieces.count() // BLOCK))
    block = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(blocks)).cast("long")  # spreads repeated rows too
    rows = stored(pieces.withColumn("block", block), "blocks")
    while True:
        packed = stored(_pack_blocks(rows, capacity), "packed")
        last = blocks == 1
        done = packed if last else packed.where("not open")
        done = done.select("doc_id", "piece", "start", "length", "ids_crc32", (F.lit(level << 56) + F.col("block") * (1 << 16) + F.col("bin")).alias("sequence_id"), "offset")
        kept = done if kept is None else kept.unionByName(done)
        if last:
            return kept
        rows = packed.where("open").select("doc_id", "piece", "start", "length", "ids_crc32", F.floor(F.col("block") / MERGED).cast("long").alias("block"))
        blocks, level = -(-blocks // MERGED), level + 1


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents packed into sequences of at most 4096 tokens."""
    docs = documents(table(spark, sf_dir, "documents"))
    return pack(stored(token_pieces(docs, tokenizer_path("word_bpe_49k.json"), 1, CAPACITY), "pieces"))

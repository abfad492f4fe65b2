"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a bounded sample, by two-means until no list of the sample is longer than its
share, so lists are balanced; equal vectors of the sample count once, so they make one
list. There is a list for each PER_LIST vectors, up to MOST_LISTS of them, which is what is broadcast; with more vectors,
lists grow. Every vector goes to the list of its nearest centroid, found by comparing it with all of them; one near a
boundary is also put in up to REPLICAS - 1 others, whose centroids are at most REACH times as far and
not nearer to a chosen centroid than to the vector.

A query finds centroids by best-first walks on a neighbour graph, or, where it needs more than BEAM, by comparing it with all,
as a walk would meet most of them. It visits the PROBES lists of nearest centroids, and more
as long as their centroids' distances are at most PRUNE times the least one, up to as many as hold RECALL of the true
neighbours of some CALIBRATED queries, which are compared with every vector; with fewer than MANY_LISTS, up to one list in
PROBE_SHARE.

Lists that stand near each other make blocks of about BLOCK_ROWS vectors, each one task's work; a list that is longer is
dealt over several. Vectors go to their blocks packed, as bytes, and queries follow them in packs, so a block is held once and queries pass
by. A query brings a bound, the K-th best score in the sample, below which nothing needs to come
back, and the rows of the sample that reach it. In a block, products in single precision pick the rows that reach the bound;
their scores are cosines in double precision. Of equal vectors a block looks at the K + 1 smallest ids, which are all that a
query can get.

Null, zero or non-finite vectors take no part, nor do vectors of another length than most have. Repeated
rows of a vec_id are candidates once; rows that share a vec_id are never neighbours of each other.
Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import contextlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import stored, table, trim

SAMPLE, PER_LIST, MOST_LISTS, LIST_ROWS, QUERY_ROWS = 40_000, 50, 16_384, 4000, 8192
#: Rows of a block, and blocks that a small table is cut into; rows that are packed together.
BLOCK_ROWS, BLOCKS, PACKED = 300_000, 24, 20_000
REPLICAS, REACH, PROBES, PROBE_SHARE, PRUNE, DEGREE, BEAM = 3, 1.15, 16, 3, 1.6, 16, 96
RECALL, CALIBRATED, MANY_LISTS = 0.97, 200, 2048
#: What products in single precision may be off by; the id that stands for null.
NEAR, NO_ID = 1e-5, -(1 << 63)


def unit(vectors) -> np.ndarray:
    v = np.stack([np.asarray(x, np.float64) for x in vectors])
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def balanced_centroids(sample: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Unit centroids: the largest part of the sample is split in two by the direction between two means, at its median. Parts of one part stand together."""
    sample = _distinct(sample)
    rng, heap, made = np.random.default_rng(seed), [(-len(sample), 0, np.arange(len(sample)), 0.0, 1.0)], 1
    while len(heap) < min(lists, len(sample)) and heap[0][0] < -1:
        _, _, part, at, width = heapq.heappop(heap)
        x = sample[part]
        ends = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(6):
            near = (x @ ends.T).argmax(1)
            if near.all() or not near.any():
                break
            ends = np.stack([x[near == k].mean(0) for k in (0, 1)])
        order = np.argsort(x @ (ends[1] - ends[0]), kind="stable")
        for half, start in ((part[order[: len(part) // 2]], at), (part[order[len(part) // 2 :]], at + width / 2)):
            heapq.heappush(heap, (-len(half), made, half, start, width / 2))
            made += 1
    parts = [x[2] for x in sorted(heap, key=lambda x: x[3])]
    means = np.stack([sample[p].mean(0) for p in parts]) if len(sample) else np.zeros((0, 1))
    means = means[np.linalg.norm(means, axis=1) > 1e-9] if len(means) else means
    return _distinct(unit(means)) if len(means) else sample[:1]


def _distinct(vectors: np.ndarray) -> np.ndarray:
    """vectors, in their order, without those that equal an earlier one to six places."""
    return vectors[np.sort(np.unique(np.round(vectors, 6) + 0.0, axis=0, return_index=True)[1])] if len(vectors) else vectors


def _first(cos: np.ndarray, k: int, parts: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(the k largest of each row, their places), largest first; with many columns, only those in the k strided parts of largest maxima are looked at."""
    m = cos.shape[1]
    at = None
    if m >= 8 * parts and k < parts // 4:
        fit = m // parts * parts
        best = cos[:, :fit].reshape(len(cos), -1, parts).max(1)
        at = (np.argpartition(best, parts - k, axis=1)[:, -k:, None] + np.arange(0, fit, parts)).reshape(len(cos), -1)
        at = np.concatenate([at, np.broadcast_to(np.arange(fit, m), (len(cos), m - fit))], 1)
    some = cos if at is None else np.take_along_axis(cos, at, 1)
    top = np.argpartition(some, some.shape[1] - k, axis=1)[:, -k:]
    value = np.take_along_axis(some, top, 1)
    order = np.argsort(-value, axis=1, kind="stable")
    top = np.take_along_axis(top, order, 1)
    return np.take_along_axis(value, order, 1), top if at is None else np.take_along_axis(at, top, 1)


def _far(cos: np.ndarray) -> np.ndarray:
    return np.where(cos > -np.inf, np.sqrt(np.maximum(2 - 2 * cos, 0)), np.inf)


class CentroidGraph:
    """Centroids and for each its DEGREE nearest others; walks many queries at once."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.ascontiguousarray(centroids, np.float32)
        n, k = len(centroids), min(DEGREE, len(centroids) - 1)
        near = []
        for i in range(0, n, 512):
            cos = self.centroids[i : i + 512] @ self.centroids.T
            cos[np.arange(len(cos)), np.arange(i, i + len(cos))] = -np.inf  # not itself
            near.append(_first(cos, k)[1] if k else np.zeros((len(cos), 0), int))
        rng = np.random.default_rng(1)
        self.links = np.concatenate([np.concatenate(near), rng.integers(0, n, (n, 4))], 1).astype(np.int32)  # some far links keep it connected
        self.entries = np.sort(rng.permutation(n)[: max(16, n // 8)])
        #: Lists that a query visits at most; for each list, its first block and how many it is dealt over.
        self.probes = min(max(PROBES, n // PROBE_SHARE), n)
        self.block, self.over = np.zeros(n, np.int32), np.ones(n, np.int32)

    def nearest(self, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, centroids) of the k nearest of each vector among all, nearest first."""
        turned, room, found = np.ascontiguousarray(self.centroids.T), np.empty((128, len(self.centroids)), np.float32), []
        for i in range(0, len(vectors), 128):
            part = vectors[i : i + 128]
            found.append(_first(np.matmul(part, turned, out=room[: len(part)]), min(k, len(self.centroids))))
        return _far(np.concatenate([x[0] for x in found])), np.concatenate([x[1] for x in found])

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, centroids) of about the k nearest of each query, nearest first; a walk for more than BEAM would meet most centroids, so all are compared."""
        if k > BEAM:
            return self.nearest(queries, k)
        found = [self._walk(queries[i : i + 256], k) for i in range(0, len(queries), 256)]
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])

    def _walk(self, queries: np.ndarray, k: int, wide: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """A step follows the links of wide centroids."""
        n, beam = len(self.centroids), min(max(BEAM, k), len(self.centroids))
        rows = np.arange(len(queries))[:, None]
        seen = np.zeros((len(queries), n), bool)
        seen[:, self.entries] = True
        cos, at = _first(queries @ self.centroids[self.entries].T, min(beam, len(self.entries)))
        ids = self.entries[at]
        open_ = np.ones(ids.shape, bool)
        while open_.any():
            best = np.argsort(~open_, axis=1, kind="stable")[:, :wide]  # rows are sorted by nearness
            fresh = self.links[np.take_along_axis(ids, best, 1)].reshape(len(queries), -1)
            fresh = np.sort(np.where(np.repeat(np.take_along_axis(open_, best, 1), self.links.shape[1], 1), fresh, n), axis=1)
            np.put_along_axis(open_, best, False, 1)
            new = fresh < n
            new[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
            fresh[fresh == n] = 0
            new &= ~seen[rows, fresh]
            fresh = np.take_along_axis(fresh, order := np.argsort(~new, axis=1, kind="stable")[:, : max(1, int(new.sum(1).max()))], 1)
            new = np.take_along_axis(new, order, 1)
            seen[np.broadcast_to(rows, new.shape)[new], fresh[new]] = True
            gain = np.where(new, np.matmul(self.centroids[fresh], queries[:, :, None])[:, :, 0], -np.inf)
            ids, cos, open_ = np.concatenate([ids, fresh], 1), np.concatenate([cos, gain], 1), np.concatenate([open_, new], 1)
            keep = np.argsort(-cos, axis=1, kind="stable")[:, :beam]
            ids, cos, open_ = (np.take_along_axis(x, keep, 1) for x in (ids, cos, open_))
        return _far(cos[:, :k]), ids[:, :k]


def _lists(graph: CentroidGraph, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lists, whether the vector is put there) of each vector."""
    vectors = vectors.astype(np.float32)
    far, ids = graph.nearest(vectors, 8)
    chosen = np.zeros(ids.shape, bool)
    chosen[:, 0] = True
    for i in range(0, len(ids), 2000):  # distances between the centroids of a vector
        part, dist, own = chosen[i : i + 2000], far[i : i + 2000], graph.centroids[ids[i : i + 2000]]
        apart = _far(np.matmul(own, own.transpose(0, 2, 1)))
        for j in range(1, ids.shape[1]):
            fits = (dist[:, j] <= REACH * dist[:, 0]) & (part.sum(1) < REPLICAS)
            part[:, j] = fits & ~(part[:, :j] & (apart[:, j, :j] <= dist[:, j, None])).any(1)
    return ids, chosen


def lists_of(graph: CentroidGraph, vectors: np.ndarray) -> list[list[int]]:
    """The lists that each vector is put in."""
    return [x[y].tolist() for x, y in zip(*_lists(graph, vectors))]


def _probes(graph: CentroidGraph, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lists, whether the query visits them) of each query."""
    far, ids = graph.search(vectors.astype(np.float32), graph.probes)
    return ids, (far < np.inf) & ((np.arange(ids.shape[1]) < PROBES) | (far <= PRUNE * far[:, :1] + 1e-6))


def probes_of(graph: CentroidGraph, vectors: np.ndarray) -> list[list[int]]:
    """The lists that each query visits."""
    return [x[y].tolist() for x, y in zip(*_probes(graph, vectors))]


def _matrix(batch: pa.RecordBatch, length: int | None = None):
    """(ids, vectors) of the usable rows of a batch (vec_id, embedding) with that length; without it, (lengths, how many usable rows have them)."""
    ids, column = batch.column(0), batch.column(1)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype({pa.float32(): np.float32}.get(flat.type, np.float64), copy=False)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    bad, some = (np.concatenate([[0], np.cumsum(flags)]) for flags in (~np.isfinite(x), (x != 0) & np.isfinite(x)))
    fits = (bad[ends] == bad[begins]) & (some[ends] > some[begins])
    if length is None:
        return np.unique(sizes[fits], return_counts=True)
    fits &= sizes == length
    vectors = x.reshape(-1, length) if len(x) == length * len(sizes) and (sizes == length).all() else x[begins[fits][:, None] + np.arange(length)]
    ids = pc.fill_null(ids, NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids[fits], np.ascontiguousarray(vectors[fits] if len(vectors) == len(fits) else vectors) + vectors.dtype.type(0)  # no -0


def _collected(df: DataFrame, length: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(ids, vectors) of the usable rows, of which there are few; None if there is none."""
    parts = [x for batch in df.toArrow().to_batches() if len((x := _matrix(batch, length))[0])]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else None


def _fewest(ids: np.ndarray, vectors: np.ndarray, k: int, lists: np.ndarray | None = None) -> np.ndarray:
    """Places of rows to keep: of equal vectors (of a list), the k smallest ids once each. Vectors that share a hash may keep more."""
    words = vectors.view(np.uint32 if vectors.dtype == np.float32 else np.uint64)
    keys = np.random.default_rng(7).integers(1 << 62, 1 << 63, words.shape[1], dtype=np.uint64) | np.uint64(1)
    mixed = np.zeros(len(ids), np.uint64) if lists is None else lists.astype(np.uint64) + np.uint64(1)
    for at in range(words.shape[1]):
        mixed = (mixed ^ words[:, at]) * keys[at]
        mixed ^= mixed >> np.uint64(29)
    order = np.lexsort((ids, mixed))
    like = np.flatnonzero(mixed[order][1:] == mixed[order][:-1]) + 1
    same, repeat = np.zeros((2, len(ids)), bool)
    for at in range(0, len(like), 20_000):
        some = like[at : at + 20_000]
        same[some] = (vectors[order[some]] == vectors[order[some - 1]]).all(1)
        if lists is not None:
            same[some] &= lists[order[some]] == lists[order[some - 1]]
    repeat[1:] = same[1:] & (ids[order][1:] == ids[order][:-1])
    order, same = order[~repeat], same[~repeat]
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    return np.sort(order[np.arange(len(order)) - start < k])


def _places(flags: np.ndarray) -> np.ndarray:
    """np.flatnonzero of flags few of which are set: eight are looked at together."""
    flat = flags.ravel()
    whole = len(flat) // 8 * 8
    at = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], np.flatnonzero(flat[whole:]) + whole])


class Rows:
    """Rows as they are, their largest components and norms after division by these."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.most, self.norm = np.empty(len(ids)), np.empty(len(ids))
        for at in range(0, len(ids), 10_000):
            own = slice(at, at + 10_000)
            x = vectors[own].astype(np.float64)
            self.most[own] = np.abs(x).max(1)
            self.norm[own] = np.sqrt(((x / self.most[own, None]) ** 2).sum(1))
        self.plain = vectors.dtype == np.float32 and (not len(ids) or self.most.min() > 1e-25 and self.most.max() < 1e25)
        self.over = (1 / (self.most * self.norm)).astype(np.float32) if self.plain else None

    def scaled(self, at) -> np.ndarray:
        return self.vectors[at].astype(np.float64) / self.most[at, None]

    def unit(self, at) -> np.ndarray:
        return self.vectors[at] * self.over[at, None] if self.plain else (self.scaled(at) / self.norm[at, None]).astype(np.float32)


#: Where a worker's products go.
ROOM = np.empty(512 * 4096, np.float32)


class Best:
    """The k best vec_ids that each of some queries has met, each by its best row; ties go to the smaller vec_id. bound: what a score must reach."""

    def __init__(self, queries: Rows, k: int, bound: np.ndarray | None = None):
        self.queries, self.k = queries, k
        self.bound = np.full(len(queries.ids), -np.inf, np.float32) if bound is None else bound.copy()
        self.of, self.ids, self.scores, self.more = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), 0
        self.parts: list[tuple] = []

    def meet(self, rows: Rows, places: np.ndarray, asking: np.ndarray) -> None:
        """The queries at asking look at the rows at places."""
        for at in range(0, len(places), 4096):
            own = places[at : at + 4096]
            units = rows.unit(own).T
            for start in range(0, len(asking), 512):
                some = asking[start : start + 512]
                cos = np.matmul(self.queries.unit(some), units, out=ROOM[: len(some) * len(own)].reshape(len(some), -1))
                hit = _places(cos >= self.bound[some, None])
                if len(hit):
                    self._score(rows, some[hit // len(own)], own[hit % len(own)])

    def _score(self, rows: Rows, of: np.ndarray, at: np.ndarray) -> None:
        other = self.queries.ids[of] != rows.ids[at]
        of, at = of[other], at[other]
        for i in range(0, len(of), 20_000):
            q, r = of[i : i + 20_000], at[i : i + 20_000]
            score = (rows.scaled(r) * self.queries.scaled(q)).sum(1) / (rows.norm[r] * self.queries.norm[q])
            self.add(q, rows.ids[r], score)

    def add(self, of: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.parts.append((of, ids, scores))
        self.more += len(of)
        if self.more >= max(100_000, len(self.of)):
            self.cut()

    def cut(self) -> None:
        of, ids, scores = (np.concatenate(x) for x in zip((self.of, self.ids, self.scores), *self.parts))
        self.parts, self.more = [], 0
        order = np.lexsort((-scores, ids, of))
        of, ids, scores = of[order], ids[order], scores[order]
        once = np.ones(len(of), bool)
        once[1:] = (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])
        of, ids, scores = of[once], ids[once], scores[once]
        order = np.lexsort((ids, -scores, of))
        of, ids, scores = of[order], ids[order], scores[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        last = place == self.k - 1
        self.bound[of[last]] = np.maximum(self.bound[of[last]], (scores[last] - NEAR).astype(np.float32))
        self.of, self.ids, self.scores = (x[place < self.k] for x in (of, ids, scores))


PACK = "block int, side int, chunk int, ids binary, vectors binary, bounds binary, lists binary, asking binary, scores binary"
FOUND = "chunk int, of binary, ids binary, scores binary"


def _packs(schema: str, **columns) -> pa.RecordBatch:
    """A batch of rows; binary columns are given as arrays, those left out are null."""
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    n = len(next(iter(columns.values())))
    raw = lambda x: x.tobytes() if isinstance(x, np.ndarray) else x
    return pa.RecordBatch.from_arrays([pa.array([raw(x) for x in columns.get(name, [None] * n)], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


def _dealt(graph: CentroidGraph, lists: np.ndarray, chosen: np.ndarray, spread: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, places of the rows that go there, by their lists, these lists); a list of several blocks has a row in one of them, by spread, or in all."""
    row, column = np.nonzero(chosen)
    of = lists[row, column]
    if spread is None:
        times = graph.over[of]
        row, of, nth = np.repeat(row, times), np.repeat(of, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    else:
        nth = spread[row] % graph.over[of]
    block = graph.block[of] + nth
    order = np.lexsort((of, block))
    row, of, block = row[order], of[order].astype(np.uint16), block[order]
    for own in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1) if len(block) else ():
        yield int(block[own[0]]), row[own], of[own]


def _placed(vectors: DataFrame, graph, length: int, k: int) -> DataFrame:
    """Vectors, packed by block; the graph is of bounded size and broadcast."""

    def packed(ids, x):
        keep = _fewest(ids, x, k + 1)
        ids, x = ids[keep], x[keep]
        spread = x.view(np.uint8).reshape(len(x), -1)[:, ::3].sum(1, dtype=np.int64)
        lists, chosen = _lists(graph.value, Rows(ids, x).unit(slice(None)))
        made = list(_dealt(graph.value, lists, chosen, spread))
        n = len(made)
        return _packs(PACK, block=[b for b, *_ in made], side=[0] * n, chunk=[0] * n, ids=[ids[r] for _, r, _ in made], vectors=[x[r] for _, r, _ in made], lists=[x for *_, x in made])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(_matrix(batch, length))
            n += len(held[-1][0])
            if n >= PACKED:
                yield from _cut(held)
                held, n = [], 0
        if n:
            yield from _cut(held)
        trim()

    def _cut(held):
        ids, x = (np.concatenate(y) for y in zip(*held))
        for at in range(0, len(ids), PACKED):
            yield packed(ids[at : at + PACKED], x[at : at + PACKED])

    return vectors.mapInArrow(pack, PACK)


def _asked(queries: DataFrame, graph, sample, length: int, k: int) -> DataFrame:
    """Queries, packed by the blocks that they look at, with their bounds; and what they find in the sample."""

    def packed(ids, x, chunk):
        rows = Rows(ids, x)
        best = _within(rows, sample.value, k)
        bound = best.bound
        if len(best.of):
            yield _packs(PACK, block=[chunk % (1 + int(graph.value.block.max()))], side=[2], chunk=[chunk], ids=[ids[best.of]], vectors=[best.ids], scores=[best.scores])
        for block, own, lists in _dealt(graph.value, *_probes(graph.value, rows.unit(slice(None))), None):
            own, place = np.unique(own, return_inverse=True)
            yield _packs(PACK, block=[block], side=[1], chunk=[chunk], ids=[ids[own]], vectors=[x[own]], bounds=[bound[own]], lists=[lists], asking=[place.astype(np.uint16)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        for batch in batches:
            ids, x = _matrix(batch, length)
            for at in range(0, len(ids), QUERY_ROWS):
                yield from packed(ids[at : at + QUERY_ROWS], x[at : at + QUERY_ROWS], chunk)

    return queries.mapInArrow(pack, PACK)


def _within(queries: Rows, sample: Rows, k: int) -> Best:
    """What queries find in the sample."""
    best = Best(queries, k)
    if len(sample.ids) > k:  # one id may be the query's own
        units = sample.unit(slice(None)).T
        for at in range(0, len(queries.ids), 64):
            best.bound[at : at + 64] = _first(queries.unit(slice(at, at + 64)) @ units, k + 1)[0][:, -1] - NEAR
    best.meet(sample, np.arange(len(sample.ids)), np.arange(len(queries.ids)))
    best.cut()
    return best


class Held:
    """Rows (id, vector, list) that come bit by bit."""

    def __init__(self, length: int, kind, k: int):
        self.n, self.least, self.k, self.kind, self.length = 0, BLOCK_ROWS, k, kind, length
        self.ids, self.vectors, self.lists = self._room(BLOCK_ROWS + BLOCK_ROWS // 4)

    def _room(self, n: int):
        return np.empty(n, np.int64), np.empty((n, self.length), self.kind), np.empty(n, np.uint16)

    def add(self, ids: np.ndarray, vectors: np.ndarray, lists: np.ndarray) -> None:
        if self.n + len(ids) > len(self.ids) and self.n >= 2 * self.least:
            self.thin()
            self.least = max(BLOCK_ROWS, self.n)
        if self.n + len(ids) > len(self.ids):
            room = self._room(max(self.n + len(ids), self.n * 3 // 2))
            for old, new in zip((self.ids, self.vectors, self.lists), room):
                new[: self.n] = old[: self.n]
            self.ids, self.vectors, self.lists = room
        for part, own in ((ids, self.ids), (vectors, self.vectors), (lists, self.lists)):
            own[self.n : self.n + len(ids)] = part
        self.n += len(ids)

    def thin(self) -> None:
        """Leaves out what copies make needless."""
        keep = _fewest(self.ids[: self.n], self.vectors[: self.n], self.k + 1, self.lists[: self.n])
        if len(keep) < self.n:
            for x in (self.ids, self.vectors, self.lists):
                for at in range(0, len(keep), 20_000):  # places only move down
                    x[at : at + len(keep[at : at + 20_000])] = x[keep[at : at + 20_000]]
            self.n = len(keep)

    def rows(self) -> tuple[Rows, dict[int, np.ndarray]]:
        """(the rows, places by list)."""
        self.thin()
        lists = self.lists[: self.n]
        order = np.argsort(lists, kind="stable")
        return Rows(self.ids[: self.n], self.vectors[: self.n]), {x: order[span] for x, span in _spans(lists[order]).items()}


def _spans(lists: np.ndarray) -> dict[int, slice]:
    """Where each of sorted lists begins and ends."""
    own, starts = np.unique(lists, return_index=True)
    return {x: slice(a, b) for x, a, b in zip(own.tolist(), starts.tolist(), [*starts[1:].tolist(), len(lists)])}


def _looked(sent: DataFrame, length: int, single: bool, k: int) -> DataFrame:
    """What the queries find in the blocks; sent has a block's vectors before its queries."""
    kind = np.float32 if single else np.float64

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        block, held, rows, places = None, None, None, {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_buffer() if batch.column(name).type == pa.binary() and batch.column(name)[at].is_valid else batch.column(name)[at].as_py() for name in batch.schema.names}
                if row["block"] != block:
                    block, held, rows, places = row["block"], None, None, {}
                if row["side"] == 2:
                    yield _packs(FOUND, chunk=[row["chunk"]], of=[row["ids"].to_pybytes()], ids=[row["vectors"].to_pybytes()], scores=[row["scores"].to_pybytes()])
                    continue
                ids, x, lists = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], kind).reshape(-1, length), np.frombuffer(row["lists"], np.uint16)
                if row["side"] == 0:
                    held = held or Held(length, kind, k)
                    held.add(ids, x, lists)
                    continue
                if held:
                    (rows, places), held = held.rows(), None
                if rows is None:
                    continue
                best, asking = Best(Rows(ids, x), k, np.frombuffer(row["bounds"], np.float32)), np.frombuffer(row["asking"], np.uint16).astype(np.int64)
                for own, span in _spans(lists).items():
                    if own in places:
                        best.meet(rows, places[own], asking[span])
                best.cut()
                if len(best.of):
                    yield _packs(FOUND, chunk=[row["chunk"]], of=[ids[best.of]], ids=[best.ids], scores=[best.scores])
            batch = row = ids = x = lists = best = None  # before the next one comes
        rows = held = None
        trim()

    return sent.mapInArrow(look, FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query of a chunk."""

    def merge(part: pa.Table) -> pa.Table:
        of, ids, scores = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in part.column(name)]) for name, kind in (("of", np.int64), ("ids", np.int64), ("scores", np.float64)))
        queries, place = np.unique(of, return_inverse=True)
        best = Best(Rows(queries, np.ones((len(queries), 1))), k)
        best.add(place, ids, scores)
        best.cut()
        return pa.table({"query_id": queries[best.of], "vec_id": best.ids, "score": best.scores})

    return found.groupBy("chunk").applyInArrow(merge, "query_id long, vec_id long, score double")


def _calibrated(vectors: DataFrame, queries: DataFrame, graph: CentroidGraph, length: int, asked: int, k: int) -> int:
    """How many of the nearest lists hold RECALL of the k true neighbours of some queries; PROBES at least, one in PROBE_SHARE at most."""
    spark, most = vectors.sparkSession, graph.probes
    some = queries.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(max(1, asked // CALIBRATED))) == 1 % max(1, asked // CALIBRATED)).limit(4 * CALIBRATED)
    if (usable := _collected(some, length)) is None:
        return most
    rows = Rows(*usable)
    order = graph.nearest(rows.unit(slice(None)), len(graph.centroids))[1]
    rank = np.empty(order.shape, np.uint16)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1], dtype=np.uint16), order.shape), 1)
    given = spark.sparkContext.broadcast((graph, rows, rank))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, rows, rank = given.value
        units, found = rows.unit(slice(None)), []
        for batch in batches:
            ids, x = _matrix(batch, length)
            if not len(ids):
                continue
            x = Rows(ids, x).unit(slice(None))
            for at in range(0, len(units), 64):
                cos = units[at : at + 64] @ x.T
                cos[rows.ids[at : at + 64, None] == ids[None, :]] = -np.inf
                value, place = _first(cos, min(k, len(ids)))
                of, nth = np.nonzero(value > -np.inf)
                found.append((of + at, ids[place[of, nth]], value[of, nth], x[place[of, nth]]))
            of, their, value, x = (np.concatenate(y) for y in zip(*found))
            by = np.lexsort((-value, of))
            by = by[np.arange(len(by)) - np.searchsorted(of[by], of[by]) < k]
            found = [(of[by], their[by], value[by], x[by])]
        if found and len(found[0][0]):
            of, their, value, x = found[0]
            lists, chosen = _lists(graph, x)
            ranks = np.where(chosen, rank[of[:, None], lists].astype(np.int32), len(graph.centroids)).min(1)
            yield pa.RecordBatch.from_pydict({"of": of.astype(np.int32), "vec_id": their, "score": value.astype(np.float32), "rank": ranks.astype(np.int32)})

    found = vectors.mapInArrow(compare, "of int, vec_id long, score float, rank int").groupBy("of", "vec_id").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
    nth = F.row_number().over(W.partitionBy("of").orderBy(F.desc("score"), "vec_id"))
    ranks = [r[0] for r in found.withColumn("nth", nth).where(F.col("nth") <= k).select("rank").collect()]
    given.unpersist()
    return max(PROBES, min(most, int(np.quantile(ranks, RECALL, method="higher")) + 1)) if ranks else most


def _blocks(graph: CentroidGraph, sample: np.ndarray, every: float) -> int:
    """Deals lists out to blocks, by the rows that they get of the sample, each of which stands for every rows; returns how many blocks."""
    lists, chosen = _lists(graph, sample)
    rows = np.bincount(lists[chosen], minlength=len(graph.centroids)) * every
    blocks = max(min(BLOCKS, -(-int(rows.sum()) // LIST_ROWS)), -(-int(rows.sum()) // BLOCK_ROWS), 1)
    share, at, full = max(1.0, rows.sum() / blocks), 0, 0.0
    for x, n in enumerate(rows):
        if full and full + n / 2 > share:
            at, full = at + 1, 0.0
        graph.over[x] = max(1, int(n // share))
        graph.block[x] = at
        if graph.over[x] > 1:
            at, full = at + int(graph.over[x]), 0.0
        else:
            full += n
    return at + 1


@contextlib.contextmanager
def _small_batches(spark: SparkSession, most: str = "8m") -> Iterator[None]:
    """What runs meanwhile hands packed rows to Python by some MB, as a batch stands in the JVM and in Python at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest that each of queries has among vectors, both (vec_id, embedding).

    Repeated rows are one. A vec_id that stands for several vectors is one candidate, by the nearest of them, and one query,
    which gets what is nearest to any of them. Empty tables and those without usable vectors give no rows.
    """
    spark = vectors.sparkSession
    single = all(df.schema["embedding"].dataType.elementType == T.FloatType() for df in (vectors, queries))
    fit = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    vectors, queries = fit(vectors), fit(queries)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict(dict(zip(("length", "n"), _matrix(batch))))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _matrix(batch, length)
            yield pa.RecordBatch.from_pydict({"vec_id": ids[:1], "embedding": x[:1].tolist()}, schema=batch.schema)

    most = vectors.mapInArrow(lengths, "length long, n long").groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "length").head()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length, n = most
    asked, every = queries.count(), max(1, -(-n // SAMPLE))
    sampled = vectors.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(every)) == 0).limit(2 * SAMPLE)
    ids, own = _collected(sampled, length) or _collected(vectors.mapInArrow(one, vectors.schema).limit(1), length)
    keep = _fewest(ids, own, k + 1)
    ids, own = ids[keep], own[keep]
    first = np.sort(np.unique(ids, return_index=True)[1])
    sample = spark.sparkContext.broadcast(Rows(ids[first], own[first]))
    units = Rows(ids, own).unit(slice(None))
    graph = CentroidGraph(balanced_centroids(units.astype(np.float64), max(1, min(MOST_LISTS, n // PER_LIST))))
    if len(graph.centroids) > MANY_LISTS:
        graph.probes = _calibrated(vectors, queries, graph, length, asked, k)
    blocks = _blocks(graph, units, every)
    shared = spark.sparkContext.broadcast(graph)
    chunks = max(-(-asked // QUERY_ROWS), min(BLOCKS, -(-asked // 256)), 1)
    sent = _placed(vectors, shared, length, k).unionByName(_asked(queries.repartition(chunks), shared, sample, length, k))
    found = _looked(sent.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "side"), length, single, k)
    with _small_batches(spark):
        found = stored(_merged(found, k), "neighbours")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    some = lambda x: F.when(F.col(x) != NO_ID, F.col(x)).alias(x)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(some("query_id"), "rank", some("vec_id"), "score")


def op2_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the 5 nearest of each vector whose vec_id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))

"""Near-duplicate documents by ProbMinHash.

A document is a weighted set: its shingles of SHINGLE words, each with the number of times it occurs
(one shingle of all words for shorter texts). Each shingle sends arrivals of a Poisson process whose
rate is its weight to random registers; a register keeps the shingle whose arrival was first, and a
shingle stops once its next arrival is later than all registers. Two documents agree in a register
with the probability that is their probability Jaccard index. A second sketch takes each shingle once,
so that there it is the Jaccard index of the shingle sets. BANDS bands of ROWS registers of each
sketch give candidates, and whole texts are compared: documents are linked if the probability Jaccard index of
their shingles, or the Jaccard index of their shingle sets, is at least SIMILARITY.

Every pair of texts that shares a bucket is compared, unless links have joined the two before; what
costs little comes first. Each text meets the leader with most company among the leaders of its
buckets, which joins most of a large class; then one text of each class that a bucket holds meets the
bucket's leader. In buckets that hold several classes even then, the texts outside the largest class
meet all others, in blocks of bounded size from which only links come back. A pair's registers are
compared before its texts. Equal texts are one text throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced, stored, table, trimmed
from .components import components
from .syncmers import mixed
from .words import strings, word_codes

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 26, 6
#: Texts are compared if so much of SIMILARITY of the registers of a sketch agree; at 0.8 two texts fall short with probability 1.2e-6.
AGREE = 0.8
#: Buckets of more texts are compared within tasks, in blocks of about BLOCK texts or BLOCK_BYTES of text; smaller ones as pairs.
CROWD, BLOCK, BLOCK_BYTES = 16, 1000, 8 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, shingle's hash, count), in order of text and hash."""
    import xxhash

    words, codes, counts = word_codes(texts, lower=False)
    named = np.array([xxhash.xxh3_64_intdigest(w) for w in strings(words)], np.uint64)
    full = np.array(strings(pc.not_equal(words, ""))) if len(words) else np.empty(0, bool)
    doc = np.repeat(np.arange(len(texts)), counts)
    if len(codes):
        some = full[codes]
        codes, doc = codes[some], doc[some]
    h, n = named[codes] if len(codes) else np.empty(0, np.uint64), np.bincount(doc, minlength=len(texts))
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    rolled = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width - 1, -1, -1):
            rolled *= _STEP
            if k < len(h):
                rolled[k:] += np.where(place[k:] >= k, h[: len(h) - k], np.uint64(0))
        rolled = mixed(rolled)
    ends = (place >= width - 1) | (place == n[doc] - 1)
    own = ends & ((place >= width - 1) | (n[doc] < width))
    doc, rolled = doc[own], rolled[own]
    order = np.lexsort((rolled, doc))
    doc, rolled = doc[order], rolled[order]
    first = np.flatnonzero(np.concatenate([[True], (rolled[1:] != rolled[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.empty(0, np.int64)
    return doc[first], rolled[first], np.diff(np.append(first, len(doc)))


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """For each document, the element whose arrival is first in each register (0 for those without elements)."""
    first, who = np.full(docs * registers, np.inf), np.zeros(docs * registers, np.uint64)
    arrival, active, turn = np.zeros(len(doc)), np.arange(len(doc)), 0
    while len(active):
        with np.errstate(over="ignore"):
            u = mixed(element[active] + np.uint64(2 * turn + 1) * _STEP)
            register = (mixed(u ^ _STEP) >> np.uint64(11)) % np.uint64(registers)
        arrival[active] -= np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53) / weight[active]
        slot, t = doc[active] * registers + register.astype(np.int64), arrival[active]
        early = np.flatnonzero(t < first[slot])
        np.minimum.at(first, slot[early], t[early])
        won = early[t[early] == first[slot[early]]]
        who[slot[won]] = element[active[won]]
        left, where = np.unique(doc[active], return_inverse=True)
        latest = first.reshape(docs, registers)[left].max(1)
        active, turn = active[t < latest[where]], turn + 1
    return who.reshape(docs, registers)


def registers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(registers of weighted shingles, registers of shingle sets, whether the text has words) of each text."""
    doc, h, n = shingles(texts)
    weighted = prob_minhash(doc, h, n.astype(np.float64), len(texts), BANDS * ROWS)
    again, sets = np.bincount(doc, n > 1, len(texts)) > 0, weighted.copy()
    if again.any():  # for the others both are one
        of = again[doc]
        sets[again] = prob_minhash((np.cumsum(again) - 1)[doc[of]], h[of], np.ones(of.sum()), again.sum(), BANDS * ROWS)
    return weighted, sets, np.bincount(doc, minlength=len(texts)) > 0


def band_keys(who: np.ndarray) -> np.ndarray:
    """Keys of all bands of each text, from its registers."""
    who = who.reshape(len(who), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(who), BANDS)).copy()
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = mixed(key * _STEP + who[:, :, r])
    return key.view(np.int64)


def pair_similarities(sets: tuple[np.ndarray, np.ndarray, np.ndarray], texts: int, ia: np.ndarray, ib: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard index of the shingle sets, probability Jaccard index) of texts ia[p] and ib[p]; sets is what shingles() gave for them."""
    doc, h, n = sets
    size = np.bincount(doc, minlength=texts)
    begin, repeated = np.cumsum(size) - size, np.bincount(doc, n, texts) > size
    plain, weighted = np.zeros(len(ia)), np.zeros(len(ia))
    cuts, at = np.cumsum(size[ia] + size[ib]), 0
    while at < len(ia):  # some hundred thousand shingles at a time
        to = max(at + 1, int(np.searchsorted(cuts, (cuts[at - 1] if at else 0) + 400_000, side="right")))
        part, pairs = slice(at, to), to - at
        keys, rows = [], []
        for side in (ia[part], ib[part]):
            pair = np.repeat(np.arange(pairs), size[side])
            ends = np.cumsum(size[side])
            row = np.arange(ends[-1]) + np.repeat(begin[side] - (ends - size[side]), size[side])
            with np.errstate(over="ignore"):
                keys.append(mixed(h[row] + mixed(pair.astype(np.uint64) * _STEP + np.uint64(1))))
            rows.append((pair, row))
        _, ka, kb = np.intersect1d(*keys, assume_unique=True, return_indices=True)
        (pa_, ra), (pb, rb) = rows
        both = np.bincount(pa_[ka], minlength=pairs)
        plain[part] = both / np.maximum(size[ia[part]] + size[ib[part]] - both, 1)
        weighted[part] = plain[part]
        for p in np.flatnonzero((repeated[ia[part]] | repeated[ib[part]]) & (both > 0)):
            of = np.flatnonzero(pa_[ka] == p)
            wa, wb = n[ra[pa_ == p]].astype(float), n[rb[pb == p]].astype(float)
            sa, sb = n[ra[ka[of]]].astype(float), n[rb[kb[of]]].astype(float)
            only_a, only_b, total = wa.sum() - sa.sum(), wb.sum() - sb.sum(), 0.0
            for ratio in np.unique(sa / sb):
                here = sa / sb == ratio
                total += sa[here].sum() / (only_a + ratio * only_b + np.maximum(sa, sb * ratio).sum())
            weighted[at + p] = total
        at = to
    return plain, weighted


def similarities(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard index of the shingle sets, probability Jaccard index) of each pair of texts; a text that is in several pairs is cut up once."""
    coded = pa.chunked_array([a, b]).combine_chunks().dictionary_encode()
    code = np.asarray(coded.indices).astype(np.int64)
    return pair_similarities(shingles(coded.dictionary), len(coded.dictionary), code[: len(a)], code[len(a) :])


def sketches(docs: DataFrame) -> DataFrame:
    """docs (with text) with keys, its band keys (none without words), and sketch, a byte of each register, in place of text.

    The keys of the weighted shingles come first, then those of the shingle set, null where they are the
    same. Where all are the same, keys and sketch have the first half alone.
    """
    others = [c for c in docs.columns if c != "text"]

    def of_texts(texts: pa.Array) -> list[pa.Array]:
        weighted, sets, full = registers(texts)
        one, two = band_keys(weighted[full]), band_keys(sets[full])
        twice = (one != two).any(1)
        many = np.zeros(len(full), np.int64)
        many[full] = np.where(twice, 2 * BANDS, BANDS)
        used = np.hstack([np.ones(one.shape, bool), np.broadcast_to(twice[:, None], two.shape)])
        keys = pa.array(np.hstack([one, two])[used], mask=np.hstack([np.zeros(one.shape, bool), one == two])[used])
        short = [(w if (w == s).all() else np.concatenate([w, s])).tobytes() for w, s in zip(*((x >> np.uint64(56)).astype(np.uint8) for x in (weighted, sets)))]
        offsets = pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32())
        return [pa.ListArray.from_arrays(offsets, keys), pa.array(short, pa.binary())]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text", 2 << 20):
                yield pa.record_batch([*(part.column(c) for c in others), *trimmed(of_texts, part.column("text"))], [*others, "keys", "sketch"])

    schema = T.StructType([docs.schema[c] for c in others]).add("keys", T.ArrayType(T.LongType())).add("sketch", T.BinaryType())
    return docs.mapInArrow(sketch, schema)


def compare(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of pairs (a, b) of doc_id that are linked: one of both indices is at least similarity. texts has one row for each doc_id."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text_a", 1 << 20):
                near = np.flatnonzero(np.maximum(*trimmed(similarities, part.column("text_a"), part.column("text_b"))) >= similarity)
                yield part.select(["a", "b"]).take(pa.array(near))

    one, two = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(look, pairs.select("a", "b").schema)


def _rows(column) -> np.ndarray:
    """Sketches of an Arrow column, one a row: the registers of the weighted shingles, then those of the sets."""
    one = BANDS * ROWS
    return np.frombuffer(b"".join(x if len(x) > one else x + x for x in column.to_pylist()), np.uint8).reshape(len(column), 2 * one)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many registers each of sketches a agrees with each of b, the more of both kinds."""
    one, kinds = BANDS * ROWS, []
    plain = (a[:, :one] == a[:, one:]).all() and (b[:, :one] == b[:, one:]).all()
    for k in (0,) if plain else (0, 1):
        total = np.zeros((len(a), len(b)), np.uint8)
        for x, y in zip(*(np.ascontiguousarray(s[:, k * one : (k + 1) * one].T) for s in (a, b))):
            total += x[:, None] == y[None, :]
        kinds.append(total)
    return kinds[0] if plain else np.maximum(*kinds)


def likely(pairs: DataFrame, short: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of pairs (a, b) whose registers agree enough; short has (node, sketch)."""
    least = AGREE * similarity * BANDS * ROWS

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 4000) for k in range(0, batch.num_rows, 4000)):
                same = (_rows(part.column("sketch_a")) == _rows(part.column("sketch_b"))).reshape(part.num_rows, 2, BANDS * ROWS).sum(2).max(1)
                yield part.select(["a", "b"]).take(pa.array(np.flatnonzero(same >= least)))

    one, two = (short.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(look, pairs.select("a", "b").schema)


def _forest(a: list, b: list) -> list[int]:
    """Places of those pairs (a, b) that join what the earlier ones have not joined."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for k, (x, y) in enumerate(zip(a, b)):
        x, y = root(x), root(y)
        if x != y:
            up[y] = x
            out.append(k)
    return out


def _meet_in_blocks(crowded: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between different classes within large buckets, enough to join what is linked.

    crowded has key, node, class, keys, sketch, text, n, size and of others, those outside the bucket's
    largest class main, their number and size. They meet all, block by block; blocks are bounded in rows
    and bytes, a text is cut up once a block, and only links leave it.
    """
    least = AGREE * similarity * BANDS * ROWS
    node = crowded.schema["node"].dataType.simpleString()

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        return trimmed(met, left, right)

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        a, b = ([x.column(c).to_pylist() for c in ("node", "class", "keys")] for x in (left, right))
        none = pa.table({c: pa.array([], left.schema.field("node").type) for c in "ab"})
        if not (a[0] and b[0]):
            return none
        key, main = left.column("key")[0].as_py(), left.column("main")[0].as_py()
        number = {c: k for k, c in enumerate({*a[1], *b[1]})}
        ca, cb = (np.array([number[c] for c in x[1]]) for x in (a, b))
        i, j = np.nonzero((agreeing(_rows(left.column("sketch")), _rows(right.column("sketch"))) >= least) & (ca[:, None] != cb[None, :]))
        ka, kb = ([frozenset(k) for k in x[2]] for x in (a, b))
        # two others meet twice, and a pair may share several buckets: it counts once, in the least of these
        own = [k for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())) if (b[1][y] == main or a[0][x] < b[0][y]) and min(ka[x] & kb[y]) == key]
        if not own:
            return none
        i, j = i[own], j[own]
        ti, i = np.unique(i, return_inverse=True)
        tj, j = np.unique(j, return_inverse=True)
        texts = pa.chunked_array([t.column("text").take(pa.array(x)).combine_chunks() for t, x in ((left, ti), (right, tj))]).combine_chunks()
        near = np.flatnonzero(np.maximum(*pair_similarities(shingles(texts), len(texts), i, j + len(ti))) >= similarity)
        i, j = ti[i[near]], tj[j[near]]
        some = _forest([a[1][x] for x in i], [b[1][y] for y in j])
        return pa.table({"a": left.column("node").take(pa.array(i[some])), "b": right.column("node").take(pa.array(j[some]))})

    cuts = lambda n, size: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(size) / BLOCK_BYTES)).cast("int")
    all_, others = cuts("n", "size"), cuts("others", "others_size")
    deal = lambda most: F.pmod(F.xxhash64("node"), most).cast("int")
    each = lambda most: F.explode(F.sequence(F.lit(0), most - 1))
    left = crowded.where(F.col("class") != F.col("main")).withColumn("i", deal(others)).withColumn("j", each(all_))
    right = crowded.withColumn("j", deal(all_)).withColumn("i", each(others))
    grouped = [x.select(*(F.col(c).alias(c) for c in ("key", "i", "j", "node", "class", "main", "keys", "sketch", "text"))).groupBy("key", "i", "j") for x in (left, right)]
    return grouped[0].cogroup(grouped[1]).applyInArrow(block, f"a {node}, b {node}")


def links(texts: DataFrame, bands: DataFrame, similarity: float = SIMILARITY, short: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Linked pairs (a, b), enough to join each class, and the classes (node, component) of the texts that share a bucket.

    texts has doc_id, named node in the others, and text; rows that share a doc_id hold the same text. bands
    has (node, key), a row for each text and band; short has (node, sketch), made from texts if not given.
    """
    short = sketches(texts.withColumnRenamed("doc_id", "node")).select("node", "sketch") if short is None else short
    sizes = stored(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    mates = stored(bands.select("node", "key").join(sizes, "key").groupBy("node").agg(F.sum("n").alias("company"), F.collect_list("key").alias("keys")), "mates")
    mate = mates.select("node")
    once = texts.groupBy("doc_id").agg(F.first("text").alias("text"))  # first, so that copies of one text meet in partial sums
    texts = stored(once.join(mate.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), "candidates")
    short = stored(short.join(mate, "node", "left_semi"), "short")
    each = mates.select("node", "company", F.explode("keys").alias("key"))
    first = F.max(F.struct("company", "node")).alias("r")
    leaders = stored(each.groupBy("key").agg(first).select("key", F.col("r.company").alias("rank"), F.col("r.node").alias("leader")), "leaders")

    def joined(near: DataFrame) -> DataFrame:
        """Classes when these links have joined some."""
        if near.isEmpty():
            return of
        one, two = (of.select(F.col("node").alias(c), F.col("class").alias(f"of_{c}")) for c in "ab")
        whole = components(near.join(one, "a").join(two, "b").where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
        return stored(of.join(whole.withColumnRenamed("node", "class"), "class", "left").select("node", F.coalesce("component", "class").alias("class")), "classes")

    def meet(pairs: DataFrame) -> DataFrame:
        return stored(compare(likely(pairs, short, similarity), texts, similarity), "near")

    # each text and the leader with most company of all its buckets
    best = each.join(leaders, "key").where("node <> leader").groupBy("node").agg(F.max(F.struct("rank", "leader")).alias("r")).select(F.col("node").alias("a"), F.col("r.leader").alias("b"))
    best = stored(best, "best")
    found = meet(best)
    # a leader's own leader is one step on: no class is divided by a link that is missing here, as joined() sees all links later
    up, on = found.select(F.col("a").alias("node"), F.col("b").alias("leader")), found.select(F.col("a").alias("leader"), F.col("b").alias("further"))
    up = up.join(on, "leader", "left").select("node", F.coalesce("further", "leader").alias("class"))
    up = stored(mate.join(up, "node", "left").select("node", F.coalesce("class", "node").alias("class")), "up")
    least = stored(up.groupBy("class").agg(F.min("node").alias("least")), "least")
    of = stored(up.join(least, "class").select("node", F.col("least").alias("class")), "classes")
    # one text of each class in a bucket and its leader
    classed = mates.join(of, "node").select("node", "class", "company", F.explode("keys").alias("key"))
    one = classed.groupBy("key", "class").agg(first).select("key", F.col("r.node").alias("node"))
    pairs = one.join(leaders, "key").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct().join(best, ["a", "b"], "left_anti")
    found = found.unionByName(meet(pairs))
    of = joined(found)
    # whatever shares a bucket and is still of different classes
    classed = mates.join(of, "node").join(texts.select(F.col("doc_id").alias("node"), F.length("text").alias("chars")), "node").select("node", "class", "keys", "chars", F.explode("keys").alias("key"))
    kinds = classed.groupBy("key", "class").agg(F.count("*").alias("n"), F.sum("chars").alias("size"))
    apart = kinds.groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("kinds"), F.max(F.struct("n", "class", "size")).alias("m")).where("kinds > 1")
    apart = stored(apart.select("key", "n", "size", F.col("m.class").alias("main"), (F.col("n") - F.col("m.n")).alias("others"), (F.col("size") - F.col("m.size")).alias("others_size")), "apart")
    members = stored(classed.drop("chars").join(apart, "key").join(short, "node"), "members")
    calm, crowded = members.where(F.col("n") <= CROWD), members.where(F.col("n") > CROWD)
    one, two = (calm.select("key", F.col("node").alias(c), F.col("class").alias(f"of_{c}")) for c in "ab")
    rest = meet(one.join(two, "key").where("a < b and of_a <> of_b").select("a", "b").distinct())
    rest = rest.unionByName(stored(_meet_in_blocks(crowded.join(texts.withColumnRenamed("doc_id", "node"), "node"), similarity), "blocks"))
    found, of = found.unionByName(rest), joined(rest)
    return found, of.withColumnRenamed("class", "component")


def text_id(text: str = "text") -> Column:
    """What names a text: equal for equal texts alone; null texts count as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def text_classes(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of the distinct texts of (text) that share a bucket with another; the others are alone."""
    named = texts.select(text_id().alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    nodes = stored(stored(sketches(named), "sketches").groupBy("node").agg(F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "nodes")
    bands = nodes.select("node", F.explode("keys").alias("key")).where("key is not null")
    return links(named.withColumnRenamed("node", "doc_id"), bands, similarity, nodes.select("node", "sketch"))[1]


def _with_class(rows: DataFrame, of: DataFrame) -> DataFrame:
    """rows (with node) with component, that of their text."""
    return rows.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) for each row of (doc_id, text): class_id is the least doc_id of the class.

    Rows are judged by their texts, so rows without a doc_id and rows that share one have a class too; it
    is null only if no row of a class has a doc_id. Null texts count as empty. Texts without words are
    copies of each other only if equal. Repeated rows each get a row; other columns are left out.
    """
    of = text_classes(docs.select("text"), similarity)
    rows = docs.select("doc_id", text_id().alias("node"))
    least = stored(_with_class(rows.groupBy("node").agg(F.min("doc_id").alias("least")), of), "least")
    ids = stored(least.groupBy("component").agg(F.min("least").alias("class_id")), "ids")
    named = stored(least.join(ids, "component").select("node", "class_id"), "named")
    return rows.join(named, "node").select("doc_id", "class_id")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class of near copies: that of least doc_id (a null one is the last), and of these the one of least text id.

    docs has doc_id and text and any other columns but _id and _text.
    """
    of = text_classes(docs.select("text"), similarity)
    keys = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), text_id().alias("_text")]
    rows = docs.select(F.col("doc_id").isNull().alias("none"), "doc_id", *keys).withColumnRenamed("_text", "node")
    best = _with_class(rows, of).groupBy("component").agg(F.min(F.struct("none", "doc_id", "node", "_id")).alias("r"))
    best = stored(best.select(F.col("r._id").alias("_id"), F.col("r.node").alias("_text")), "best")
    return docs.select("*", *keys).join(best, ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"]).drop("_id", "_text")


def op8_minhash_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of documents with the class of near copies that it belongs to."""
    return near_classes(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

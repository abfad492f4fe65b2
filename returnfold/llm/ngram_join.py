"""Jaccard join of word n-grams by grouped prefixes.

A document is the set of its shingles of WIDTH words, or of all its words if it has fewer. Shingles are
ordered, rare ones first: by the level of a counter that all shingles share by their hashes (COUNTERS of
them, whatever the input), then by hash. Two sets that are linked share one of the first shingles, the
prefix, that their sizes allow. Sets of equal size and prefix are one group; groups that share a prefix
shingle are paired if their sizes and the places of the shingle allow a link; a pair's members are
expanded and compared, shingle by shingle.

Only what joins components counts, so pairs that links have joined before aren't compared again; what
costs little comes first. Members meet their group's first, and groups the group with most company
among those of their shingles; then one set of each component meets that of each of its shingles. What
still lies apart is compared whole: pairs of groups where a shingle has few sets, and blocks of bounded
size, from which only links leave, where it has many. A bitmap of each set, BITS parities, bounds the
overlap of a pair from above, so no pair is lost by it, and texts move only for pairs that it leaves.

Shingles are 64-bit hashes. Equal sets are one set throughout. Null texts and texts without words have
no shingle and are alone. Rows without a doc_id have the component of their set, null if it has no other;
rows that share a doc_id each count. Columns but doc_id and text are left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop, sliced, stored, table, trim
from .components import components
from .near_copies import shingles, text_id

WIDTH, PERCENT = 3, 90
#: Counters of shingles, as a power of two; a block of them is a row on the way to the driver.
COUNTERS, BLOCK_OF_COUNTERS = 20, 4096
#: Shingles of more sets are compared in blocks of about BLOCK sets or BLOCK_BYTES.
CROWD, BLOCK, BLOCK_BYTES = 16, 1000, 8 << 20
#: Bits of a set's bitmap.
BITS = 1024
#: Texts wanted are broadcast by name, 32 bytes each, up to this many; more meet theirs in a shuffle.
MOST_NAMES = 100_000


def need(total: int | np.ndarray, percent: int = PERCENT):
    """Least overlap of two linked sets whose sizes add up to total."""
    return -(-percent * total // (100 + percent))


def prefix_length(n: int | np.ndarray, percent: int = PERCENT):
    return n + percent * -n // 100 + 1


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, shingle), each once."""
    return shingles(pc.ascii_lower(texts), WIDTH)[:2]


def levels(docs: DataFrame) -> bytes:
    """A level for each counter: eight times the logarithm of how many shingles of docs (with text) it has. One byte a counter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTERS, np.int64)
        for batch in batches:
            for part in sliced(batch, "text", 2 << 20):
                total += np.bincount(_sets(part.column("text"))[1] >> np.uint64(64 - COUNTERS), minlength=len(total)).astype(np.int64)
                trim()
        rows = total.reshape(-1, BLOCK_OF_COUNTERS)
        some = np.flatnonzero(rows.any(1))
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array([rows[k].tobytes() for k in some], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                here = np.frombuffer(counts, np.int64)
                total[block] = total[block] + here if block in total else here
        made = [np.minimum(8 * np.log2(1 + x), 255).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.record_batch([pa.array(total, pa.int32()), pa.array(made, pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    out = np.zeros((1 << COUNTERS) // BLOCK_OF_COUNTERS * BLOCK_OF_COUNTERS, np.uint8).reshape(-1, BLOCK_OF_COUNTERS)
    for r in docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect():
        out[r["block"]] = np.frombuffer(r["counts"], np.uint8)
    return out.tobytes()


def ordered_prefixes(docs: DataFrame, level: bytes, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_id, n, node, group, prefix, bits) of (doc_id, text): node names the set, n is its size, prefix its first shingles in order, group names size and prefix, bits is its bitmap. Null where there is none."""
    sent = docs.sparkSession.sparkContext.broadcast(level)
    named = docs.select("doc_id", text_id().alias("text_id"), "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        of = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            for part in sliced(batch, "text", 2 << 20):
                doc, h = _sets(part.column("text"))
                size = np.bincount(doc, minlength=part.num_rows)
                ends = np.cumsum(size)
                flat = h.tobytes()  # by hash
                h = h[np.lexsort((h, of[h >> np.uint64(64 - COUNTERS)], doc))]
                long = prefix_length(size, percent) * (size > 0)
                first = h[np.arange(len(h)) - np.repeat(ends - size, size) < np.repeat(long, size)]
                upto, some = np.cumsum(long), first.tobytes()
                nodes = [xxhash.xxh3_128_digest(flat[8 * (e - n) : 8 * e]) if n else None for n, e in zip(size.tolist(), ends.tolist())]
                groups = [xxhash.xxh3_128_digest(some[8 * (e - p) : 8 * e], n) if n else None for n, p, e in zip(size.tolist(), long.tolist(), upto.tolist())]
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]), pa.int32()), pa.array(first.view(np.int64)))
                yield pa.record_batch([part.column("doc_id"), part.column("text_id"), pa.array(size, pa.int64()), pa.array(nodes, pa.binary()), pa.array(groups, pa.binary()), prefix, bitmaps(doc, h, part.num_rows)], ["doc_id", "text_id", "n", "node", "group", "prefix", "bits"])
                trim()

    return named.mapInArrow(make, "doc_id long, text_id binary, n long, node binary, `group` binary, prefix array<long>, bits array<long>")


def bitmaps(doc: np.ndarray, h: np.ndarray, docs: int) -> pa.Array:
    """For each document the parity of its shingles in each of BITS classes, as longs."""
    odd = np.bincount(doc * BITS + (h % np.uint64(BITS)).astype(np.int64), minlength=docs * BITS) & 1
    words = np.packbits(odd.astype(np.uint8).reshape(docs, BITS), axis=1).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(docs + 1) * (BITS // 64), pa.int32()), pa.array(words.ravel()))


def _split(texts: pa.Array) -> list[np.ndarray]:
    """The shingles of each text, by hash."""
    doc, h = _sets(texts)
    return np.split(h, np.cumsum(np.bincount(doc, minlength=len(texts)))[:-1]) if len(texts) else []


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets are."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def likely(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of pairs (a, b) of nodes that sizes and bitmaps allow; nodes has (node, n, bits)."""
    for c in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")), c)
    total = F.col("n_a") + F.col("n_b")
    differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    near = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (differ <= total - 2 * F.ceil(percent * total / (100 + percent)))
    return pairs.where(near).select("a", "b")


def texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of wanted (node, text_id), a stored table of distinct nodes."""
    named = docs.select(text_id().alias("text_id"), "text")
    few = wanted.limit(MOST_NAMES + 1).count() <= MOST_NAMES
    return stored(named.join(F.broadcast(wanted) if few else wanted, "text_id").groupBy("node").agg(F.first("text").alias("text")), "texts")


def compare(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of pairs (a, b) of nodes that are linked; texts has one row (node, text) for each node."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text_a", 1 << 20):
                coded = pa.chunked_array([part.column("text_a"), part.column("text_b")]).combine_chunks().dictionary_encode()  # a text in several pairs is cut up once
                sets, code = _split(coded.dictionary), coded.indices.to_pylist()
                near = [linked(sets[x], sets[y], percent) for x, y in zip(code[: part.num_rows], code[part.num_rows :])]
                yield part.select(["a", "b"]).filter(pa.array(near, pa.bool_()))
                trim()

    for c in "ab":
        pairs = pairs.join(texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")), c)
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(look, "a binary, b binary")


def _fits(left: pa.Table, right: pa.Table, percent: int) -> np.ndarray:
    """Which pairs of rows (node, class, main, n, place, bits) may be linked: of different classes, and sizes, places and bitmaps allow it. Each once."""
    a, b = ([np.asarray(x.column(c)) for c in ("n", "place")] for x in (left, right))
    (na, ca), (nb, cb) = ([x.column(c).to_pylist() for c in ("node", "class")] for x in (left, right))
    number, rank = ({c: k for k, c in enumerate(sorted({*x, *y}))} for x, y in ((ca, cb), (na, nb)))
    of_a, of_b, rank_a, rank_b = (np.array([by[c] for c in x]) for by, x in ((number, ca), (number, cb), (rank, na), (rank, nb)))
    total = a[0][:, None] + b[0][None, :]
    least = need(total, percent)
    main = number.get(left.column("main")[0].as_py(), -1)
    fits = (of_a[:, None] != of_b[None, :]) & ((of_b == main)[None, :] | (rank_a[:, None] < rank_b[None, :]))  # two outside the main class meet twice
    fits &= np.minimum((a[0] - a[1])[:, None], (b[0] - b[1])[None, :]) >= least
    one, two = (np.unpackbits(np.asarray(x.column("bits").combine_chunks().flatten()).view(np.uint8).reshape(len(x), -1), axis=1).astype(np.float32) for x in (left, right))
    return fits & (one.sum(1)[:, None] + two.sum(1)[None, :] - 2 * (one @ two.T) <= total - 2 * least)


def _dealt(rows: DataFrame, *columns: str):
    """Blocks of rows of a bucket, those outside its largest class on the left, all on the right, grouped together."""
    cuts = lambda n, size: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(size) / BLOCK_BYTES)).cast("int")
    all_, others = cuts("rows", "size"), cuts("others", "others_size")
    deal = lambda most: F.pmod(F.xxhash64("node"), most).cast("int")
    each = lambda most: F.explode(F.sequence(F.lit(0), most - 1))
    left = rows.where(F.col("class") != F.col("main")).withColumn("i", deal(others)).withColumn("j", each(all_))
    right = rows.withColumn("j", deal(all_)).withColumn("i", each(others))
    grouped = [x.select(*(F.col(c).alias(c) for c in ("key", "i", "j", "node", "class", "main", "n", "place", "bits", *columns))).groupBy("key", "i", "j") for x in (left, right)]
    return grouped[0].cogroup(grouped[1])


def _possible(crowded: DataFrame, percent: int) -> DataFrame:
    """(key, node) of those rows of crowded that may be linked with another of their bucket."""

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        nodes = pa.array([], pa.binary())
        if len(left) and len(right):
            fits = _fits(left, right, percent)
            nodes = pa.chunked_array([x.column("node").combine_chunks().filter(pa.array(fits.any(k))) for x, k in ((left, 1), (right, 0))]).combine_chunks()
        return pa.table([pa.array([left.column("key")[0].as_py()] * len(nodes) if len(nodes) else [], pa.int64()), nodes], ["key", "node"])

    return _dealt(crowded).applyInArrow(block, "key long, node binary").distinct()


def _meet_in_blocks(crowded: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different classes within large buckets, enough to join what is linked.

    crowded has key, its place in the set's order, node, class, n, bits, prefix, text, the bucket's largest
    class main, its rows and size, and those outside main, others and others_size. These meet all, block by
    block; a pair counts in the first shingle that both prefixes have.
    """

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        found, up = [], {}

        def root(c):
            while up.setdefault(c, c) != c:
                up[c] = c = up[up[c]]
            return c

        if len(left) and len(right):
            fits = _fits(left, right, percent)
            (na, ca, before), (nb, cb, whole) = ([x.column(c).to_pylist() for c in ("node", "class", "prefix")] for x in (left, right))
            before, whole = [set(p[:k]) for p, k in zip(before, left.column("place").to_pylist())], [set(p) for p in whole]
            sa, sb = (_split(x.column("text").combine_chunks()) for x in (left, right))
            for x, y in zip(*(z.tolist() for z in np.nonzero(fits))):
                p, q = root(ca[x]), root(cb[y])
                if p != q and before[x].isdisjoint(whole[y]) and linked(sa[x], sb[y], percent):
                    up[q] = p
                    found.append((na[x], nb[y]))
            trim()
        return pa.table([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    return _dealt(crowded, "prefix", "text").applyInArrow(block, "a binary, b binary")


def grouped(sets: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Stored tables of those of sets that may be linked with another: nodes (node, group, n, bits, text_id) and groups (group, n, prefix, members, leader)."""
    able = sets.where(100 * F.col("n") >= percent * (F.col("n") + 1))  # smaller ones are linked with none but equal ones
    nodes = stored(able.groupBy("node").agg(F.first("group").alias("group"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("text_id").alias("text_id")), "nodes")
    members = nodes.groupBy("group").agg(F.count("*").alias("members"), F.min("node").alias("leader"))
    groups = stored(able.groupBy("group").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")).join(members, "group"), "groups")
    return nodes, groups


def classes(nodes: DataFrame, groups: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of those of grouped() for docs that share a prefix shingle with another; the others are alone. Deletes nodes and groups."""
    shared = stored(groups.select("members", F.explode("prefix").alias("key")).groupBy("key").agg(F.sum("members").alias("rows")).where("rows > 1"), "shared")
    post = stored(groups.select("group", "n", "leader", F.posexplode("prefix").alias("place", "key")).join(shared, "key"), "post")
    drop(shared)
    mates = stored(post.groupBy("group").agg(F.first("leader").alias("leader"), F.sum("rows").alias("company")), "mates")
    some = stored(nodes.join(mates.select("group"), "group", "left_semi"), "some")
    drop(nodes)
    alone = some.select("node", F.col("node").alias("class"))

    def meet(pairs: DataFrame) -> DataFrame:
        near = stored(likely(pairs, some, percent), "likely")
        if near.isEmpty():
            return near
        wanted = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
        texts = texts_of(stored(some.select("node", "text_id").join(wanted, "node"), "wanted"), docs)
        links = stored(compare(near, texts, percent), "near")
        drop(texts)
        return links

    def joined(of: DataFrame, near: DataFrame) -> DataFrame:
        """Classes when these links have joined some."""
        if near.isEmpty():
            return of
        for c in "ab":
            near = near.join(of.select(F.col("node").alias(c), F.col("class").alias(f"of_{c}")), c)
        whole = components(near.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
        return stored(of.join(whole.withColumnRenamed("node", "class"), "class", "left").select("node", F.coalesce("component", "class").alias("class")), "classes")

    # members and the first of their group; first members and that of the group with most company
    own = some.join(mates, "group").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    keyed = post.select("key", "group", "leader").join(mates.select("group", "company"), "group")
    heads = stored(keyed.groupBy("key").agg(F.max(F.struct("company", "leader")).alias("h")), "heads")
    best = keyed.join(heads, "key").groupBy("leader").agg(F.max("h").alias("h")).select(F.col("leader").alias("a"), F.col("h.leader").alias("b")).where("a <> b")
    of = joined(alone, meet(own.union(best)))
    # one set of each class that a shingle has, and the shingle's head
    placed = some.select("node", "group").join(of, "node")
    kinds = post.select("key", "group").join(placed, "group").groupBy("key", "class").agg(F.min("node").alias("node"))
    heads = heads.select("key", F.col("h.leader").alias("head")).join(of.select(F.col("node").alias("head"), F.col("class").alias("of_head")), "head")
    apart = kinds.join(heads, "key").where(F.col("class") != F.col("of_head")).select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    of = joined(of, meet(apart))
    drop(mates)
    # all that share a shingle and still lie apart
    placed = stored(some.select("node", "group", "n").join(of, "node"), "placed")
    kinds = post.select("key", "group").join(placed, "group").groupBy("key", "class").agg(F.count("*").alias("rows"), F.sum(8 * F.col("n")).alias("size"))
    torn = kinds.groupBy("key").agg(F.sum("rows").alias("rows"), F.sum("size").alias("size"), F.count("*").alias("kinds"), F.max(F.struct("rows", "class", "size")).alias("m")).where("kinds > 1")
    torn = stored(torn.select("key", "rows", "size", F.col("m.class").alias("main"), (F.col("rows") - F.col("m.rows")).alias("others"), (F.col("size") - F.col("m.size")).alias("others_size")), "torn")
    calm, crowded = torn.where(F.col("rows") <= CROWD), torn.where(F.col("rows") > CROWD)
    # few: pairs of groups that sizes and places allow, then their members
    few = post.drop("rows").join(calm.select("key"), "key")
    one, two = (few.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("group", "n", "place"))) for s in "ab")
    total = F.col("n_a") + F.col("n_b")
    allowed = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= F.ceil(percent * total / (100 + percent))
    pairs = one.join(two, "key").where("group_a <= group_b").where(allowed).select("group_a", "group_b").distinct()
    for s in "ab":
        pairs = pairs.join(placed.select(F.col("group").alias(f"group_{s}"), F.col("node").alias(s), F.col("class").alias(f"of_{s}")), f"group_{s}")
    rest = meet(pairs.where("of_a <> of_b and (group_a <> group_b or a < b)").select("a", "b"))
    # many: blocks
    if crowded.isEmpty():
        drop(torn, placed, groups, post)
        return joined(of, rest).withColumnRenamed("class", "component")
    many = post.select("key", "group", "place").join(crowded, "key").join(placed.select("node", "group", "class"), "group").join(some.select("node", "n", "bits"), "node")
    possible = stored(_possible(many, percent), "possible")
    text = texts_of(stored(some.select("node", "text_id").join(possible.select("node").distinct(), "node"), "wanted"), docs)
    many = many.join(possible, ["key", "node"]).join(groups.select("group", "prefix"), "group").join(text, "node")
    rest = rest.unionByName(stored(_meet_in_blocks(many, percent), "blocks"))
    drop(text, possible, torn, placed, groups, post)
    return joined(of, rest).withColumnRenamed("class", "component")


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of (doc_id, text): the size of its set, and the least doc_id that links lead to."""
    docs = documents(docs)
    sets = stored(ordered_prefixes(docs, levels(docs), percent), "sets")
    nodes, groups = grouped(sets.where("n > 0"), percent)
    rows = stored(sets.select("doc_id", "n", "node"), "rows")
    drop(sets)
    of = classes(nodes, groups, docs, percent)
    least = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = stored(least, "least")
    ids = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(least.join(ids, "component").select("node", "component_id"), "named")
    rows = rows.withColumnRenamed("n", "n_shingles")
    full, bare = rows.where("node is not null").join(named, "node"), rows.where("node is null").withColumn("component_id", F.col("doc_id"))
    return full.select("doc_id", "n_shingles", "component_id").unionByName(bare.select("doc_id", "n_shingles", "component_id"))


def op13_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of documents with the component of the join that it belongs to."""
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = {
    "op13_grouped_prefix_join": r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), both_ AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach(a, b) AS (
  SELECT a, b FROM both_ UNION SELECT r.a, p.b FROM reach r JOIN both_ p ON r.b = p.a
)
SELECT s.doc_id, len(s) AS n_shingles, least(s.doc_id, coalesce(min(b), s.doc_id)) AS component_id FROM sets s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s"""
}

"""The corpus operators against brute force, round trips and the libraries they follow."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from returnfold.llm import common, components, langid, line_templates, near_copies, packing, piece_codec, suffix_dedup, syncmers, token_shards, url_filter, vector_search, words

DOC = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "the quick brown fox jumps over a lazy dog while seven wise owls count every star above the old stone bridge near our quiet river town".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(BASE) + rng.choice(["", "", "s", "ing", ",", "."]) for _ in range(n))


TEXTS = [
    prose(1, 60), None, "", "   ", "a", prose(2, 3000), prose(1, 60), prose(3, 40) + "\n\n" + prose(4, 80), "Été où l'île: ça va? ÀÉİ Straße ΣΑΣ 日本語 \U0001f600 é",
    "<|endoftext|> and <|ENDOFTEXT|> it's we'll 12345  two  spaces\ttab\r\nline    x", "x" * 5000, "▁ under ▁▁ score", prose(5, 200) + " " + prose(1, 60),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0]], DOC)  # the first row twice


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(words.tokenizer_path("word_bpe_49k.json"))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_ids_equal_the_library(tokenizer):
    texts = [t or "" for t in TEXTS] * 2
    own = words.WordIds(words.tokenizer_path("word_bpe_49k.json"), most_words=50)
    for _ in range(2):
        ids, n = own.encode(pa.array(texts))
        got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_wavelet_matrix_access_rank_select():
    ids = np.random.default_rng(1).integers(0, 300, 5000) ** 2 % 40_000
    doc_ids, lengths, m = token_shards.open_shard(token_shards.pack_shard(np.array([3, 9]), np.array([4000, 1000]), ids))
    assert doc_ids.tolist() == [3, 9] and lengths.tolist() == [4000, 1000] and (m.decode() == ids).all()
    for i in (0, 1, 511, 512, 4999):
        assert m.access(i) == ids[i]
    for token in {int(ids[0]), int(ids[77]), 7}:
        places = np.flatnonzero(ids == token)
        assert m.count(token) == len(places) and m.places(token) == places.tolist() and m.rank(token, 2500) == (places < 2500).sum()
    assert m.select(int(ids[0]), 10**6) == -1
    assert token_shards.open_shard(token_shards.pack_shard(np.array([1]), np.array([0]), np.empty(0, np.int64)))[2].decode().tolist() == []


def test_token_shards(spark, docs, none, tokenizer):
    rows = common.documents(docs)
    path = common.scratch(spark, "t")
    tokens = token_shards.token_rows(rows, words.tokenizer_path("word_bpe_49k.json"), end_id=2)
    token_shards.write_shards(tokens, token_shards.range_limits(rows, "doc_id", 3), path, shard_tokens=500)
    got = sorted(map(tuple, token_shards.read_documents(spark, path).collect()), key=lambda r: r[1])
    want, start = [], 0
    for i, t in sorted([*enumerate(TEXTS), (0, TEXTS[0])], key=lambda x: x[0]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    assert token_shards.count_token(spark, path, 2) == len(want) == token_shards.find_token(spark, path, 2).count()
    empty = common.scratch(spark, "t")
    token_shards.write_shards(token_shards.token_rows(common.documents(none), words.tokenizer_path("word_bpe_49k.json")), [], empty)
    assert token_shards.read_documents(spark, empty).count() == 0


def test_rank_directory_is_read_from_the_file():
    ids = np.random.default_rng(2).integers(0, 50, 20_000)
    body = bytearray(token_shards.pack_shard(np.array([1]), np.array([len(ids)]), ids))
    _, _, m = token_shards.open_shard(bytes(body))
    size = (len(ids) + 7) // 8
    first = len(body) - sum(r.nbytes for r in m.ranks) - size * len(m.planes)
    body[first + size - 64 : first + size] = bytes(64)  # the end of the first plane
    _, _, damaged = token_shards.open_shard(bytes(body))
    assert [damaged.access(i) for i in range(0, 15_000, 997)] == ids[0:15_000:997].tolist()
    with pytest.raises(ValueError):
        damaged.decode()
    assert damaged.rank(int(ids[5]), 15_000) == (ids[:15_000] == ids[5]).sum()


def test_null_ids_come_first(spark, tokenizer):
    rows = [(5, prose(1, 30)), (None, prose(2, 20)), (2, prose(3, 10)), (None, prose(2, 20)), (3, None)]
    df = common.documents(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, bucket string, h int"))
    path = common.scratch(spark, "t")
    token_shards.write_shards(token_shards.token_rows(df, words.tokenizer_path("word_bpe_49k.json"), end_id=2), token_shards.range_limits(df, "doc_id", 2), path)
    got = sorted(map(tuple, token_shards.read_documents(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 2, 3, 5] and got[0][2:] == got[1][2:]
    ids = [*tokenizer.encode(rows[1][1], add_special_tokens=False).ids, 2]
    assert got[0] == (None, 0, len(ids), crc(ids)) and got[1][1] == len(ids)
    found = token_shards.find_token(spark, path, 2).collect()
    assert sorted(r["doc_id"] or 0 for r in found) == [0, 0, 2, 3, 5]
    edits = {(r["doc_id"], r["n_chars"]): r for r in syncmers.compare_edits(df, 2).collect()}
    assert len(edits) == 4 and edits[5, len(rows[0][1])]["edited_sha256"] == hashlib.sha256((rows[0][1][: len(rows[0][1]) - len(rows[0][1]) // 2] + rows[1][1][: len(rows[0][1]) // 2]).encode()).hexdigest()
    assert packing.pack(common.stored(packing.token_pieces(df, words.tokenizer_path("word_bpe_49k.json"), 1, 512), "p"), 512).count() == 5


def test_fingerprints_equal_brute_force():
    texts = [t.encode() for t in (prose(1, 60), prose(1, 60) + " more words at its end", prose(2, 900), "short", "")]
    rows = syncmers.fingerprints(texts)
    for text, row in zip(texts, rows):
        least = {}
        for p in range(len(text) - syncmers.K + 1):
            mers = [syncmers.mixed(syncmers.rolling(np.frombuffer(text[p + q : p + q + syncmers.S], np.uint8), syncmers.S))[0] for q in range(syncmers.K - syncmers.S + 1)]
            if min(mers) in (mers[0], mers[-1]):
                with np.errstate(over="ignore"):
                    h = int(syncmers.mixed(np.array([mers[0] * syncmers._A + mers[-1]], np.uint64))[0])
                slot = h % syncmers.SLOTS
                least[slot] = min(least.get(slot, syncmers.EMPTY), h >> 32)
        if least:
            assert {k: v for k, v in enumerate(row.tolist()) if v != syncmers.EMPTY} == least
    used = (rows[:1] != syncmers.EMPTY) | (rows[1:2] != syncmers.EMPTY)
    assert syncmers.likeness(rows[:1], rows[1:2])[0] == pytest.approx(((rows[0] == rows[1]) & used[0]).sum() / used.sum()) and syncmers.likeness(rows[4:], rows[4:])[0] == 1


def test_packing(spark, docs, none, tokenizer):
    pieces = common.stored(packing.token_pieces(common.documents(docs), words.tokenizer_path("word_bpe_49k.json"), 1, 512), "p")
    got = packing.pack(pieces, 512).collect()
    want = []
    for i, t in [*enumerate(TEXTS), (0, TEXTS[0])]:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k // 512, k, len(ids[k : k + 512]), crc(ids[k : k + 512])) for k in range(0, len(ids), 512)]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by) <= -(-sum(w[3] for w in want) // 512) + 1
    assert packing.pack(common.stored(packing.token_pieces(common.documents(none), words.tokenizer_path("word_bpe_49k.json"), 1, 512), "p"), 512).count() == 0


def test_packing_across_blocks_stays_near_the_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 40)
    monkeypatch.setattr(packing, "MERGED", 3)
    rng = random.Random(3)
    lengths = [rng.randint(30, 500) for _ in range(600)]
    pieces = common.stored(spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECE), "p")
    got = packing.pack(pieces, 1000).collect()
    whole = packing.best_fit(sorted(range(600), key=lambda i: -lengths[i]), lengths, 1000)  # best fit of all pieces at once
    assert len(got) == 600 and len({r["sequence_id"] for r in got}) <= len(whole) * 1.02


def test_genetic_steps_keep_every_item():
    rng = random.Random(5)
    lengths = [rng.randint(1, 60) for _ in range(200)]
    population = packing.first_population(lengths, 100, 1)
    child = packing.mutate(packing.crossover(population[0], population[-1], lengths, 100, rng), lengths, 100, rng)
    assert sorted(i for b in child for i in b) == list(range(200)) and all(sum(lengths[i] for i in b) <= 100 for b in child)
    assert len(packing.evolve(population, lengths, 100, 1)[0]) <= len(population[0])


def test_syncmers_move_with_text_and_fingerprints(spark, docs, none):
    a, b = prose(7, 300).encode(), b"some other start " + prose(7, 300).encode()
    (pa_, ha), (pb, hb) = (syncmers.closed_syncmers(np.frombuffer(x, np.uint8)) for x in (a, b))
    shift = len(b) - len(a)
    assert {(p + shift, h) for p, h in zip(pa_.tolist(), ha.tolist())} <= set(zip(pb.tolist(), hb.tolist()))
    for at in pa_[:50].tolist():  # by the definition
        hashes = syncmers.mixed(syncmers.rolling(np.frombuffer(a[at : at + syncmers.K], np.uint8), syncmers.S))
        assert hashes.min() in (hashes[0], hashes[-1])
    order = sorted([*enumerate(TEXTS), (0, TEXTS[0])], key=lambda x: x[0])
    got = sorted(syncmers.compare_edits(common.documents(docs), 3).collect(), key=lambda r: r["doc_id"])
    texts = [t or "" for _, t in order]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:] + texts[:1])]
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got] == [(i, len(t), hashlib.sha256(e.encode()).hexdigest()) for (i, _), t, e in zip(order, texts, edited)]
    same = {}
    for t, r in zip(texts, got):
        assert same.setdefault(t, r["fingerprint"]) == r["fingerprint"] and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert syncmers.compare_edits(common.documents(none), 3).count() == 0
    assert syncmers.fingerprint(docs).count() == len(TEXTS) + 1 and syncmers.anchors(docs).count() > 0


def brute_removals(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(first.get(b[p : p + length], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [512, 2])
def test_suffix_dedup(spark, docs, none, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 9000)
    shared = prose(9, 30)
    more = [(100 + i, f"{prose(20 + i, 5 + i)} {shared} {prose(50 + i, 9)}", "en", "s", 1) for i in range(30)] + [(5, shared, "en", "s", 1)]
    rows = docs.unionByName(spark.createDataFrame(more, DOC))
    got = sorted(map(tuple, suffix_dedup.removals(common.documents(rows)).collect()))
    assert got == brute_removals([(r["doc_id"], r["text"]) for r in rows.collect()])
    assert suffix_dedup.removals(common.documents(none)).count() == 0


def test_suffix_dedup_null_ids_come_last(spark):
    t = prose(1, 40)
    rows = spark.createDataFrame([(None, t), (7, t)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.removals(rows).collect()}
    assert got == {None: len(t), 7: 0}


def test_multikey_runs():
    data = np.frombuffer(b"abcdefgh" * 20 + b"abcdefgX" * 20, np.uint8)
    at = np.arange(len(data) - 60)
    run = suffix_dedup.multikey_runs(data, at)
    by = {}
    for p, r in zip(at.tolist(), run.tolist()):
        assert by.setdefault(bytes(data[p : p + 50]), r) == r
    assert len(set(by.values())) == len(by)


def test_pieces_equal_the_library(spark, docs, none):
    import sentencepiece

    path = words.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted(map(tuple, piece_codec.piece_digests(common.documents(docs), path).collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in [*enumerate(TEXTS), (0, TEXTS[0])]:
        ids = sp.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    assert got == sorted(want)
    back = piece_codec.decode_pieces(piece_codec.encode_pieces(common.documents(docs), path), path)
    assert {r["doc_id"]: r["text"] for r in back.collect()}[0] == TEXTS[0]
    assert piece_codec.piece_digests(common.documents(none), path).count() == 0


def test_agenda_rows_equal_the_heap_and_decoding_the_library():
    path = words.tokenizer_path("piece_bpe_32k.model")
    codec = piece_codec.MergeCodec(path)
    some = list({f"\u2581{w}" for t in TEXTS if t for w in t.split()} | {"\u2581" + "ab" * 40, "\n", "\u65e5\u672c\U0001f600", "\u2581"})
    for w, row in zip(some, codec._learn(pa.array(some))):
        assert codec.rows.row(row) == codec.merge(w)
    byte = codec.bytes
    lists = [codec.lib.encode(t) for t in TEXTS if t] + [[], [byte[0xE6], byte[0x97]], [1, byte[0x41]], [codec.ids["\u2581"]] * 3, [byte[0xFF]], codec.lib.encode("a")[1:]]
    assert codec.decode(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == [codec.lib.decode(x) if x else "" for x in lists]
    assert codec.decode(pa.array([None, [5000]], pa.list_(pa.int32()))).to_pylist() == [None, codec.lib.decode([5000])]


def test_line_templates(spark, docs, none):
    rng = random.Random(1)
    rows = [(i, f"{prose(100 + i, rng.randint(5, 30))}\nAll rights reserved here.\n{prose(200 + i, rng.randint(5, 30))}\nPage {i} of 99 printed on day {i * 7}\n{prose(300 + i, rng.randint(5, 30))}", "en", "s", 1) for i in range(30)]
    copies = [(1000 + i, "one line of text here\nanother line of text there\nthe last line of the text", "en", "s", 1) for i in range(50)]
    got = {r["doc_id"]: r for r in line_templates.drop_templates(docs.unionByName(spark.createDataFrame(rows + copies, DOC)).where("doc_id <> 0 or true")).collect()}
    for i, text, *_ in rows[1:]:
        if i >= len(TEXTS):
            lines = text.split("\n")
            assert got[i]["text"] == "\n".join([lines[0], lines[2], lines[4]]) and got[i]["n_dropped"] == 2 and not got[i]["emptied"]
    for i, text, *_ in copies:
        assert got[i]["text"] == text  # copies of one document are not independent
    assert got[1]["text"] is None or got[1]["n_lines"] > 0
    assert line_templates.drop_templates(none).count() == 0


def test_varying_fields_make_one_template(spark):
    names = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, f"{prose(i, 5 + 3 * i)}\nuser logged in as {w} from the main office\n{prose(50 + i, 40 - 3 * i)}", "en", "s", 1) for i, w in enumerate(names)]
    got = line_templates.drop_templates(spark.createDataFrame(rows, DOC)).collect()
    assert all(r["n_dropped"] == 1 and "logged" not in r["text"] for r in got)


def test_a_leaf_holds_several_templates_and_short_lines_count(spark):
    names = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    line = lambda i, w: f"job run ended with code {w} after all retries" if i % 3 else f"job run ended with {w} warnings in total here"
    rows = [(i, f"{prose(i, 5 + 9 * i)}\n{line(i, names[i % 10])}\nThe end.\n{prose(50 + i, 8 + i % 7)}", "en", "s", 1) for i in range(40)]
    rows += [(100 + i, f"{prose(700, 30)}\nOnly in copies.\n{prose(701, 40)}", "en", "s", 1) for i in range(60)]
    df = spark.createDataFrame([*rows, (None, "x\nThe end.\nThe end.", None, None, None)], DOC).withColumnsRenamed({"lang": "h", "source": "_gone"})
    out = line_templates.drop_templates(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped", "emptied"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(got[i]["n_dropped"] == 2 and "job run" not in got[i]["text"] for i in range(40))
    assert all(got[100 + i]["n_dropped"] == 0 for i in range(60))
    assert got[None]["text"] == "x" and got[None]["n_dropped"] == 2


def test_recurrence_does_not_fade_with_size(spark):
    for docs in (12, 900):  # one line among ever more independent documents, all of its lines' neighbours alike
        rows = [(i, f"one two three\nThe end.\n" + "\n".join(prose(1000 + 7 * i + k, 20) for k in range(i % 11)), "en", "s", 1) for i in range(docs)]
        got = line_templates.drop_templates(spark.createDataFrame(rows, DOC))
        assert got.where("n_dropped = 2").count() == docs


def shingle_set(t):
    w = (t or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_copies_equal_brute_force(spark, docs, none):
    base = prose(11, 120).split()
    rng, rows = random.Random(2), []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"new{i}"
        rows.append((500 + i, " ".join(w), "en", "s", 1))
    rows += [(600 + i, prose(900 + i, 80), "en", "s", 1) for i in range(20)]
    both = docs.unionByName(spark.createDataFrame(rows, DOC))
    got = {r["doc_id"]: r["class_id"] for r in near_copies.near_classes(both).collect()}
    known = {r["doc_id"]: r["text"] or "" for r in both.collect()}
    up = {i: i for i in known}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(known)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            sa, sb = shingle_set(known[a]), shingle_set(known[b])
            if known[a] == known[b] or (sa | sb and len(sa & sb) / len(sa | sb) >= 0.8):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in ids}
    assert near_copies.near_classes(none).count() == 0


def test_near_copies_that_differ_in_repetitions_alone(spark):
    rows = [(2 * k, prose(9000 + k, 120)) for k in range(12)]
    rows += [(i + 1, t + " " + " ".join(t.split()[:10] * 60)) for i, t in rows]
    plain, weighted = near_copies.similarities(pa.array([t for _, t in rows[:12]]), pa.array([t for _, t in rows[12:]]))
    assert plain.min() >= near_copies.SIMILARITY and weighted.max() < 0.5
    got = near_copies.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: i // 2 * 2 for i, _ in rows}


@pytest.mark.parametrize("others", [0, 30])
def test_near_copies_within_crowded_buckets_and_beside_representatives(spark, others):
    long = prose(7000, 400).split()
    rows = [(i, " ".join(long[15 * k : 15 * k + 200])) for i, k in ((1, 0), (2, 1), (4, 2), (3, 3), (7, 4), (5, 5))]  # a chain: each like the next alone
    rows += [(100 + k, prose(7100 + k, 100)) for k in range(others)] + [(200, prose(7100, 100) + " end"), (0, prose(7200, 100))]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    bands = texts.select(F.col("doc_id").alias("node"), F.lit(25).alias("band"), F.lit(1).cast("long").alias("key"))
    got = {r["node"]: r["component"] for r in near_copies.links(texts, bands)[1].collect()}
    linked = {**dict.fromkeys((1, 2, 3, 4, 5, 7), 1), **(dict.fromkeys((100, 200), 100) if others else {})}
    assert got == {i: linked.get(i, i) for i, _ in rows}


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(4)
    a, b = rng.integers(1, 6, 200).astype(float), rng.integers(1, 6, 200).astype(float)
    elements = syncmers.mixed(np.arange(1, 301, dtype=np.uint64))
    ea, eb = elements[:200], elements[100:]
    who = near_copies.prob_minhash(np.repeat([0, 1], 200), np.concatenate([ea, eb]), np.concatenate([a, b]), 2, 2048)
    fa, fb = np.zeros(300), np.zeros(300)
    fa[:200], fb[100:] = a, b
    exact = sum(1 / np.maximum(fa / fa[i], fb / fb[i]).sum() for i in range(100, 200))
    assert abs((who[0] == who[1]).mean() - exact) < 0.04


def test_weighted_similarity():
    plain, weighted = near_copies.similarities(pa.array(["a b c d e a b c d e a b c d e"]), pa.array(["a b c d e"]))
    assert plain[0] == pytest.approx(1 / 5) and 0 < weighted[0] < 1


def test_language_id(spark, docs, none):
    rng = random.Random(8)
    make = lambda alphabet: " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(3, 8))) for _ in range(60))
    rows = [(i, make("abcdehiklmnoprstuu"), "xx", "s", 1) for i in range(120)] + [(200 + i, make("éàèôûçaeiouvwyzjq"), "yy", "s", 1) for i in range(120)]
    df = spark.createDataFrame([*rows, (900, None, None, None, None), (901, "123 !!", None, None, None), (902, "", "xx", None, None)], DOC)
    models = langid.learn(df.where(~langid.held_out()))
    got = {r["doc_id"]: r for r in langid.predict(df, models).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang, *_ in rows) >= 238
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(got[i]["rejected"] for i, *_ in rows) <= 2
    assert langid.learn(none) is None and langid.predict(none, None).count() == 0


def test_models_are_distributions():
    models = langid.CharacterModels({"a": {"abc": 3, "abd": 1, "b": 2}, "b": {"xyz": 1}}, 3)
    cost, length = models.score(["abc", "zzz", ""])
    assert (cost >= 0).all() and length.tolist() == [4, 4, 0] and cost[0, 0] < cost[0, 1]


def test_models_equal_plain_kneser_ney():
    counts = {"a": {"abc": 3, "abd": 1, "bab": 2, "cad": 1, "a": 4}, "b": {"xyz": 1, "zyx": 2, "yy": 1, "abx": 1}}
    order, models = 3, langid.CharacterModels(counts, 3)

    def plain(lang, word):
        raw = [{} for _ in range(order)]  # counts of n-grams; the first mark is never predicted
        for w, times in counts[lang].items():
            t = f"\x01{w}\x01"
            for n in range(1, order + 1):
                for e in range(max(n - 1, 1), len(t)):
                    raw[n - 1][t[e - n + 1 : e + 1]] = raw[n - 1].get(t[e - n + 1 : e + 1], 0) + times
        used = [{g: max(1, sum(1 for x in raw[n + 1] if x[1:] == g)) for g in raw[n]} if n + 1 < order else raw[n] for n in range(order)]
        alphabet = max([2, *({len({c for w in counts[x] for c in w}) + 1 for x in counts})])

        def p(context, c, n):
            if n == 0:
                return 1 / (4 * alphabet)
            grams = used[n - 1]
            ones, twos = (sum(1 for v in grams.values() if v == k) for k in (1, 2))
            d = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
            same = {g: v for g, v in grams.items() if g[:-1] == context[len(context) - n + 1 :]} if n > 1 else grams
            lower = p(context, c, n - 1)
            if not same:
                return lower
            return max(0, same.get((context[len(context) - n + 1 :] if n > 1 else "") + c, d) - d) / sum(same.values()) + d * len(same) / sum(same.values()) * lower

        t = f"\x01{word}\x01"
        return -sum(np.log(p(t[max(0, e - order + 1) : e], t[e], min(order, e + 1))) for e in range(1, len(t)))

    probes = ["abc", "zyx", "abx", "qq", "bad", "y"]
    cost, _ = models.score(probes)
    for k, lang in enumerate(models.languages):
        assert cost[:, k] == pytest.approx([plain(lang, w) for w in probes], rel=1e-4)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, 600 + i) for i in range(50)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_filter(spark):
    canonical = '<html><link rel="canonical" href="{}"></html>'
    pages = [
        (1, "http://A.Example.NET/en/x?q#f", ""), (2, "https://b.example.net/de/", ""), (3, "http://c.org/", canonical.format("http://b.example.net/zz/")), (4, "http://c.org/fr/1", canonical.format("http://z.net/")),
        (5, None, None), (6, "no scheme", ""), (7, "http://example.com/de/", ""), (8, "http://notexample.com/de/", ""), (9, "http://net", ""), (10, "http://c.org/", ""),
        (11, "http://d.org/", canonical.format("http://z.net/")), (12, "http://d.org/x", '<meta http-equiv="refresh" content="0; url=http://q.net/a">'), (13, "http://e.org/", canonical.format("/de")), (7, "http://example.com/de/", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, url_filter.RULES).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("b.example.net", "/de/", "net/", "block")
    assert got[3] == ("c.org", "/", None, "block") == got[10]  # by the canonical address, a net/ page
    assert got[4] == ("c.org", "/fr/1", "org/fr/", "allow")
    assert got[11][3] == "allow"  # its component holds an allowed page as well as a blocked one
    assert got[12] == ("d.org", "/x", None, "block") and got[13][3] == "allow"
    assert got[5] == ("", "", None, "allow") == got[6]
    assert got[7][2:] == ("example.com/de/", "block") and got[8][2:] == (None, "allow") and got[9] == ("net", "", None, "allow")
    assert url_filter.judge(df.where("false"), url_filter.RULES).count() == 0
    rules = spark.createDataFrame(list(url_filter.RULES.items()), "rule string, verdict string")
    long = {(r["host"], r["path"]): r["rule"] for r in url_filter.longest_rules(url_filter.host_and_path(df), rules).collect()}
    assert long == {(h, p): r for h, p, r, _ in got.values() if r}


def test_links_are_resolved(spark):
    link = '<html><head><LINK href="{}" rel="nofollow canonical"></head></html>'
    base = "http://A.org/x/y/z.html?q=1#top"
    cases = {
        "y.html": "http://a.org/x/y/y.html", "../w": "http://a.org/x/w", "./": "http://a.org/x/y/", "../..": "http://a.org/", "../../../../v": "http://a.org/v", "?p=2": "http://a.org/x/y/z.html?p=2", "/r?a=1&amp;b=2": "http://a.org/r?a=1&b=2", "//Z.net/&#x2F;k": "http://z.net//k",
        "http://z.net/?a=1&#38;b=2#f": "http://z.net/?a=1&b=2", "https://z.net": "https://z.net", "#part": "http://a.org/x/y/z.html?q=1", "mailto:x@y.net": None,
    }
    for to, want in cases.items():
        page = spark.createDataFrame([(1, base, link.format(to))], "page_id long, url string, html string")
        assert {r["b"] for r in url_filter.page_links(page).collect()} == {"http://a.org/x/y/z.html?q=1", want or "http://a.org/x/y/z.html?q=1"}, to


def test_redirects_carry_verdicts_and_equal_the_sql(spark):
    import duckdb

    link, hop = '<link rel=canonical href="{}">', """<meta http-equiv="Refresh" content="3;URL='{}'">"""
    pages = [
        (1, "http://a.org/one/p.html", link.format("two.html")), (2, "http://a.org/one/two.html", hop.format("../three")), (3, "http://a.org/three", link.format("http://b.net/x?a=1&amp;b=2")), (4, "http://c.org/k", link.format("http://B.NET/x?a=1&b=2#frag")),
        (5, "http://d.org/", hop.format("?p=2")), (6, "http://d.org/?p=2", link.format("http://example.net/en/") + link.format("http://b.net/x?a=1&b=2")), (7, "http://e.org/", link.format("mailto:a@b.net")), (8, "http://f.org/a/./b", None), (9, "http://f.org/a/b", link.format("http://example.com/de/")), (10, None, link.format("/x")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted(map(tuple, url_filter.judge(df, url_filter.RULES).collect()))
    # 6 names an allowed address besides the blocked one, so all that lead there are allowed
    assert {r[0]: r[4] for r in got} == {1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "block", 10: "allow"}
    blocked = {r["page_id"]: r["verdict"] for r in url_filter.judge(df.where("page_id not in (5, 6)"), url_filter.RULES).collect()}
    assert [blocked[i] for i in (1, 2, 3, 4, 7)] == ["block"] * 4 + ["allow"]
    with duckdb.connect() as db:
        db.register("pages", df.toPandas())
        assert sorted(db.sql(url_filter.ORACLE["op10_url_filter"]).fetchall()) == got


def test_vector_search(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(10)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0] * 3), (2004, [float("inf")] + [1.0] * 15), (2005, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vector_search.search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    fit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i < 2000}
    hit = total = 0
    for q in (i for i in fit if i % 50 == 0):
        want = sorted(((-round(float(fit[q] @ v), 12), i) for i, v in fit.items() if i != q))[:5]
        hit, total = hit + len({i for _, i in want} & {i for i, _ in got[q]}), total + 5
    assert hit / total >= 0.9
    assert [i for i, _ in got[0]] == [1000, 1001, 1002, 1003, 1004]  # ties go to the smaller id
    assert vector_search.search(df.where("false"), df).count() == 0


def test_pruned_lists_hold_the_neighbours():
    rng = np.random.default_rng(3)
    vectors = vector_search.unit(rng.normal(size=(4000, 32)))
    graph = vector_search.CentroidGraph(vector_search.balanced_centroids(vectors, len(vectors) // vector_search.PER_LIST))
    lists, queries = vector_search.lists_of(graph, vectors), vectors[::40]
    probes = vector_search.probes_of(graph, queries)
    assert np.mean([len(p) for p in probes]) < 0.4 * len(graph.centroids)  # most lists are left out
    near = np.argsort(-(queries @ vectors.T), axis=1)[:, 1:6]
    assert np.mean([bool(set(p) & set(lists[j])) for p, js in zip(probes, near) for j in js]) >= 0.9


def test_equal_vectors_make_one_list():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(6000, 16))
    rows[::3] = rows[0]
    vectors = vector_search.unit(rows)
    graph = vector_search.CentroidGraph(vector_search.balanced_centroids(vectors, 600))
    assert len(np.unique(np.round(graph.centroids, 6), axis=0)) == len(graph.centroids) > 400
    near = vector_search.unit(rows[0] + rng.normal(size=(50, 16)) * 0.5)
    home = vector_search.lists_of(graph, vectors[:1])[0][0]
    probes = vector_search.probes_of(graph, near)
    assert all(home in p for p in probes)
    lists = vector_search.lists_of(graph, vectors[1::3])
    found = [bool(set(lists[i]) & set(p)) for q, p in zip(near, probes) for i in np.argsort(-(vectors[1::3] @ q))[:5]]
    assert np.mean(found) >= 0.9

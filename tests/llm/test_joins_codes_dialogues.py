"""Operators 11 to 13 against brute force."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest

from returnfold.llm import dialogue_repair as R
from returnfold.llm import ngram_join as N
from returnfold.llm import vector_codes as V

CONV = "conv_id long, turn long, role string, text string, cost string"
GO = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WORD = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, lines) of rows (role, text, must go, truncated), by search in order of cost and audit."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, list(out)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        for r in "ua":
            if (state, r) in GO:
                heapq.heappush(heap, (cost + 5, audit + "I", i, GO[state, r], (*out, (WORD[r], ""))))
        if i < len(rows):
            role, text, gone, late = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if not gone:
                if (state, role[:1]) in GO:
                    heapq.heappush(heap, (cost + 5 * late, audit + "K", i + 1, GO[state, role[:1]], (*out, (role, text))))
                for r in "ua":
                    if (state, r) in GO:
                        heapq.heappush(heap, (cost + 1 + 5 * late, audit + "R", i + 1, GO[state, r], (*out, (WORD[r], text))))


def expected(rows):
    """Report of one conversation's rows (turn, role, text)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, lines = cheapest(marked)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **counts, "illegal": sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        "cost": cost, "audit": audit, "sha": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
    }


def conversations(seed, n, longest):
    rng, out = random.Random(seed), []
    for conv in [None, *range(n)]:
        for k in range(rng.randint(1, longest)):
            text = rng.choice(["Yes.", "No!", "cut off", "", " \t\n", None, "Why?", "é. ", "x" * rng.randint(1, 30) + "."])
            out.append((conv, rng.choice([k, k, k, None, rng.randint(0, 5)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text, "own"))
    return out


@pytest.mark.parametrize("block", [3, 1024])
def test_repairs_are_the_cheapest(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    rows = conversations(block, 60, 14)
    report, mended = R.repair(spark.createDataFrame(rows, CONV))
    got = {r["conv_id"]: r.asDict() for r in report.collect()}
    sha = {r["conv_id"]: r["repaired_sha256"] for r in R.digests(mended).collect()}
    by = {}
    for conv, *row in rows:
        by.setdefault(conv, []).append(tuple(row[:3]))
    assert set(got) == set(by)
    for conv, of in by.items():
        want = expected(of)
        assert {k: got[conv][k] for k in want if k != "sha"} == {k: v for k, v in want.items() if k != "sha"}
        assert sha.get(conv, hashlib.sha256(b"").hexdigest()) == want["sha"]


def test_nodes_are_made_once_for_shared_ends():
    path = R.Path()
    for word in sorted(w[::-1] for w in ["suaua", "uaua", "ua", "uaUa", "uaUa"]):
        path.first(word)
    assert path.made == len({w[::-1][:k] for w in ["suaua", "uaua", "ua", "uaUa"] for k in range(1, len(w) + 1)})


def test_damage_and_lost_conversations(spark):
    rows = [(c, t, "assistant", f"Turn {t}. Yes!") for c in (*range(30), None) for t in (*range(4), None)]
    got = sorted(map(tuple, R.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=repr)
    want = []
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if code == 4 else role, "" if code == 1 else text.replace(".", "").replace("!", "") if code == 2 else text)
        want += [row] * (0 if code == 0 else 2 if code == 3 else 1)
    assert got == sorted(want, key=repr)
    empty = spark.createDataFrame([], CONV)
    report, mended = R.repair(empty)
    assert report.count() == 0 and mended.count() == 0


def codes_by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = np.array([[int(np.floor(256 * np.float64(x))) for x in r[1]] for r in rows], dtype=object)
    books, out = [], [None] * 16
    for p, parts in enumerate(np.split(v, 16, axis=1)):
        book = [list(x) for x in parts[:64]]
        near = lambda: [min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book)) for x in parts]
        for _ in range(2):
            of = [k for _, k in near()]
            for k in range(len(book)):
                if mine := [x for x, h in zip(parts, of) if h == k]:
                    book[k] = [sum(c) // len(mine) for c in zip(*mine)]
        out[p] = near()
        books += [c for e in book for c in e]
    found = [("".join(f"{out[p][i][1]:02x}" for p in range(16)), sum(out[p][i][0] for p in range(16))) for i in range(len(rows))]
    return rows, found, hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()


@pytest.mark.parametrize("n,scale", [(150, 1.0), (20, 1.0), (90, 3e5)])
def test_codes_equal_plain_assignment(spark, n, scale):
    rng = np.random.default_rng(n)
    rows = [(None if k % 50 == 49 else int(k // 2 if k % 30 == 0 else k), [float(x) for x in np.float32(rng.normal(size=32) * scale)], int(k % 3) if k % 7 else None, "x") for k in range(n)]
    rows += [(rows[3][0], rows[3][1], 1, "x")] * 5  # repeated rows
    bad = [(1000, None, 0, "x"), (1001, [None] + [0.0] * 31, 0, "x"), (1002, [float("nan")] * 32, 0, "x"), (1003, [float("inf")] * 32, 0, "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int, code string").repartition(4)
    coded, books = V.fit(V.whole_vectors(df))
    got = V.by_label(coded).collect()
    given, found, sha = codes_by_hand(rows)
    assert V.digest(books) == sha
    labels = {}
    for (_, _, label, _), (_, error) in zip(given, found):
        labels[label] = labels.get(label, 0) + error
    want = sorted(((r[0], c, e, labels[r[2]]) for r, (c, e) in zip(given, found)), key=repr)
    assert sorted(((r["vec_id"], bytes(r["code"]).hex(), r["error"], r["label_error"]) for r in got), key=repr) == want


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    none, _ = V.fit(V.whole_vectors(spark.createDataFrame([], schema)))
    assert V.by_label(none).count() == 0
    short, books = V.fit(V.whole_vectors(spark.createDataFrame([(1, [0.5] * 5, 0), (2, [], 0), (3, [-0.001] * 17, None), (4, [3e38] * 17, None)], schema)))
    rows = {r["vec_id"]: r for r in V.by_label(short).collect()}
    assert books.shape == (16, 4, 2) and {rows[k]["error"] for k in (1, 2, 3)} == {0}


def test_balls_keep_ties_low():
    rng = np.random.default_rng(1)
    books = rng.integers(-3, 4, size=(64, 2))
    parts, old = rng.integers(-3, 4, size=(3000, 2)), V.Balls(rng.integers(-3, 4, size=(64, 2)))
    balls = V.Balls(books)
    assert (balls.again(parts, old.first(parts)) == balls.first(parts)).all()


def sets_by_hand(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\f\r", "     ")).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else {tuple(words)} if words else set()


def components_by_hand(rows):
    sets = [sets_by_hand(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        r = root(k)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, len(s), least[root(k)]) for k, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize("crowd", [16, 2])
def test_join_equals_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(N, "CROWD", crowd)
    rng = random.Random(crowd)
    vocabulary = [f"w{k}" for k in range(400)] + ["É", "ß", "A", "İx"]
    texts = [None, "", " \t\n", "one", "One", "two words", "TWO\x0bwords", "two words ", "a b c", "é b c", "É b c"]
    for n in (8, 9, 10, 11, 19, 20, 40, 40, 120, 120, 300):
        base = rng.choices(vocabulary, k=n)
        for _ in range(9):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[k], rng.choice(vocabulary)]])
            texts.append(rng.choice([" ", "\n"]).join(words))
    common = rng.choices(vocabulary, k=60)
    texts += [" ".join(common + rng.choices(vocabulary, k=rng.randint(0, 20))) for _ in range(40)]
    rows = [(None if k % 40 == 7 else k // 2 if k % 25 == 3 else k, t) for k, t in enumerate(texts)] + [(5000, texts[40])] * 3
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_shingles int, node int").repartition(5)
    got = sorted(map(tuple, N.jaccard_components(df).collect()), key=repr)
    assert got == components_by_hand(rows)


def test_join_of_a_long_text_and_an_empty_table(spark):
    long = " ".join(f"t{k % 5003} {k}" for k in range(100_000))
    rows = [(1, long), (2, long + " end"), (3, "short one here"), (4, None)]
    assert sorted(map(tuple, N.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect())) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert N.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefixes_keep_every_link():
    for n in range(1, 200):
        for m in range(n, min(2 * n, 220)):
            least = N.need(n + m)
            assert 100 * least >= 90 * (n + m - least) and 100 * (least - 1) < 90 * (n + m - least + 1)
            if least <= n:
                assert N.prefix_length(n) > n - least and N.prefix_length(m) > m - least

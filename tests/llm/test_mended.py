"""Repeated rows, very long texts, odd pages and clashing names, each with what is expected written by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from returnfold.llm import langid, syncmers, url_filter, vector_search


def test_repeated_vectors_leave_room_for_others(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(60)]
    near = [x + 1e-3 for x in rows[0][1]]
    more = rows + [(100, near)] * 8 + [(0, rows[0][1])] * 3
    schema = "vec_id long, embedding array<float>"
    one, many = (sorted(map(tuple, vector_search.search(spark.createDataFrame(t, schema), spark.createDataFrame(t, schema).where("vec_id = 0")).collect())) for t in (rows + [(100, near)], more))
    assert many == one and len(many) == 5 and many[0][2] == 100
    # one id with several vectors: a candidate once, by the nearest of them
    other = rows + [(100, near), (100, [-x for x in near]), (100, [x + 2e-3 for x in rows[0][1]])]
    got = sorted(map(tuple, vector_search.search(spark.createDataFrame(other, schema), spark.createDataFrame(other, schema).where("vec_id = 0")).collect()))
    assert [r[2] for r in got] == [r[2] for r in one] and got[0][3] == pytest.approx(one[0][3])


def test_unrelated_long_texts_are_unlike():
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 123, 16 << 20, dtype=np.uint8).tobytes() for _ in range(2)]
    rows = syncmers.fingerprints(texts)
    assert syncmers.likeness(rows[:1], rows[1:])[0] < 0.02


@pytest.mark.parametrize("size", [100_000, 4 << 20])
def test_likeness_of_long_edits_is_near_the_jaccard_index_of_anchors(size):
    rng = np.random.default_rng(size)
    a, b = (rng.integers(97, 123, size, dtype=np.uint8) for _ in range(2))
    for share in (0.1, 0.5):
        edited = np.concatenate([a[: int(size * (1 - share))], b[: int(size * share)]])
        sets = [set(syncmers.closed_syncmers(x)[1].tolist()) for x in (a, edited)]
        rows = syncmers.fingerprints([a.tobytes(), edited.tobytes()])
        assert abs(syncmers.likeness(rows[:1], rows[1:])[0] - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.12


def test_prediction_keeps_a_callers_columns(spark):
    rows = [(k, t, lang, k * 10, "own", "kept") for k, (t, lang) in enumerate([("the cat and the dog and the house", "en"), ("der hund und die katze und das haus", "de")] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long, lang_pred string, _text string")
    models = langid.learn(df)
    for m in (models, None):
        got = langid.predict(df, m)
        assert sorted(got.columns) == sorted({*df.columns, "rejected"}) and got.where("_text = 'kept' and text is not null").count() == 40
        own = langid.predict(df, m, names=("a", "b", "c"))
        assert own.columns == [*df.columns, "a", "b", "c"] and own.agg(F.sum("score")).head()[0] == 7800
        assert "text" not in langid.predict(df, m, keep_text=False).columns
    assert {r["lang"]: r["lang_pred"] for r in langid.predict(df.drop("lang_pred"), models).collect()} == {"en": "en", "de": "de"}


SELF = "http://h.org/d/p"
PAGES = {
    '<link data-href="/wrong" rel="canonical" href="/right">': "http://h.org/right",
    '<link rel="canonical" data-rel="x" href=/right>': "http://h.org/right",
    '<link data-rel="canonical" rel="icon" href="/no">': None,
    '<link title="a rel=canonical" href="/no">': None,
    '<link title="a > b" rel="canonical" href="/right?x=a>b">': "http://h.org/right?x=a>b",
    '<base href="http://z.net/q/"><link rel=canonical href="y">': "http://z.net/q/y",
    '<base target="_top"><base href="/e/f"><link rel=canonical href="y">': "http://h.org/e/y",
    '<link rel=canonical href="&#x002F;k&sol;m">': "http://h.org/k/m",
    '<link rel=canonical href="http://z.net/?a&#0038;b&amp;c&num;f">': "http://z.net/?a&b&c",
    '<link rel=canonical href="/&#233;&#x1F600;&#xD800;&bogus;">': "http://h.org/é😀&",
    '<!-- <link rel="canonical" href="/no"> -->': None,
    "<script>var s = '<link rel=\"canonical\" href=\"/no\">'</script>": None,
    "<LINK\nHREF = '/right'\tREL = 'Alternate CANONICAL' />": "http://h.org/right",
    '<meta http-equiv="refresh" content="0; url=/right">': "http://h.org/right",
    """<meta content="5;URL='/right'" http-equiv=Refresh>""": "http://h.org/right",
    '<meta http-equiv="refresh" content="30">': None,
    '<meta name="refresh" content="0; url=/no">': None,
    "<linked rel=canonical href=/no>": None,
    '<link rel="canonical" href="  /right  ">': "http://h.org/right",
    '<link rel=canonical href="">': None,
}


def test_links_of_odd_pages(spark):
    rows = [(k, f"{SELF}{k}", html) for k, html in enumerate(PAGES)]
    got = {}
    for r in url_filter.page_links(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got.setdefault(r["a"], set()).add(r["b"])
    for (k, url, html), want in zip(rows, PAGES.values()):
        assert got.get(url, set()) == ({want} if want else set()), html


def test_verdicts_of_odd_pages_equal_the_sql(spark):
    import duckdb

    hosts = ["b.net", "example.net", "c.org"]
    rows = [(k, f"{SELF}{k}", html.replace("h.org", "b.net") if k % 2 else html) for k, html in enumerate(PAGES)]
    rows += [(100 + k, f"http://{h}/{p}", f'<link data-href="/x" rel="canonical" href="{SELF}{k}">') for k, (h, p) in enumerate((h, p) for h in hosts for p in ("right", "en/x", "fr/y", ""))]
    rows += [(200, None, "<link rel=canonical href=/x>"), (201, SELF + "0", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    with duckdb.connect() as db:
        db.register("pages", df.toPandas())
        assert sorted(db.sql(url_filter.ORACLE["op10_url_filter"]).fetchall()) == sorted(map(tuple, url_filter.judge(df, url_filter.RULES).collect()))


def test_a_page_of_many_quotes_is_read(spark):
    html = "<link " + " ".join(f'a{k}="v"' for k in range(20_000)) + "><link rel=canonical href='/right'>" + "<p " * 50_000
    rows = url_filter.page_links(spark.createDataFrame([(1, SELF, html)], "page_id long, url string, html string")).collect()
    assert [tuple(r) for r in rows] == [(SELF, "http://h.org/right")]


def test_queries_visit_as_many_lists_as_their_neighbours_need(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(200, 16))
    x = (centres[rng.integers(0, 200, 12_000)] + 0.3 * rng.normal(size=(12_000, 16))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    asked = rows.where("vec_id % 50 = 0")
    monkeypatch.setattr(vector_search, "MANY_LISTS", 100)
    graph = vector_search.CentroidGraph(vector_search.balanced_centroids(vector_search.unit(x), len(x) // vector_search.PER_LIST))
    probes = vector_search._calibrated(rows, asked, graph, 16, 240, 5)
    assert probes <= len(graph.centroids) // vector_search.PROBE_SHARE // 2  # a third of the lists was visited before, whatever the vectors
    got = vector_search.search(rows, asked).toPandas()
    unit = vector_search.unit(x)
    hit = 0
    for query, found in got.groupby("query_id"):
        cos = unit @ unit[query]
        cos[query] = -2
        assert found.sort_values("rank")["score"].to_numpy() == pytest.approx(np.sort(cos[found["vec_id"]])[::-1], abs=1e-12)
        hit += len(set(found["vec_id"]) & set(np.argsort(-cos)[:5]))
    assert hit / (5 * 240) >= 0.95
    for name, n in (("BLOCK_ROWS", 700), ("QUERY_ROWS", 30), ("PACKED", 300)):  # more packs, long lists in several blocks
        monkeypatch.setattr(vector_search, name, n)
    assert sorted(map(tuple, vector_search.search(rows, asked).collect())) == sorted(got.itertuples(index=False, name=None))


def test_copies_under_many_ids(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 8)).round(2)
    rows = [(i * 40 + j, x[j].tolist()) for i in range(150) for j in range(40)] + [(None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = {}
    for r in vector_search.search(df, df.where("vec_id in (0, 41, 5999)")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 12)))
    assert got == {0: [(None, 1.0), *((40 * i, 1.0) for i in range(1, 5))], 41: [(1 + 40 * i, 1.0) for i in (0, 2, 3, 4, 5)], 5999: [(39 + 40 * i, 1.0) for i in range(5)]}

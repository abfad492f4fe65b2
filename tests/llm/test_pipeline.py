"""The pipeline's stages, each on its own input."""

import random

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long, h string, rejected int"


def prose(seed, n):
    rng = random.Random(seed)
    syllables = "ba co di fu ga he ki lo mu na pe ri so tu ve wi za".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(i, 150), "xx", "s", 0, "extra", 1) for i in range(80)]
    near = prose(3, 150).split()
    near[70] = "changed"
    rows += [(100, prose(3, 150), "xx", "s", 0, None, None), (101, " ".join(near), "xx", None, None, None, None), (102, prose(777, 60) + " " + prose(5, 80) + " " + prose(778, 60), None, "s", 1, None, None)]
    rows += [(200, None, None, None, None, None, None), (201, "", "xx", "s", 0, None, None), (202, "12 34", "xx", "s", 5, None, None), rows[0]]
    return spark.createDataFrame(rows, DOC)


def test_stages_keep_columns_and_clean_documents(spark, docs):
    rows, clean = docs, set(range(80))
    for name, stage in pipeline.STAGES[:-1]:
        rows = spark.createDataFrame(stage(spark, rows, "").collect(), DOC)
        assert rows.columns == docs.columns, name
        assert clean <= {r["doc_id"] for r in rows.collect()}, name
    left = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert not {100, 101, 200, 201, 202} & set(left)
    assert prose(5, 80) not in left[102] and left[102].startswith(prose(777, 50)) and left[5] == prose(5, 150)
    assert rows.where(F.length("text") != F.col("n_chars")).count() == 0
    packed = pipeline.packing(spark, rows, "").collect()
    assert {r["doc_id"] for r in packed} == set(left)


def test_empty_documents(spark, docs):
    rows = docs.where("false")
    for name, stage in pipeline.STAGES:
        out = stage(spark, rows, "")
        assert out.count() == 0, name
        rows = out if name != pipeline.STAGES[-1][0] else rows


def test_run(spark):
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 0

"""Every query of the library against its SQL in DuckDB."""

import datetime
import math

import duckdb
import pytest
from conftest import DATA

from returnfold import queries as core

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v.date() if isinstance(v, datetime.datetime) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, duck, name):
    ours = core.Q[name](spark, SF)
    theirs = duck.execute(core.SQL[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    a, b = rows_of(ours.columns, [tuple(r) for r in ours.collect()]), rows_of(columns, theirs.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            assert p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-6 * max(1, abs(p)))


def test_entry_and_queries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_full_metrics_follow_the_layout(spark):
    from returnfold.plans.report import LAYOUT

    rows = core.Q["metrics_full"](spark, SF).where("series_id = '1-URGENT'").orderBy("ord").collect()
    assert [r["metric"] for r in rows] == [x[0] for x in LAYOUT]

"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from fieldtally.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


WITHOUT_SQL = {"g1_distance_sampling", "g2_width_cv", "g7_zinb_fit", "g8_zinb_bounds", "g5_population_zinb", "g10_one_to_one", "g11_registration", "g12_cross_modal_match", "a27_bootstrap", "w16_tracker"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def in_order(columns, rows):
    o = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in o) for r in rows)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    got = in_order(df.columns, [tuple(r) for r in df.collect()])
    text = registry.oracle_sql().get(name)
    if text is None:  # those without SQL have a check of their own in tests/test_unexpressed.py
        assert got[0] and name in WITHOUT_SQL
        return
    want = db.sql(text)
    assert got == in_order(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


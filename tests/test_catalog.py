"""Every query runs; those with SQL give what an independent engine gives on the same tables."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from loomtally.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings holdout disputes statcheck_repaired conversion_manifest eval_items mix_targets".split()


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def _value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, db, name):
    df = catalog.QUERIES[name](spark, small)
    rows = df.collect()
    if name in catalog.SQL:
        got = db.execute(catalog.SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        assert _rows(df.columns, rows) == _rows(names, got.fetchall())


def test_sql_has_queries():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_verdicts_agree_with_the_checker(spark, small):
    r = catalog.QUERIES["verdict_agreement"](spark, small).first()
    assert r["agree"] / (r["agree"] + r["disagree"]) > 0.98

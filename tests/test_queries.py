"""Every core query with SQL gives what DuckDB gives on the same tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from tonearm.plans import catalogue

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in Path(D).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, bool):
        return int(v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_is_checked():
    missing = catalogue.queries().keys() - catalogue.oracle_sql().keys()
    assert missing == {"p3_found", "p3_scripts", "p3_table"} | catalogue.WITHOUT_SQL
    assert len(catalogue.queries()) >= 90


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, sql, name):
    got = catalogue.queries()[name](spark, D)
    want = sql.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert _rows(got.columns, got.collect()) == _rows(names, want.fetchall())

"""Streams with samples beyond 16 bits through files, as SQL has them."""

import duckdb
import pytest

from tonearm.plans import catalogue

VALUES = {1: (10.5, 572.67, 0.01), 2: (572.68, 3.0), 3: (84131.09, -90.0), 4: (0.0,)}  # 16 bits hold 572.67, 24 bits 84131.07


@pytest.fixture
def loud(spark, tmp_path):
    rows = [(u * 10 + i, u, v, f'{{"k": {i * 30}}}') for u, vs in VALUES.items() for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def _same_as_sql(spark, d, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet/*.parquet'")
    want = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in catalogue.queries()[name](spark, d).select(*names).collect()) == sorted(want.fetchall())


def test_au_roundtrip(spark, loud):
    _same_as_sql(spark, loud, "au_roundtrip")


def test_wav_roundtrip(spark, loud):
    _same_as_sql(spark, loud, "wav_roundtrip")
    _same_as_sql(spark, loud, "aiff_roundtrip")  # asks for 24 bits


def test_wav_verify(spark, loud):
    _same_as_sql(spark, loud, "wav_verify")

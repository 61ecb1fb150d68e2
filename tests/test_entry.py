"""The driver's contract, with SQL run beside the queries on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from inkstone.oracles import ORACLES
from inkstone.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def _rows(rows, columns):
    def plain(v):
        return "-" if v is None or v != v else str(int(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) and v == int(v) else str(v)

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, name):
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = db.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.collect(), got.columns) == _rows(want.fetchall(), columns)

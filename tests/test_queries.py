"""Every query with an oracle gives the oracle's rows, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = {k: v for k, v in __spark_entry__.oracle_sql().items() if k.startswith("q_")}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    assert rows(__spark_entry__.queries()[name](spark, SF).toPandas()) == rows(duck.execute(ORACLES[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0

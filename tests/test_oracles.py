"""Every catalogue query against its SQL on the smallest tables."""

import duckdb
import pytest

from kilngraph.plans.catalogue import CATALOGUE
from kilngraph.plans.oracles import ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    return None if value is None or value != value else f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_query(spark, duck, name):
    frame = CATALOGUE[name](spark, SF)
    rows = frame.collect()
    if name not in ORACLES:
        assert rows
        return
    want = duck.sql(ORACLES[name])
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(map(str, (shown(r[c]) for c in columns))) for r in rows) == sorted(tuple(map(str, (shown(r[i]) for i in at))) for r in want.fetchall())

"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from weftgraph import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


def table(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name in catalog.ORACLE_SQL:
        got = duck.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        assert table(df.columns, rows) == table(names, got.fetchall())


def test_every_query_names_its_operators():
    assert all(catalog.OPERATORS[q] for q in catalog.QUERIES)

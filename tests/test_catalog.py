"""Every registered query against its DuckDB oracle."""

import math

import duckdb
import pytest

from skysift.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(str([norm(r[c]) for c in cols]) for r in df.collect())
    if name not in catalog.ORACLES:
        return
    rel = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert got or name in {"cotravel_matches", "cotravel_score", "cotravel_stream"}, "a result without rows shows nothing (these need more than the smallest tables)"
    assert got == sorted(str([norm(r[names.index(c)]) for c in cols]) for r in rel.fetchall())


def test_oracles_name_queries():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)

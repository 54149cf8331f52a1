"""Every query with SQL gives the SQL's rows on the smallest tables."""

import duckdb
import pytest

from gleaner.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "as_tuple"):
        x = float(x)
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rel = duck.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    want = sorted(repr([plain(dict(zip(rel.columns, r))[c]) for c in cols]) for r in rel.fetchall())
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == want


def test_flagship(spark):
    assert registry.flagship(spark, SF).columns == ["id", "digest", "reason", "failed", "disposition", "duplicate_of"]

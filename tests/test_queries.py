"""Every query with a DuckDB twin gives its rows, on the smallest tables."""

import duckdb
import pytest

from brindle.plans import files, registry, retrieval, tables  # noqa: F401

DIR = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in NAMES.split():
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    r = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall()) == sorted(tuple(plain(x[c]) for c in cols) for x in df.collect())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE) - {"chk_05"}))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0

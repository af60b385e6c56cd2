"""Every query with SQL gives the same rows from DuckDB; the others are checked by hand."""

import os

import pytest

from folioscope.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(table, names):
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted([tuple(plain(r[n]) for n in names) for r in table], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = duck.execute(catalog.ORACLE_SQL[name]).to_arrow_table().to_pylist() if hasattr(duck, "to_arrow_table") else duck.execute(catalog.ORACLE_SQL[name]).fetch_arrow_table().to_pylist()
    names = sorted(got.columns)
    if want:
        assert names == sorted(want[0])
    assert rows([r.asDict() for r in got.collect()], names) == rows(want, names)

import os

import pytest

from folioscope.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_hubs_of_all_of_lineitem(spark):
    out: dict[int, set[int]] = {}
    for r in spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_partkey", "l_suppkey").collect():
        out.setdefault(r.l_partkey, set()).add(r.l_suppkey)
    got = {r.src: r.out_degree for r in catalog.QUERIES["hub_modules"](spark, DATA).collect()}
    assert got == {k: len(v) for k, v in out.items() if len(v) > 2} and got

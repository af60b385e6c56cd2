import bisect
import datetime
import os
import random

import pytest

from folioscope.operators import extract
from folioscope.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_later_commits_against_every_pair(spark):
    r = random.Random(2)
    time = lambda: datetime.datetime(2024, 1, r.randint(1, 9), r.choice([0, 5, 23]), r.randint(0, 2))
    docs = [(k % 90, time()) for k in range(100)] + [(500, None), (501, datetime.datetime(2030, 1, 1)), (502, datetime.datetime(1999, 1, 1))]
    commits = [time() for _ in range(200)] + [None]
    want: dict[int, int] = {}
    for k, at in docs:
        want[k] = want.get(k, 0) + sum(c is not None and at is not None and c > at for c in commits)
    got = extract.later_than(spark.createDataFrame([(c,) for c in commits], "committed timestamp"), spark.createDataFrame(docs, "doc long, reviewed timestamp"))
    assert {r.doc: r.later for r in got.collect()} == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_all_documents_and_commits_count(spark):
    got = {r.doc: r.later for r in catalog.QUERIES["freshness"](spark, DATA).collect()}
    ts = sorted(r.ts for r in spark.read.parquet(f"{DATA}/events.parquet").select("ts").where("ts IS NOT NULL").collect())
    want = {r.o_orderkey: len(ts) - bisect.bisect_right(ts, r.o_orderdate) for r in spark.read.parquet(f"{DATA}/orders.parquet").collect()}
    assert got == want

"""Pairs of owners against plain loops."""

import random
from collections import Counter

from folioscope.operators import drift


def test_pairs_of_owners(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(30), rng.randrange(200)) for _ in range(3000)] + [(None, 1), (2, None)]
    owners = {}
    for a, i in rows:
        if a is not None and i is not None:
            owners.setdefault(i, set()).add(a)
    want = Counter((a, b) for s in owners.values() for a in s for b in s if a < b)
    found = drift.sharing_pairs(spark.createDataFrame(rows, "o int, i int"), "o", "i", held=100)
    assert {(r.a, r.b): r.shared for r in found.collect()} == want
    assert drift.sharing_pairs(spark.createDataFrame([], "o int, i int"), "o", "i").collect() == []


def test_tasks_of_pairs_grow_with_the_pairs(spark):
    df = spark.range(4000).selectExpr("id % 20 AS o", "id AS i").unionAll(spark.range(4000).selectExpr("(id + 1) % 20 AS o", "id AS i"))
    assert drift.sharing_pairs(df, "o", "i", held=250).rdd.getNumPartitions() == 16

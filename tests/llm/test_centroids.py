"""Clustering by ball trees against plain sums and distances in whole numbers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException

from folioscope.llm import centroids

KIND = "vec_id long, embedding array<float>, Cluster string"


def brute(rows, width=64, k=40, rounds=5):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'null' if i is None else i}".encode()).hexdigest()
    cs = [v for _, v in sorted((name(i), v) for i, v in kept)[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((away(v, c), z) for z, c in enumerate(cs))[::-1]
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[0], []).append(v)
        for z, vs in own.items():
            cs[z] = [sum(col) // len(vs) for col in zip(*vs)]
    got = [(i, *near(v)) for i, v in kept]
    each = {}
    for _, z, d in got:
        each[z] = each.get(z, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted([(i, z, d, each[z], sum(each.values()), sha[z]) for i, z, d in got], key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], KIND).repartition(3)


def result(df, **kw):
    return sorted((tuple(r) for r in centroids.clustered(df, **kw).collect()), key=repr)


def test_tight_and_loose_groups(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(12, 64))
    rows = [(i, (middles[i % 12] + rng.normal(scale=0.02 if i % 3 else 1.0, size=64)).tolist()) for i in range(700)]
    rows += [(900, None), (901, []), (902, [0.5] * 63), (903, [0.1] * 63 + [None]), (904, [float("nan")] + [0.0] * 63), (905, [float("inf")] * 64), (None, [0.25] * 64), (None, [0.25] * 64), (5, [-0.001] * 64)]
    assert result(table(spark, rows)) == brute(rows)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 3), float(i % 2)]) for i in range(60)]
    assert result(table(spark, rows), width=2, k=7) == brute(rows, 2, 7)
    same = [(i, [1.5, -2.5]) for i in range(50)]
    got = result(table(spark, same), width=2)
    assert got == brute(same, 2) and {r[1] for r in got} == {0}


def test_few_and_no_vectors(spark):
    few = [(1, [0.0, 1.0]), (2, [3.0, 1.0])]
    assert result(table(spark, few), width=2) == brute(few, 2)
    assert result(table(spark, [(1, None)])) == []
    assert centroids.clustered(table(spark, few).limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_large_components(spark):
    rows = [(i, [3e4 * ((i * 7) % 11), -4e4 * (i % 5)]) for i in range(80)]
    assert result(table(spark, rows), width=2, k=5) == brute(rows, 2, 5)
    with pytest.raises(PySparkException):
        result(table(spark, [(1, [1e30, 0.0])]), width=2)


def test_whole_balls_are_assigned():
    """Far groups go as balls, not vector by vector; every vector is counted once."""
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.integers(-20, 20, (500, 64)), rng.integers(-20, 20, (500, 64)) + 5000]).astype(np.int32)
    tree, order = centroids.Tree.grown(v)
    assert np.array_equal(tree.vectors, v[order]) and sorted(order) == list(range(1000))
    label, balls = centroids._labels(tree, np.array([[0] * 64, [5000] * 64]))
    assert all(z >= 0 for z, _ in balls) and len(balls) <= 20
    assert np.bincount(label).tolist() == [500, 500]

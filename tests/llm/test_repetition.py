"""Periodic runs against a brute-force search."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=24, times=3):
    """Every maximal stretch of every period, smallest period of an interval."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def runs(texts, least=24, times=3):
    number = {}
    s = np.array([number.setdefault(w, len(number)) for t in texts for w in t], np.int32)
    found = repetition.runs_of(s, np.cumsum([len(t) for t in texts]), least, times)
    return [found.get(k, []) for k in range(len(texts))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=6), st.integers(1, 12)), max_size=8), min_size=1, max_size=4))
def test_small_alphabets(parts):
    texts = [[w for block, n in own for w in block * n] for own in parts]
    assert runs(texts) == [brute(t) for t in texts]
    assert runs(texts, 6, 2) == [brute(t, 6, 2) for t in texts]


def test_long_texts():
    rng = np.random.default_rng(3)
    block = rng.integers(0, 50, 700).tolist()
    texts = [["a"] * 5000, block * 3 + block[:10], rng.integers(0, 1000, 3000).tolist(), (["a"] * 30 + block[:40]) * 9, [], ["b"] * 23, ["b"] * 24]
    assert runs(texts) == [brute(t) for t in texts]


def test_z_function():
    assert repetition.z_function([1, 1, 2, 1, 1, 2, 1]) == [0, 1, 0, 4, 1, 0, 1]
    assert repetition.z_function([]) == []


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found, keep = brute(words), [True] * n
    for s, length, q in found:
        for i in range(s + q, s + length):
            keep[i] = False
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, None if not found else 1000 * best[1] // best[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(w for w, k in zip(words, keep) if k)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_on_planted_texts(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " \t".join(f"w{x}" for x in rng.integers(0, 400, rng.integers(0, 300)))) for i in range(120)]
    rows += [(None, None), (200, None), (201, ""), (202, " \n "), (203, "é\x1cb " * 40), (203, "é\x1cb " * 40), (204, " lead " + "x y " * 5000), (205, "one")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, Runs string").repartition(3)
    out = repetition.summarised(repetition.repetitions(repetition.with_planted(df)))
    assert out.columns == COLUMNS
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) >= 8


def test_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a " * 30, 5, "kept")], "id long, text string, N_Words int, other string")
    out = repetition.repetitions(df)
    assert out.columns == ["id", "other", "n_words", "runs", "collapsed"]
    row = out.first()
    assert (row.n_words, [tuple(r) for r in row.runs], row.collapsed, row.other) == (30, [(0, 30, 1)], "a", "kept")
    assert repetition.summarised(repetition.repetitions(df.limit(0).withColumnRenamed("id", "doc_id"))).count() == 0
    with pytest.raises(ValueError):
        repetition.repetitions(df, times=1)

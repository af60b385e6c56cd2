import random
import re

import numpy as np
import pytest

from folioscope.llm import ngram_join


def brute(rows, k=4, percent=85):
    sets = []
    for _, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def some_rows(seed, n=160):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(60)] + ["É", "ß", "THE", "the", " x"]
    bases = [[r.choice(vocabulary) for _ in range(r.choice([1, 3, 4, 5, 30, 90]))] for _ in range(14)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "a b"), (4, "A  b"), (5, "long " * 5000)]
    while len(rows) < n:
        words = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((len(rows), r.choice([" ", "\n", "\x0b"]).join(words)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, limits", [(1, ngram_join.Limits()), (2, ngram_join.Limits(block_bytes=2000, block_docs=7))])
def test_matches_brute_force(spark, seed, limits):
    rows = some_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.joined(df, limits=limits).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_long_columns_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = some_rows(4, 120)
        got = ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_null_ids_clashing_columns_and_repeated_rows(spark):
    same = " ".join(f"x{i}" for i in range(20))
    rows = [(None, same, 1), (7, same, 2), (7, same, 2), (None, None, 3), (8, "", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = ngram_join.joined(df).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 7), (7, 7), (7, 7), (None, None), (8, 8)], key=str)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == ["doc_id", "text", "n"]
    assert sorted((r.doc_id or 0, r.n) for r in kept.collect()) == [(0, 3), (7, 2), (8, 4)]


def test_empty_table(spark):
    assert ngram_join.joined(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_overlaps_of_random_sets():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 400, r.integers(1, 300)).astype(np.uint64)) for _ in range(90)]
    want = [[0 if i == j else len(np.intersect1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert (ngram_join.overlaps(sets, chunk_cells=900) == np.array(want)).all()


def test_a_late_first_column_holds_nothing_together(spark, tmp_path):
    own = lambda cid, n, m, place: (n, cid, [1 if i == place else 1000 * cid + i for i in range(m)])
    clusters = lambda rows, name: sorted(r.cid for r in ngram_join._clusters(spark.createDataFrame(rows, "n long, cid long, lead array<long>"), 85, f"file://{tmp_path}/{name}").collect())
    assert clusters([own(2, 101, 16, 10), own(3, 86, 13, 10)], "late") == []
    assert clusters([own(2, 101, 16, 13), own(3, 86, 13, 0)], "early") == [2, 3]
    assert clusters([own(c, 100, 16, 15) for c in range(2, 60)], "late-long") == []
    assert clusters([own(c, 100, 16, 0) for c in range(2, 60)], "early-long") == list(range(2, 60))


@pytest.mark.parametrize("seed, few", [(5, 2), (6, 4), (7, 32)])
def test_texts_of_graded_lengths(spark, monkeypatch, seed, few):
    monkeypatch.setattr(ngram_join, "FEW", few)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        r = random.Random(seed)
        base = [f"v{r.randrange(400)}" for _ in range(140)]
        rows = []
        for doc_id in range(150):
            words = base[r.randrange(20) : 140 - r.randrange(20)]
            for _ in range(r.choice([0, 1, 2, 3])):
                words[r.randrange(len(words))] = r.choice(base)
            rows.append((doc_id, " ".join(words)))
        got = ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id", "n_links").collect()
        assert sorted(tuple(x)[:3] for x in got) == brute(rows)
        low = {d: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} for d, w in ((d, t.split()) for d, t in rows)}
        sets = set(map(frozenset, low.values()))
        links = {s: sum(s != o and 100 * len(s & o) >= 85 * len(s | o) for o in sets) for s in sets}
        assert {x.doc_id: x.n_links for x in got} == {d: links[frozenset(s)] for d, s in low.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

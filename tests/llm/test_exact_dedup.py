import hashlib
import re

import pytest
from pyspark.sql import functions as F

from folioscope.llm import exact_dedup


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), n in zip(rows, norm):
        groups.setdefault(n, []).append(i)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    return sorted(((i, least(groups[n]), len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for (i, _), n in zip(rows, norm)), key=repr)


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (2, None), (1, ""), (7, "é" * 50_000), (8, "é" * 50_000), (None, "a b"), (4, "x"), (4, "x"), (None, "only"), (6, "a\x0b\x0cb"), (11, "a\x1cb")]


def got(frame):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in frame.collect()), key=repr)


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "doc_id long, text string, keep_id string").repartition(3)
    out = exact_dedup.exact_groups(df)
    assert got(out) == brute(ROWS)
    kept = exact_dedup.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1 for r in kept.collect())) == [-1, 1, 3, 4, 7, 9, 11]


def test_one_row_of_each_group_is_kept(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    groups = exact_dedup.exact_groups(df).groupBy("text_sha256").agg(F.count_if("kept").alias("n")).collect()
    assert all(g.n == 1 for g in groups)


def test_colliding_digests_are_told_apart_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_digest", lambda text: F.unhex(F.lpad(F.hex(F.length(text) % 2), 4, "0")))
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(2)
    assert [x[:3] for x in got(exact_dedup.exact_groups(df))] == [x[:3] for x in brute(ROWS)]


def test_large_groups_are_checked_in_copies(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MEMBERS_A_COPY", 2)
    rows = [(i, "same") for i in range(30)] + [(50, "other")]
    assert got(exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_empty_table(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("text", ["", " ", "\x0b"])
def test_single_rows(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert got(exact_dedup.exact_groups(df)) == brute([(1, text)])

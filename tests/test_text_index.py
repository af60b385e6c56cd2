"""Many patterns in many texts, and what is built on that, against plain search."""

import re

import pytest

from folioscope.operators import text_index
from plan_rows import most_rows

TEXTS = [(1, "see src/routes/users.ts here"), (2, "the users.ts file, `users` and é.md"), (3, "no users"), (4, None), (5, ""), (6, "`users`"), (6, "xsrc/routes/users.tsx"), (7, "a" * 3000 + "needle"), (8, "NEEDLE é")]
PATTERNS = ["src/routes/users.ts", "users.ts", "`users`", "needle", "é", "aaaaaaa", "zzzzzzzz", "users.ts", "", None, "us"]


@pytest.mark.parametrize("most", [100, 3])
def test_patterns_in_texts(spark, most):
    texts = spark.createDataFrame(TEXTS, "id int, text string").repartition(3)
    got = text_index.found_in(texts, ["id"], "text", spark.createDataFrame([(p,) for p in PATTERNS], "pattern string"), most=most).collect()
    assert len(got) == len(set(got))
    assert {(r.id, r.pattern) for r in got} == {(i, p) for i, x in TEXTS for p in PATTERNS if x and p and p in x}


def test_no_patterns_and_no_texts(spark):
    texts = spark.createDataFrame(TEXTS, "id int, text string")
    none = spark.createDataFrame([(None,), ("",)], "pattern string")
    assert text_index.found_in(texts, ["id"], "text", none).collect() == []
    some = spark.createDataFrame([("users.ts",)], "pattern string")
    assert text_index.found_in(texts.limit(0), ["id"], "text", some).collect() == []


FILES = ["./src/routes/users.ts", "src/lib/users.js", "é.md", "Makefile", None, "src/gone.py"]


def kind_of(file, line):
    path = re.sub(r"^\./", "", file)
    base = path.rsplit("/", 1)[-1]
    return "path" if path in line else "basename" if base in line else "module" if f"`{re.sub(r'[.][^.]+$', '', base)}`" in line else None


@pytest.mark.parametrize("most", [100, 2])
def test_references_impact_and_orphans(spark, most):
    lines = [(d, n, x) for d, n, x in [("A.md", 1, "See `src/routes/users.ts` for routes."), ("A.md", 2, "users.ts and `users`"), ("B.md", 1, "`users` alone"), ("B.md", 2, "read é.md"), ("AGENTS.md", 1, "src/routes/users.ts: never bypass"), ("C.md", 1, None)]]
    files = spark.createDataFrame([(f,) for f in FILES], "file string")
    found = text_index.references(files, spark.createDataFrame(lines, "doc string, line int, content string"), ["doc", "line"], "content", most=most)
    want = {(f, d, n, kind_of(f, x)) for f in FILES if f for d, n, x in lines if x and kind_of(f, x)}
    assert sorted((r.file, r.doc, r.line, r.kind) for r in found.collect()) == sorted(want)
    agents = spark.createDataFrame([("AGENTS.md",), ("AGENTS.md",)], "doc string")
    got = {r.doc: (r.n_files, r.is_agent_file) for r in text_index.impact(found, "doc", agents).collect()}
    assert got == {"A.md": (2, False), "B.md": (3, False), "AGENTS.md": (1, True)}
    assert sorted(r.file or "" for r in text_index.orphans(files, found).collect()) == ["", "Makefile", "src/gone.py"]


def test_blast_radius(spark):
    docs = [("docs/ARCHITECTURE.md", "# Architecture"), ("SECURITY.md", "See ARCHITECTURE.md for the map"), ("AGENTS.md", "[[SECURITY#Keys]] and [[SECURITYX]]"), ("X.md", "[[ARCHITECTURE|map]]"), ("Y.md", "[[ARCHITECTURE]] ARCHITECTURE.md"), ("Z.md", None)]
    df = spark.createDataFrame(docs, "doc string, text string")
    changed = spark.createDataFrame([("docs/ARCHITECTURE.md",), ("SECURITY.md",), ("SECURITY.md",), ("Z.md",)], "doc string")
    got = sorted((r.changed, r.doc) for r in text_index.mentions(df, "doc", "text", changed).collect())
    assert got == [("SECURITY.md", "AGENTS.md"), ("docs/ARCHITECTURE.md", "SECURITY.md"), ("docs/ARCHITECTURE.md", "X.md"), ("docs/ARCHITECTURE.md", "Y.md")]


def test_grams_of_no_pattern_are_not_shuffled(spark):
    texts = spark.createDataFrame([(k, "".join(chr(97 + (k * 7919 + i * i * 31 + i // 7) % 26) for i in range(500)) + f" needle{k % 9}") for k in range(200)], "id int, text string")
    patterns = spark.createDataFrame([(f"needle{k}",) for k in range(9)], "pattern string")
    found = text_index.found_in(texts, ["id"], "text", patterns, most=2)
    assert sorted((r.id, r.pattern) for r in found.collect()) == [(k, f"needle{k % 9}") for k in range(200)]
    assert most_rows(found, "shuffleRecordsWritten") < 5_000


def test_words_and_patterns_across_them(spark):
    texts = [(1, 'see <a href="docs/é b">docs/x</a>'), (2, "adocs/xb\tc\n" + "y" * 100), (3, "x\u00a0z 😀😀w"), (4, None)]
    patterns = ["docs/x", "é b", "b", "/a>", "y" * 70, "y" * 101, '"docs', "\tc", "x\u00a0z", "😀w", "s/xb c"]
    df, wanted = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")
    for most in (100, 1):
        got = [(r.id, r.pattern) for r in text_index.found_in(df, ["id"], "text", wanted, most=most).collect()]
        assert sorted(got) == sorted((i, p) for i, x in texts for p in patterns if x and p in x)
    left = text_index.unnamed(wanted, df, "pattern", "text")
    assert sorted(r.pattern for r in left.collect()) == sorted(["y" * 101, "s/xb c"])


def test_grams_are_of_different_words_alone(spark, monkeypatch):
    """Texts aren't cut into grams where their words are few."""
    seen = []
    plain = text_index._by_grams
    monkeypatch.setattr(text_index, "_by_grams", lambda named, ids, p, most: seen.append((named, p)) or plain(named, ids, p, most))
    texts = spark.createDataFrame([(k, f"one two three word{k % 5} " * 50) for k in range(100)], "id int, text string")
    found = text_index.found_in(texts, ["id"], "text", spark.createDataFrame([("word3",), ("hre",)], "pattern string"))
    assert found.count() == 120
    assert [named.count() for named, p in seen if not p.isEmpty()] == [8]

"""Pairs of rules, and values as of a time, against plain loops."""

import datetime as dt
import itertools
import random
import re

import pytest

from folioscope.operators import conflicts, validity
from folioscope.operators.rules import NEGATIONS, POLARITY


def plain_stem(w):
    s = w
    if len(s) > 5 and s.endswith("ing"):
        s = s[:-3]
    elif len(s) > 4 and s.endswith(("ed", "es")):
        s = s[:-2]
    elif len(s) > 3 and s.endswith("s"):
        s = s[:-1]
    return s[:-1] if len(s) > 3 and s[-1] == s[-2] else s


def brute(rules, most):
    norm = lambda x: re.sub(r"[ \t\r\n\f]+", " ", re.sub(r"[^a-z0-9 \t\r\n\f]", " ", re.sub("['’]", "", x.lower()))).strip()
    rows = []
    for f, line, place, rule in sorted(rules):
        n = norm(rule)
        said = [w for w in n.split(" ") if len(w) >= 3 and w not in conflicts.TOPIC_STOP_WORDS and not w.isdigit()]
        rows.append((f, line, place, n, re.sub(" +", " ", re.sub(POLARITY, " ", n)).strip(), len(re.findall(NEGATIONS, n)) % 2, list(dict.fromkeys(map(plain_stem, said)))))
    pairs = []
    for a, b in itertools.combinations(rows, 2):
        shared = [s for s in a[6] if s in b[6]]
        if a[3] != b[3] and not (a[4] == b[4] and a[5] != b[5]) and len(shared) >= 2:
            pairs.append((a[0] != b[0], shared, a, b))
    pairs.sort(key=lambda p: (not p[0], -len(p[1]), p[2][1], p[3][1]))
    return [(k + 1, *p[2][:3], *p[3][:3], ",".join(p[1]), p[0]) for k, p in enumerate(pairs[:most])]


WORDS = "use tabs spaces running commits committed files testing tests rebase branches never always indentation release 42 the not".split()


@pytest.mark.parametrize("most, seed", [(40, 1), (5, 2), (400, 3)])
def test_candidates(spark, most, seed):
    rng = random.Random(seed)
    rules = [(f"f{rng.randrange(5)}", k, 0, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 9)))) for k in range(60)]
    rules += [("f1", 100 + k, 0, "Always run tests before committing files.") for k in range(8)] + [("f2", 7, 1, "Never run tests before committing files.")]
    df = spark.createDataFrame(rules, "file string, line int, place int, rule string").repartition(3)
    got = [tuple(r) for r in conflicts.candidates(df, most).orderBy("rank").collect()]
    assert got == brute(rules, most)


@pytest.mark.parametrize("first_work", [1, 1_000_000])
def test_copies_of_rules_are_one_set(spark, monkeypatch, first_work):
    monkeypatch.setattr(conflicts, "FIRST_WORK", first_work)
    rng = random.Random(7)
    texts = ["Always run slow tests before committing many files here", "Never run slow tests before committing big files there", "Use tabs and spaces running slow tests"]
    rules = [(f"f{k % 50:02}", rng.randrange(1, 4), k, rng.choice(texts)) for k in range(300)]
    df = spark.createDataFrame(rules, "file string, line int, place int, rule string").repartition(3)
    for most in (7, 40):
        assert [tuple(r) for r in conflicts.candidates(df, most).orderBy("rank").collect()] == brute(rules, most)


def test_sets_that_meet_do_not_grow_with_copies(spark, monkeypatch):
    met = []
    plain = conflicts._work
    monkeypatch.setattr(conflicts, "_work", lambda sets, *same: met.append(plain(sets, *same)) or met[-1])
    rules = [(f"f{k}", 1, 0, f"Never run slow tests before committing files number{k % 3}x") for k in range(600)]
    conflicts.candidates(spark.createDataFrame(rules, "file string, line int, place int, rule string"), 5).collect()
    assert max(met[0].values()) < 100


def test_few_rules(spark):
    df = spark.createDataFrame([("a", 1, 0, "Never use tabs for indentation."), ("b", 1, 0, "Always use tabs for indentation.")], "file string, line int, place int, rule string")
    assert conflicts.candidates(df).collect() == []  # a plain contradiction
    assert conflicts.candidates(df.limit(0)).collect() == []


def test_as_of(spark):
    rng = random.Random(4)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(240))
    changes = [(rng.choice(["hot", "hot", "hot", "b", "c"]), at(), rng.random() < 0.5) for _ in range(300)] + [(None, at(), True), ("b", None, True)]
    asked = [(k, rng.choice(["hot", "b", "c", "none", None]), at() if k % 9 else None) for k in range(200)] + [(0, "hot", dt.datetime(2025, 1, 1)), (0, "hot", dt.datetime(2020, 1, 1))]
    df = spark.createDataFrame(asked, "doc int, symbol string, at timestamp")
    log = spark.createDataFrame(changes, "symbol string, at timestamp, present boolean")

    def want(symbol, when):
        before = [(a, v) for s, a, v in changes if s is not None and s == symbol and a is not None and when is not None and a <= when]
        return max(before)[1] if before else None

    got = sorted(map(repr, ((r.doc, r.symbol, r.at, r.present) for r in validity.as_of(df, log, "symbol", "at", "present").collect())))
    assert got == sorted(map(repr, ((d, s, a, want(s, a)) for d, s, a in asked)))
    refs = [(d, s, a, d % 3) for d, s, a in asked]
    head = {s: max((a, v) for t, a, v in changes if t == s and a is not None)[1] for s in ("hot", "b", "c")}
    gone = {(d, s) for d, s, a, place in refs if place < 2 and a is not None and head.get(s) is False and want(s, a)}
    found = validity.dangling(spark.createDataFrame(refs, "doc int, symbol string, at timestamp, place int"), log, most=2)
    assert sorted(found.distinct().collect()) == sorted(gone)


def test_code_names_and_records(spark):
    text = "`getUser()` and `user_id`, `Word` `word` `--flag_x` `HTTPServer.` `OrderLine` `getUser` `a_b`"
    row = spark.createDataFrame([(text,), (None,)], "t string").select(validity.code_names("t").alias("n")).collect()
    assert [r.n for r in row] == [["getUser", "user_id", "OrderLine"], []]
    code = [("a.py", 1, "x = 1  # see ADR-12 and ADR 7"), ("a.py", 2, 'y = "ADR-99"'), ("b.js", 1, "// ADR-012"), ("b.js", 2, "call('ADR-5') /* ADR5 */"), ("c.js", 1, "-- ADR-1, xADR-3")]
    cited = validity.cited_records(spark.createDataFrame(code, "file string, line int, content string"), "file")
    assert sorted(tuple(r) for r in cited.collect()) == [("a.py", 1, 7), ("a.py", 1, 12), ("b.js", 1, 12), ("b.js", 2, 5), ("c.js", 1, 1)]
    defined = spark.createDataFrame([(12,), (1,)], "number int")
    assert sorted(tuple(r) for r in validity.undefined_records(cited, defined, "file").collect()) == [(5, "b.js", 2, 1), (7, "a.py", 1, 1)]

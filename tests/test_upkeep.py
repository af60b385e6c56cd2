"""Upkeep operators against plain loops and cases counted by hand."""

import datetime as dt
import random

from folioscope.operators import upkeep
from plan_rows import most_rows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_untracked_todos(spark):
    notes = ["fix it", "Rework the whole of the parser before the next release comes", "a note of twenty-one c", "", None, "é short"]
    todos = [(f"src/f{k}.py", n, "TODO", x) for n in (1, 2) for k, x in enumerate(notes)] + [("src/f9.py", 1, "TODO", "Fix It")]
    docs = [("R", "FIX IT in src/f0.py, src/f3.py and src/f5.py"), ("S", "rework the whole of the parser before the next one"), ("T", "fix it; A NOTE OF TWENTY-ONE C"), ("U", None), ("V", "src/f2.py:1"), ("W", "É SHORT src/f5.py")]

    def tracked(path, note):
        low = (note or "").lower().strip()
        sought = low[:40] if len(low) > 20 else low
        return any(sought in d.lower() and (path in d or len(low) > 30) for _, d in docs if d is not None)

    t = spark.createDataFrame(todos, "path string, line int, kind string, note string").repartition(3)
    d = spark.createDataFrame(docs, "doc string, content string")
    assert rows(upkeep.untracked_todos(t, d, "doc", "content")) == sorted((x for x in todos if not tracked(x[0], x[3])), key=repr)
    assert upkeep.untracked_todos(t, d.limit(0), "doc", "content").count() == len(todos)
    assert upkeep.untracked_todos(t.limit(0), d, "doc", "content").count() == 0


def test_unlogged_drift(spark):
    c = spark.createDataFrame([("a.py", 1, "x"), ("a.py", 2, "y"), ("b.py", 1, "z")], "path string, line int, comment string")
    log = spark.createDataFrame([("| lib/a.py | agreed |",), (None,)], "entry string")
    assert rows(upkeep.unlogged_drift(c, log, "entry")) == [("b.py", 1, "z")]
    assert upkeep.unlogged_drift(c, log.limit(0), "entry").count() == 3


def test_marks(spark):
    files = spark.createDataFrame([("a.py", "# @doc docs/A.md\n/* @doc A.md"), ("b.md", "# @doc A.md"), ("c.go", "x" * 4090 + "// @doc B.md"), ("d.ts", None)], "path string, content string")
    assert rows(upkeep.doc_annotations(files, "path", "content")) == [("A.md", "a.py")]
    docs = spark.createDataFrame([("B.md", "<!-- folioscope:validator test-Spec n/a — none here --> <!-- folioscope:validator nope n/a -->"), ("A.md", "<!-- FOLIOSCOPE:validator TEST_SPEC N/A -->\n<!-- folioscope:validator security na -->"), ("C.md", None)], "doc string, content string")
    keys = spark.createDataFrame([("testSpec",), ("security",)], "key string")
    assert rows(upkeep.na_markers(docs, "doc", "content", keys)) == sorted([("A.md", "TEST_SPEC", "testSpec", ""), ("B.md", "nope", None, "")], key=repr)
    over = spark.createDataFrame([("A.md", "<!-- folioscope:quality passive OFF --> <!-- folioscope:quality passive 3 -->"), ("B.md", "<!-- folioscope:quality load .25 because -->"), ("C.md", None)], "doc string, content string")
    assert rows(upkeep.quality_overrides(over, "doc", "content")) == [("A.md", "passive", True, None), ("B.md", "load", False, 0.25)]


def test_resolved_imports(spark):
    edges = spark.createDataFrame([("ui/a.js", "./b"), ("ui/a.js", "../db/c"), ("ui/a.js", "./b.js"), ("ui/a.js", "./gone"), ("ui/a.js", "react"), ("a.js", "./ui"), ("ui/a.js", "./b")], "src string, target string")
    files = spark.createDataFrame([(p,) for p in ("ui/b.js", "ui/b.tsx", "db/c", "db/c/index.ts", "ui/index.cjs", "ui/index.jsx")], "path string")
    assert rows(upkeep.resolved_imports(edges, files)) == sorted([("ui/a.js", "./b", "ui/b.tsx"), ("ui/a.js", "../db/c", "db/c"), ("ui/a.js", "./b.js", "ui/b.js"), ("ui/a.js", "./gone", None), ("a.js", "./ui", "ui/index.jsx")], key=repr)


def test_stale_documents(spark):
    rng = random.Random(8)
    at = lambda: dt.datetime(2024, 3, 1) + dt.timedelta(minutes=rng.randrange(60 * 24 * 60))
    commits = [at() for _ in range(40)] + [None]
    docs = [(k, at().date() if k % 3 == 0 else None, at() if k % 3 != 1 else None, "approved" if k % 4 == 0 else None) for k in range(60)]
    now, want = max(c for c in commits if c), []
    for doc, reviewed, committed, status in docs:
        date = dt.datetime.combine(reviewed, dt.time()) if reviewed else committed
        since = date + dt.timedelta(days=1, seconds=-1) if reviewed else date
        later = sum(c > since for c in commits if c) if date else 0
        behind = (now - date) // dt.timedelta(days=1) if date else None
        code = (None if status == "approved" else "FRS001") if date is None else "FRS002" if later >= 10 else "FRS003" if behind > 30 else None
        want += [(doc, code, later, behind)] if code else []
    d = spark.createDataFrame(docs, "doc int, reviewed date, committed timestamp, status string")
    c = spark.createDataFrame([(x,) for x in commits], "committed timestamp")
    assert rows(upkeep.stale_documents(d, c)) == sorted(want, key=repr)
    assert {r[1] for r in rows(upkeep.stale_documents(d, c, 1000, 3))} >= {"FRS001", "FRS003"}
    assert upkeep.stale_documents(d, c.where("committed IS NOT NULL").limit(2)).count() == 0


def test_a_text_in_many_notes_and_documents_is_no_pair_of_each(spark):
    todos = [(f"src/e{k}.js", 1, "FIXME", "later") for k in range(300)]
    docs = [(f"D{k}", f"Roadmap: Later, src/e{k * 2}.js") for k in range(300)]
    found = upkeep.untracked_todos(spark.createDataFrame(todos, "path string, line int, kind string, note string"), spark.createDataFrame(docs, "doc string, content string"), "doc", "content")
    assert sorted(r.path for r in found.collect()) == sorted(f"src/e{k}.js" for k in range(1, 300, 2))
    assert most_rows(found) < 20_000

"""Queries over derived tables also give what SQL gives over rows that cases were picked on by hand."""

import importlib

import pytest
from literals import LITERALS

from folioscope.plans import catalog

duckdb = pytest.importorskip("duckdb")
MODULES = {name: importlib.import_module(f"folioscope.plans.{name}") for name, _ in LITERALS}
TABLES = {getattr(MODULES[module], name): rows for (module, name), rows in LITERALS.items() if hasattr(MODULES[module], name)}
NAMES = sorted(n for m in MODULES.values() for n, sql in m.ORACLE_SQL.items() if any(t.cte() in sql for t in TABLES))


def literal(sql):
    for table, rows in TABLES.items():
        sql = sql.replace(table.cte(), rows.cte())
    return sql


def plain(rows, names):
    return sorted([tuple(round(r[n], 9) if isinstance(r[n], float) else r[n] for n in names) for r in rows], key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, on_literals, name):
    got = catalog.QUERIES[name](spark, "none")
    want = duckdb.connect().execute(literal(catalog.ORACLE_SQL[name])).to_arrow_table().to_pylist()
    names = sorted(got.columns)
    assert want and names == sorted(want[0])
    assert plain([r.asDict() for r in got.collect()], names) == plain(want, names)


def test_annotations(spark, on_literals):
    got = [(r.path, r.line, r.kind) for r in catalog.QUERIES["todo_extract"](spark, "none").collect()]
    assert sorted(got) == [("a.js", 2, "TODO"), ("a.js", 3, "FIXME"), ("b.py", 3, "HACK")]


def test_skipped_tests(spark, on_literals):
    got = sorted((r.path[0], r.line, r.has_reason) for r in catalog.QUERIES["skipped_tests_window"](spark, "none").collect())
    assert got == [("a", 2, False), ("b", 4, True), ("b", 8, False), ("c", 4, True), ("c", 5, False), ("c", 8, False), ("d", 4, False)]


def test_activities(spark, on_literals):
    got = [(r.path, r.first_seq, r.activity) for r in catalog.QUERIES["diff_activities"](spark, "none").collect()]
    assert sorted(got) == [("x.py", 6, "replace"), ("x.py", 9, "delete"), ("x.py", 12, "add"), ("x.py", 13, "delete"), ("y.py", 17, "add")]


def test_suspect_documents(spark, on_literals):
    got = [(r.doc, r.place, r.path, r.kind, r.shared) for r in catalog.QUERIES["diff_suspicion"](spark, "none").collect()]
    assert sorted(got) == [("FEW.md", 1, "src/pay.ts", "path", 2), ("LEDGER.md", 1, "lib/b.js", "module", 2), ("PAY.md", 1, "src/pay.ts", "path", 5)]

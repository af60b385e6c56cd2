"""Markdown, rules, runs and trees against what the cases should give."""

from folioscope.operators import guard, markdown, rules, scan, suspicion
from folioscope.plans import catalog
from plan_rows import most_rows


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_broken_links_and_suggested_anchors(spark, on_literals):
    got = rows(catalog.QUERIES["link_findings"](spark, ""), "path", "line", "code", "wanted", "suggestion", "fixable")
    assert ("README.md", 3, "XRF002", "quik-start", "quick-start", True) in got
    assert ("README.md", 8, "XRF001", "docs/gone.md", None, False) in got
    assert ("README.md", 9, "XRF001", "Nowhere", None, False) in got
    assert ("README.md", 9, "XRF002", "instal", "install", False) in got  # wikilinks are never fixed
    assert not [r for r in got if r[3] in ("quick-start", "install", "results--academic-credit", "x", "gone.md")]


def test_wikilinks_count_only_where_one_leads_somewhere(spark):
    docs = spark.createDataFrame([("a.md", "[[one]] [[two]]")], "path string, content string")
    files = spark.createDataFrame([("b.md",)], "path string")
    assert markdown.link_findings(docs, files).count() == 0
    assert rows(markdown.link_findings(docs, spark.createDataFrame([("x/ONE.md",)], "path string")), "code", "wanted") == [("XRF001", "two")]


def test_units_of_the_reference_cases(spark):
    words = " ".join(["word"] * 320)
    docs = spark.createDataFrame([("a", "## getUser(id)\n"), ("b", "## getUser(id)\nReads a user by id and returns it whole.\n"), ("c", f"## getUser(id)\n{words}\n"), ("d", "## Unit Tests (vitest)\n"), ("e", None)], "doc string, content string")
    assert rows(markdown.unit_smells(markdown.units(docs, "doc", "content")), "doc", "code") == [("a", "APS002"), ("c", "APS001")]


def test_contradictions_hold_all_pairs(spark):
    text = "- Always use tabs here\n- Never use tabs here\n- Do not use tabs here\n- never\n- Tests must always pass"
    found = rules.instruction_rules(spark.createDataFrame([("A", text)], "f string, t string"), "f", "t")
    assert rows(rules.contradictions(found, ["f", "line"], "rule"), "line", "odd") == [(1, False), (2, True), (3, True)]


def test_empty_tables(spark):
    docs, files = spark.createDataFrame([], "path string, content string"), spark.createDataFrame([], "path string")
    for df in (markdown.headings(docs, "path", "content"), markdown.link_findings(docs, files), markdown.units(docs, "path", "content"), rules.instruction_rules(docs, "path", "content"), guard.secret_findings(docs, "path", "content"), suspicion.diff_files(docs, "path", "content")):
        assert df.count() == 0


def test_an_empty_run_passes_nothing(spark, on_literals):
    q = catalog.QUERIES["guard_run"](spark, "").where("place < 0")
    assert [r.asDict() for r in guard.outcome(q).select("total", "status").collect()] == [{"total": 0, "status": "PASS"}]


def test_tree_is_read_without_what_is_ignored(spark, tmp_path):
    for path, text in (("a.py", "x"), ("src/b.js", "y"), ("node_modules/m/i.js", "z"), (".env", "k"), ("src/b.min.js", "m")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = rows(scan.read_tree(spark, str(tmp_path)), "path", "n_bytes")
    assert got == [("a.py", 1), ("src/b.js", 1), ("src/b.min.js", 1)]
    assert {r.path: r.content for r in scan.read_tree(spark, f"file://{tmp_path}").collect()} == {"a.py": "x", "src/b.js": "y", "src/b.min.js": None}


def test_junit_is_xml_with_every_validator(spark, on_literals):
    import xml.etree.ElementTree as ET

    suite = ET.fromstring(catalog.QUERIES["junit_report"](spark, "").first().junit.encode()).find("testsuite")
    assert {k: suite.get(k) for k in ("tests", "failures", "errors", "skipped")} == {"tests": "10", "failures": "2", "errors": "1", "skipped": "3"}
    kind = {c.get("name"): [x.tag for x in c] for c in suite}
    assert kind["security"] == ["failure"] and kind["broken"] == ["error"] and kind["todo"] == ["system-out"] and kind["off"] == ["skipped"] and kind["clean"] == []
    assert suite.get("name").endswith("a <project>")


def test_nothing_found_is_no_drift(spark):
    from folioscope.operators import drift

    some, none = spark.createDataFrame([("GET", "/a")], "method string, path string"), spark.createDataFrame([], "method string, path string")
    assert drift.api_drift(some, none, True).count() == drift.api_drift(none, some, True).count() == 0


def test_suspects_are_compared_with_the_files_they_name(spark):
    lines = [(f"src/u{k}.py", 1, k, "delete", "charge_card refund_window") for k in range(300)] + [("./src/deep.py", 1, 5, "delete", "ledger settle ledger"), ("notes.md", 1, 1, "delete", "charge_card refund_window")]
    docs = [(f"D{k}", f"charge_card and refund_window of src/u{k}.py") for k in range(0, 300, 3)]
    docs += [("E", "ledger\nsettle in `deep`"), ("F", "settle in src/deep.py"), ("G", "ledger, settle, src/deep.py"), ("H", "charge_card and refund_window alone"), ("I", None)]
    lines, docs = spark.createDataFrame(lines, "path string, hunk long, seq long, op string, text string"), spark.createDataFrame(docs, "doc string, content string")
    found = suspicion.suspects(docs, lines, "doc", "content")
    got = {(r.doc, r.place, r.path, r.kind) for r in found.collect()}
    assert got == {(f"D{k}", 1, f"src/u{k}.py", "path") for k in range(0, 300, 3)} | {("E", 1, "./src/deep.py", "module"), ("G", 1, "./src/deep.py", "path")}
    assert most_rows(found) < 20_000

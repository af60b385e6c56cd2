"""Globs, JSON, sections, edits, caps and digests against plain loops."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.operators import edits, globs, ordered, sections, variants


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


GLOBS = ["src/*.test.ts", "*.spec.js", "a.test.py", "e2e/**", "*", "x?y*.ts", "docs/[a].md", "src/a.test.ts", "", None, " pad.ts ", "src/a.test.ts", "lib/*/deep/*.ts"]
PATHS = ["src/a.test.ts", "src/b/c.test.ts", "lib/a.test.py", "z.spec.js", "e2e/a/b", "docs/[a].md", "docs/a.md", "lib/x/deep/y.ts", "xy1.ts", "q/pad.ts", None, "src/a.test.ts"]


def fits(glob, path):
    g = glob.strip()
    rx = "^" + re.sub(r"\*+", ".*", re.sub(r"[.+?^${}()|\[\]\\]", r"\\\g<0>", g)) + "$"
    return bool(g) and bool(re.search(rx, path if "/" in g else path.rsplit("/", 1)[-1]))


def test_globs(spark):
    g, p = spark.createDataFrame([(x,) for x in GLOBS], "glob string"), spark.createDataFrame([(x,) for x in PATHS], "path string")
    want = {(a, b) for a in GLOBS if a for b in PATHS if b and fits(a, b)}
    assert rows(globs.matches(g, p)) == sorted(want, key=repr)
    only = {(a, "documented_only") for a in GLOBS if a is not None and a not in {x for x, _ in want}} | {(b, "actual_only") for b in PATHS if b and b not in {x for _, x in want}}
    assert rows(globs.compared(g, p)) == sorted(only, key=repr)
    assert rows(globs.compared(g.where("glob = 'a.test.py'"), p.limit(0))) == [("a.test.py", "documented_only")]
    wanted = spark.createDataFrame([("A.md", "src/*"), ("A.md", "*.ts"), ("B.md", "none/*"), ("C.md", "nil")], "doc string, glob string")
    assert rows(globs.traced(wanted, p, spark.createDataFrame([("C.md",)], "doc string"))) == [("A.md", 5, True), ("B.md", 0, False), ("C.md", 0, True)]


def plain_leaves(v, prefix=""):
    for k, x in v.items():
        path = f"{prefix}.{k}" if prefix else k
        if isinstance(x, dict):
            yield from plain_leaves(x, path)
        else:
            yield path, json.dumps(x, separators=(",", ":"))


def test_leaves(spark):
    texts = ['{"a": {"b": {"c": 1}}, "d": [1, {"e": 2}], "n": null}', "{}", "[1]", "7", "{broken", None, '{"x.y": {"": "s"}}', '{"deep": ' * 9 + "true" + "}" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    want = [(i, p, v) for i, x in enumerate(texts) if x and x[:1] == "{" and x != "{broken" for p, v in plain_leaves(json.loads(x))]
    assert rows(variants.leaves(variants.parsed(df, "t"), "id", "v")) == sorted(want, key=repr)
    assert rows(variants.leaves(variants.parsed(df.limit(0), "t"), "id", "v")) == []
    with pytest.raises(ValueError):
        variants.leaves(variants.parsed(df, "t"), "id", "v", depth=4)
    code = spark.createDataFrame([("t('a.b') i18n.t(\n`c.d`) at('no.no') i18nKey=\"e.f\" t('single')",), (None,)], "c string")
    assert rows(variants.used_keys(code, "c")) == [("a.b",), ("c.d",), ("e.f",)]


def test_specifications(spark):
    texts = ['{"paths": {"/a": {"get": {}, "parameters": []}, "/b": {"post": {}}}}', '{"paths": {}}', '{"paths": {"/a"', '{"info": 1}', None, "paths:\n  /x:"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert rows(variants.spec_endpoints(df, "id", "t")) == sorted([(0, "GET", "/a", False), (0, "POST", "/b", False), (1, None, None, True), (2, None, None, True), (5, None, None, True)], key=repr)


def plain_section(text, heading):
    needle = re.sub(r"^#+\s*", "", (heading or "").lower()).strip()
    if not needle:
        return text or ""
    out, level = [], 0
    for line in (text or "").split("\n"):
        m = re.match(r"^(#{1,6})[ \t]+(.+?)[ \t]*$", line)
        if level == 0 and m and needle in m[2].lower():
            level = len(m[1])
        elif level > 0 and m and len(m[1]) <= level:
            level = -1
        if level > 0:
            out.append(line)
    return "\n".join(out)


def test_sections(spark):
    rng = random.Random(1)
    docs = ["\n".join(rng.choice(["# One", "## Two the", "### Three", "text", "## One more", "#none", "###### six"]) for _ in range(rng.randrange(12))) for _ in range(40)] + [None]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, t string")
    for heading in ("## one", "the", "absent", "", None):
        got = df.select("id", sections.section(F.col("t"), F.lit(heading).cast("string")).alias("s")).collect()
        assert {r.id: r.s for r in got} == {i: plain_section(x, heading) for i, x in enumerate(docs)}
    heads = [(i, k, len(m[1])) for i, x in enumerate(docs) for k, line in enumerate((x or "").split("\n")) if (m := re.match(r"^(#{1,6})[ \t]+", line))]
    got = sections.ends(spark.createDataFrame(heads, "id int, place int, level int"), "id")
    want = [(i, p, n, min((q for j, q, m in heads if j == i and q > p and m <= n), default=None)) for i, p, n in heads]
    assert rows(got) == sorted(want, key=repr)


def test_stale_sections(spark):
    expected = spark.createDataFrame([(k, b) for k, b in enumerate(["a\nb\nc", " same\n", "long" * 40, "a", "x", "pinned", "a\nb"])], "id int, body string")
    actual = spark.createDataFrame([(0, "a\nB\nc", False), (1, "same", None), (2, "", False), (3, "a\nmore", False), (5, "other", True), (6, "a", False), (9, "alone", False)], "id int, body string, pinned boolean")
    assert rows(sections.stale_sections(expected, actual, ["id"])) == [(0, 2, "B", "b"), (2, 1, "", "long" * 15), (3, 2, "more", ""), (6, 2, "", "b")]


def test_upsert(spark):
    def put(text, body, position="end", section_id="s"):
        return tuple(spark.range(1).select(sections.upserted(F.lit(text).cast("string"), F.lit(section_id), F.lit(body), position=position).alias("x")).first().x)

    block = "<!-- folioscope:section id=s source=code -->\nbody\n<!-- /folioscope:section -->"
    assert put("# T\ntext\n\n", "\nbody\n") == (f"# T\ntext\n\n{block}\n", "inserted")
    assert put("lead\n# T\ntext", "body", "top") == (f"lead\n# T\n\n{block}\ntext", "inserted")
    assert put("no heading", "body", "top") == (f"no heading\n\n{block}\n", "inserted")
    once = put("# T", "body")[0]
    assert put(once, "body") == (once, "unchanged")
    assert put(once, "new\nlines") == (once.replace("body", "new\nlines"), "replaced")
    assert put(once.replace("id=s source", 'id="s" pinned="x" source'), "new")[1] == "replaced"
    after = put(once + "tail", "body", "after:s", "o.2")
    assert after == (once.rstrip("\n") + "\n\n" + block.replace("id=s", "id=o.2") + "\ntail", "inserted")
    assert put(None, "body") == (f"\n\n{block}\n", "inserted")
    assert put(after[0], "new", section_id="o.2")[0].count("new") == 1 and "\nbody\n" in put(after[0], "new", section_id="o.2")[0]


def test_edits(spark):
    texts = [(1, "see [a](#x) and é [b](#yy)"), (2, None), (3, "plain"), (4, "abcdef")]
    t = spark.createDataFrame(texts, "id int, t string")
    found = t.select("id", F.inline(edits.places(F.col("t"), r"\]\(#([^)]*)")))
    assert rows(found) == [(1, 23, 25, "yy"), (1, 9, 10, "x")]
    mended = edits.applied(t, found.where("found = 'x'").select("id", "begin", "end", F.lit("long-slug").alias("by")), ["id"], "t")
    assert {r.id: (r.t, r.n_applied) for r in mended.collect()} == {1: ("see [a](#long-slug) and é [b](#yy)", 1), 2: ("", 0), 3: ("plain", 0), 4: ("abcdef", 0)}
    sets = [(4, 0, 2, "X"), (4, 1, 3, "no"), (4, 2, 2, "+"), (4, 4, 6, ""), (4, 4, 6, ""), (4, 5, 3, "back"), (4, 6, 6, "!"), (1, 0, 0, "> "), (9, 0, 1, "gone")]
    got = edits.applied(t, spark.createDataFrame(sets, "id int, begin int, end int, by string"), ["id"], "t")
    assert {r.id: (r.t, r.n_applied, r.n_refused) for r in got.collect() if r.id in (1, 4)} == {1: ("> see [a](#x) and é [b](#yy)", 1, 0), 4: ("Xcd!", 3, 3)}
    again = edits.applied(mended, mended.select("id", F.inline(edits.places(F.col("t"), r"\]\(#([^)]*)"))).where("found = 'x'").select("id", "begin", "end", F.lit("z").alias("by")), ["id"], "t")
    assert sum(r.n_applied for r in again.collect()) == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_order(spark, parts):
    rng = random.Random(2)
    data = [(k, rng.randrange(5), rng.choice([None, 1, 3, 10])) for k in range(500)]
    df = spark.createDataFrame(data, "id int, g int, w int").repartition(5)
    got = {r.id: (r.rank, r.total) for r in ordered.running(df, ["g", F.desc("id")], "w", parts).collect()}
    want, total = {}, 0
    for k, (i, _, w) in enumerate(sorted(data, key=lambda r: (r[1], -r[0])), 1):
        total += w or 0
        want[i] = (k, total)
    assert got == want
    assert rows(ordered.first_of(df, ["g", "id"], 3).select("id", "rank")) == sorted((i, k) for k, (i, _, _) in enumerate(sorted(data, key=lambda r: (r[1], r[0]))[:3], 1))
    assert ordered.running(df.limit(0), ["id"], "w", parts).count() == 0
    packs = {r.id: r.pack for r in ordered.packed(df, ["g", F.desc("id")], "w", 50).collect()}
    assert packs == {i: (want[i][1] - (w or 0)) // 50 for i, _, w in data}


def test_full_pack(spark):
    df = spark.createDataFrame([("a.md", "1\n2\n3"), ("b.md", None)], "path string, t string")
    got = {r.path: r for r in ordered.full_pack(df, "path", "t", 2).collect()}
    assert got["a.md"].entry == "---\n\n## a.md\n\n1\n2\n\n<!-- truncated: 1 more lines — read a.md directly -->\n" and got["a.md"].n_cut == 1
    assert (got["b.md"].entry, got["b.md"].n_lines) == ("---\n\n## b.md\n\n\n", 1)


def plain_digest(data):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    counts = {}
    for r in data:
        v = sha("\x1f".join("-" if x is None else f"={x}" for x in r))
        counts[v] = counts.get(v, 0) + 1
    level = [sha(f"{v}:{n}") for v, n in counts.items()]
    depth = 0
    while ordered.LEAF * ordered.FAN**depth < len(level):
        depth += 1

    def node(prefix, own):
        if len(prefix) == depth:
            return sha("".join(sorted(own)))
        below = {d: [h for h in own if h[len(prefix)] == d] for d in "0123456789abcdef"}
        return sha("".join(d + node(prefix + d, hs) for d, hs in below.items() if hs))

    return node("", level) if level else sha("")


@pytest.mark.parametrize("n", [0, 100, 700, 5000])
def test_table_digest(spark, n):
    data = [(k % (n - 7 or 1), None if k % 5 == 0 else f"é{k % 3}") for k in range(n)]
    df = spark.createDataFrame(data, "a int, b string")
    got = [tuple(ordered.table_digest(df.repartition(p), ["a", "b"]).first()) for p in (1, 6)]
    assert got == [(plain_digest(data), n)] * 2
    if n:
        assert ordered.table_digest(df.limit(n - 1), ["a", "b"]).first().digest != got[0][0]


def test_digest_of_more_than_a_million_rows_is_that_of_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from folioscope.plans import catalog

    rows = spark.range(1_060_000).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"), F.col("id").alias("user_id"), F.lit("{}").alias("props"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = catalog.QUERIES["findings_digest"](spark, str(tmp_path)).first()
    assert (got.digest, got.n_rows) == con.execute(catalog.ORACLE_SQL["findings_digest"]).fetchall()[0]

"""Queries for globs, JSON of any shape, sections, edits, caps in order and digests, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edits, extract, globs, ordered, sections, variants

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Globs: paths of pages; those of plain addresses are documented with a wild last digit, without their folder if that is German

_PATHS = r"""p AS (SELECT url LIKE 'https:%' AS safe, regexp_extract(url, '^https?://([^/]*)', 1) AS host, html, regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[?#].*$', ''), '/+$', '') AS path FROM pages),
    g AS (SELECT DISTINCT regexp_replace(CASE WHEN path LIKE 'de/%' THEN substr(path, 4) ELSE path END, '[0-9](\.html)?$', '*\1') AS "glob" FROM p WHERE NOT safe AND path <> ''),
    c AS (SELECT DISTINCT path FROM p WHERE safe),
    m AS (SELECT "glob", path FROM g JOIN c ON regexp_matches(CASE WHEN contains("glob", '/') THEN path ELSE regexp_replace(path, '^.*/', '') END, '^' || replace(replace("glob", '.', '\.'), '*', '.*') || '$'))"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "^https?://[^/]*/", ""), "[?#].*$", ""), "/+$", "")
    return _t(spark, sf_dir, "pages").select(url.startswith("https:").alias("safe"), F.regexp_extract(url, "^https?://([^/]*)", 1).alias("host"), "html", path.alias("path"))


def _globs(paths: DataFrame) -> DataFrame:
    entry = F.when(F.col("path").startswith("de/"), F.expr("substring(path, 4)")).otherwise(F.col("path"))
    return paths.where(~F.col("safe") & (F.col("path") != "")).select(F.regexp_replace(entry, r"[0-9](\.html)?$", "*$1").alias("glob"))


@query(f"WITH {_PATHS} SELECT * FROM m")
def glob_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paths(spark, sf_dir)
    return globs.matches(_globs(p), p.where("safe"))


@query(f"WITH {_PATHS} SELECT \"glob\" AS name, 'documented_only' AS side FROM g WHERE \"glob\" NOT IN (SELECT \"glob\" FROM m) UNION ALL SELECT path, 'actual_only' FROM c WHERE path NOT IN (SELECT path FROM m)")
def glob_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paths(spark, sf_dir)
    return globs.compared(_globs(p), p.where("safe"))


@query(f"""WITH {_PATHS}, w AS (SELECT DISTINCT host AS doc, path[1:4] AS stem FROM p WHERE NOT safe AND path <> ''), h AS (SELECT doc, count(DISTINCT path) AS n FROM w JOIN c ON starts_with(path, stem) GROUP BY 1),
    s AS (SELECT DISTINCT host AS doc FROM p WHERE contains(html, '<!-- ad 1'))
    SELECT doc, coalesce(n, 0) AS n_sources, coalesce(n, 0) > 0 OR doc IN (SELECT doc FROM s) AS linked FROM (SELECT DISTINCT doc FROM w) LEFT JOIN h USING (doc)""")
def traced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paths(spark, sf_dir)
    wanted = p.where(~F.col("safe") & (F.col("path") != "")).select(F.col("host").alias("doc"), F.concat(F.substring("path", 1, 4), F.lit("*")).alias("glob")).distinct()
    return globs.traced(wanted, p.where("safe"), p.where(F.col("html").contains("<!-- ad 1")).select(F.col("host").alias("doc")))


# JSON: an object for each event, of objects that its type and user name; those of some users are cut off

_NAMES = """n AS (SELECT event_id, event_type, user_id, CASE WHEN user_id % 25 = 0 THEN left(j, 12) ELSE j END AS j FROM (SELECT *, '{"' || event_type || '": {"u' || (user_id % 10) || '": ' || props || ', "v": [1], "none": {}}, "w": null}' AS j FROM events))"""
_LEAVES = f"""{_NAMES}, o AS (SELECT event_id, CAST(NULL AS VARCHAR) AS path, CAST(j AS JSON) AS v FROM n WHERE json_valid(j)),
    t AS (SELECT * FROM o UNION ALL SELECT event_id, CASE WHEN path IS NULL THEN k ELSE path || '.' || k END AS path, json_extract(v, '$."' || k || '"') AS v FROM (SELECT event_id, path, v, unnest(json_keys(v)) AS k FROM t WHERE json_type(v) = 'OBJECT')),
    l AS (SELECT event_id, path, CAST(v AS VARCHAR) AS value FROM t WHERE path IS NOT NULL AND json_type(v) <> 'OBJECT')"""


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.concat(F.lit('{"'), F.col("event_type"), F.lit('": {"u'), F.col("user_id") % 10, F.lit('": '), F.col("props"), F.lit(', "v": [1], "none": {}}, "w": null}'))
    return _t(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.when(F.col("user_id") % 25 == 0, F.left(j, F.lit(12))).otherwise(j).alias("j"))


@query(f"WITH RECURSIVE {_LEAVES} SELECT * FROM l")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.leaves(variants.parsed(_objects(spark, sf_dir), "j"), "event_id", "v")


@query(f"""WITH RECURSIVE {_LEAVES}, u AS (SELECT DISTINCT event_type || '.u' || (event_id % 13) || '.k' AS name FROM events)
    SELECT name FROM u WHERE name NOT IN (SELECT path FROM l)""")
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _t(spark, sf_dir, "events").select(F.concat(F.lit("x = i18n.t( '"), F.col("event_type"), F.lit(".u"), F.col("event_id") % 13, F.lit(".k')")).alias("code"))
    return variants.missing_keys(variants.used_keys(code, "code"), variants.leaves(variants.parsed(_objects(spark, sf_dir), "j"), "event_id", "v"))


_SEGMENTS = {"BUILDING": "get", "AUTOMOBILE": "post", "MACHINERY": "delete", "HOUSEHOLD": "x-note"}  # furniture is cut off


@query("""WITH s AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'GET' WHEN 'AUTOMOBILE' THEN 'POST' WHEN 'MACHINERY' THEN 'DELETE' END AS method FROM customer)
    SELECT c_custkey, method, CASE WHEN method IS NOT NULL THEN '/c/' || c_custkey END AS path, method IS NULL AS incomplete FROM s""")
def spec_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.coalesce(F.create_map(*[F.lit(x) for kv in _SEGMENTS.items() for x in kv])[F.col("c_mktsegment")], F.lit("cut"))
    whole = F.concat(F.lit('{"openapi": "3.0.0", "paths": {"/c/'), F.col("c_custkey"), F.lit('": {"'), method, F.lit('": {"tags": []}, "summary": "x"}}}'))
    spec = F.when(method == "cut", F.left(whole, F.lit(40))).otherwise(whole)
    return variants.spec_endpoints(_t(spark, sf_dir, "customer").select("c_custkey", spec.alias("spec")), "c_custkey", "spec")


# Sections: pages as Markdown; the title, adverts and short paragraphs are headings

_MARKDOWN = (
    (r'<a href="([^"]*)">([^<]*)</a>', "[@2](@1)"),
    (r"<h1>([^<]*)</h1>", "\n# @1\n"),
    (r'<div class="ad">([^<]*)</div>', "\n## @1\n"),
    (r"<p>([^<]{1,60})</p>", "\n### @1\n"),
    (r"<li>", "\n- "),
    (r"<[^>]*>", "\n"),
)


def markdown(html: Column) -> Column:
    x = F.coalesce(html, F.lit(""))
    for pattern, by in _MARKDOWN:
        x = F.regexp_replace(x, pattern, by.replace("@", "$"))
    return x


MARKDOWN_SQL = "coalesce(html, '')"
for _pattern, _by in _MARKDOWN:
    MARKDOWN_SQL = f"regexp_replace({MARKDOWN_SQL}, '{_pattern}', E'{_by.replace('@', chr(92) * 2).replace(chr(10), chr(92) + 'n')}', 'g')"
_MD = f"md AS (SELECT page_id, url, {MARKDOWN_SQL} AS md FROM pages)"
_MD_LINES = rf"{_MD}, l AS (SELECT page_id, unnest(c) AS content, generate_subscripts(c, 1) AS line FROM (SELECT page_id, string_split(md, chr(10)) AS c FROM md)), h AS (SELECT page_id, line, length(regexp_extract(content, '^(#{{1,6}})[ \t]+(.+?)[ \t]*$', 1)) AS level, regexp_extract(content, '^(#{{1,6}})[ \t]+(.+?)[ \t]*$', 2) AS heading FROM l WHERE regexp_matches(content, '^(#{{1,6}})[ \t]+(.+?)[ \t]*$'))"


def _pages_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", "url", markdown(F.col("html")).alias("md"))


@query(f'WITH {_MD_LINES} SELECT page_id, line AS place, level, heading, (SELECT min(line) FROM h b WHERE b.page_id = a.page_id AND b.line > a.line AND b.level <= a.level) AS "end" FROM h a')
def section_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = extract.numbered_lines(_pages_md(spark, sf_dir), "page_id", "md").where(F.col("content").rlike(sections.HEADING))
    heads = lines.select("page_id", F.col("line").alias("place"), F.length(F.regexp_extract("content", sections.HEADING, 1)).cast("long").alias("level"), F.regexp_extract("content", sections.HEADING, 2).alias("heading"))
    return sections.ends(heads, "page_id")


@query(f"""WITH {_MD_LINES}, f AS (SELECT page_id, arg_min(line, line) AS a, arg_min(level, line) AS level FROM h WHERE contains(lower(heading), 'the') GROUP BY 1),
    e AS (SELECT f.page_id, a, (SELECT min(line) FROM h WHERE h.page_id = f.page_id AND h.line > f.a AND h.level <= f.level) AS b FROM f)
    SELECT page_id, coalesce((SELECT string_agg(content, chr(10) ORDER BY line) FROM l JOIN e ON l.page_id = e.page_id WHERE l.page_id = md.page_id AND line >= a AND (b IS NULL OR line < b)), '') AS section FROM md""")
def section_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages_md(spark, sf_dir).select("page_id", sections.section(F.col("md"), F.lit("## The")).alias("section"))


_FIRST = "string_split(coalesce(text, ''), chr(10))[1]"


@query(f"""WITH d AS (SELECT doc_id, {_FIRST} AS first, trim(coalesce(text, ''), E' \\t\\n\\x0b\\x0c\\r') AS body, contains(coalesce(text, ''), 'token') AS pinned FROM documents), m AS (SELECT first, arg_min(body, doc_id) AS body FROM d GROUP BY 1),
    b AS (SELECT doc_id, string_split(m.body, chr(10)) AS e, string_split(d.body, chr(10)) AS a FROM d JOIN m USING (first) WHERE NOT pinned AND d.body <> m.body),
    x AS (SELECT doc_id, e, a, list_min(list_filter(range(1, greatest(len(e), len(a)) + 1), lambda i: e[i] IS DISTINCT FROM a[i])) AS line FROM b)
    SELECT doc_id, line, coalesce(a[line], '')[1:60] AS documented, coalesce(e[line], '')[1:60] AS generated FROM x""")
def stale_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    docs = docs.withColumn("first", F.sha2(F.substring_index("body", "\n", 1), 256))
    model = docs.groupBy("first").agg(F.min("doc_id").alias("doc_id")).join(docs.select("doc_id", F.col("body").alias("model")), "doc_id").drop("doc_id")
    each = docs.join(model, "first")
    expected, actual = each.select("doc_id", F.col("model").alias("body")), docs.select("doc_id", "body", F.col("body").contains("token").alias("pinned"))
    return sections.stale_sections(expected, actual, ["doc_id"])


@query(rf"""WITH {_MD}, b AS (SELECT page_id, url, md, '<!-- folioscope:section id=summary source=code -->' || chr(10) || 'page ' || page_id || chr(10) || '<!-- /folioscope:section -->' AS block FROM md),
    s AS (SELECT page_id, url, md, block, string_split(md, chr(10)) AS c FROM b), i AS (SELECT *, list_position(list_transform(c, lambda x: regexp_matches(x, '^#{{1,6}}[ \t]')), true) AS k FROM s)
    SELECT page_id, CASE WHEN url LIKE 'https:%' THEN 'replaced' ELSE 'inserted' END AS action, sha256(CASE WHEN k > 0 THEN array_to_string(list_concat(list_concat(c[:k], ['', block]), c[k + 1:]), chr(10)) ELSE rtrim(md, chr(10)) || chr(10) || chr(10) || block || chr(10) END) AS text_sha256 FROM i""")
def upserted_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe pages have a section already, which is replaced; the others get one."""
    pages = _pages_md(spark, sf_dir)
    put = lambda body: sections.upserted(F.col("md"), F.lit("summary"), body, position="top")
    before = pages.withColumn("md", F.when(F.col("url").startswith("https:"), put(F.lit("old\nlines\n")).getField("text")).otherwise(F.col("md")))
    after = before.select("page_id", put(F.concat(F.lit("page "), F.col("page_id"))).alias("x"))
    return after.select("page_id", "x.action", F.sha2("x.text", 256).alias("text_sha256"))


# Edits: links whose target is another one in lower case are mended


@query("""WITH k AS (SELECT DISTINCT t FROM (SELECT unnest(regexp_extract_all(html, 'href="/([^"]*)', 1)) AS t FROM pages) WHERE t = lower(t)),
    w AS (SELECT DISTINCT t FROM (SELECT unnest(regexp_extract_all(html, 'href="/([^"]*)', 1)) AS t FROM pages) WHERE t <> lower(t) AND lower(t) IN (SELECT t FROM k)),
    s AS (SELECT page_id, html, (SELECT list(t) FROM w) AS bad, string_split(html, 'href="/') AS c FROM pages),
    x AS (SELECT page_id, html, c[1] || array_to_string(list_transform(c[2:], lambda p: 'href="/' || CASE WHEN list_contains(bad, regexp_extract(p, '^([^"]*)', 1)) THEN lower(regexp_extract(p, '^([^"]*)', 1)) || substr(p, length(regexp_extract(p, '^([^"]*)', 1)) + 1) ELSE p END), '') AS fixed,
        len(list_filter(c[2:], lambda p: list_contains(bad, regexp_extract(p, '^([^"]*)', 1)))) AS n FROM s)
    SELECT page_id, sha256(fixed) AS html_sha256, CAST(n AS BIGINT) AS n_applied, CAST(0 AS BIGINT) AS n_refused FROM x""")
def mended_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages").select("page_id", "html")
    links = pages.select("page_id", F.inline(edits.places(F.col("html"), 'href="/([^"]*)')))
    known = links.where(F.col("found") == F.lower("found")).select(F.col("found").alias("by")).distinct()
    wrong = links.where(F.col("found") != F.lower("found")).withColumn("by", F.lower("found")).join(known, "by", "left_semi")
    fixed = edits.applied(pages, wrong.select("page_id", "begin", "end", "by"), ["page_id"], "html")
    return fixed.select("page_id", F.sha2("html", 256).alias("html_sha256"), "n_applied", "n_refused")


# Caps and packs in order, digests


@query("SELECT event_id, user_id, rank FROM (SELECT event_id, user_id, row_number() OVER (ORDER BY ts DESC, event_id) AS rank FROM events) WHERE rank <= 500")
def newest_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.first_of(_t(spark, sf_dir, "events"), [F.desc("ts"), "event_id"], 500).select("event_id", "user_id", "rank")


@query("""WITH r AS (SELECT doc_id, source, coalesce(length(text), 0) AS n FROM documents), t AS (SELECT doc_id, n, row_number() OVER w AS rank, sum(n) OVER (ORDER BY source, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM r WINDOW w AS (ORDER BY source, doc_id))
    SELECT doc_id, rank, CAST(total AS BIGINT) AS total, CAST((total - n) // 50000 AS BIGINT) AS pack FROM t""")
def document_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return ordered.packed(docs, ["source", "doc_id"], "n", 50_000).select("doc_id", "rank", "total", "pack")


@query("""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS c FROM documents)
    SELECT doc_id, len(c) AS n_lines, greatest(len(c) - 12, 0) AS n_cut, '---' || chr(10) || chr(10) || '## ' || doc_id || chr(10) || chr(10) || array_to_string(c[:12], chr(10)) || CASE WHEN len(c) > 12 THEN chr(10) || chr(10) || '<!-- truncated: ' || (len(c) - 12) || ' more lines — read ' || doc_id || ' directly -->' ELSE '' END || chr(10) AS entry FROM s""")
def full_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.full_pack(_t(spark, sf_dir, "documents"), "doc_id", "text", 12)


_NODE = "SELECT CASE WHEN d >= {0} THEN k[1:d - {0}] ELSE k END AS k, d, CASE WHEN d >= {0} THEN sha256(string_agg(k[d - {0} + 1:d - {0} + 1] || h, '' ORDER BY k)) ELSE max(h) END AS h FROM {1} GROUP BY 1, 2"


@query(f"""WITH v AS (SELECT sha256('=' || event_type || chr(31) || '=' || user_id || chr(31) || '=' || props) AS v, count(*) AS n FROM events GROUP BY event_type, user_id, props), h AS (SELECT sha256(v || ':' || n) AS h FROM v),
    n AS (SELECT CASE WHEN count(*) <= 256 THEN 0 WHEN count(*) <= 4096 THEN 1 WHEN count(*) <= 65536 THEN 2 ELSE 3 END AS d FROM h), l AS (SELECT h[1:d] AS k, d, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h, n GROUP BY 1, 2),
    a AS ({_NODE.format(1, "l")}), b AS ({_NODE.format(2, "a")}), c AS ({_NODE.format(3, "b")}) SELECT h AS digest, (SELECT count(*) FROM events) AS n_rows FROM c""")
def findings_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.table_digest(_t(spark, sf_dir, "events"), ["event_type", "user_id", "props"])

"""Queries for upkeep, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, governance, markdown, markers, upkeep
from ..sources.derived import Derived
from . import document_queries, governance_queries, reference_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


TRACKING = Derived("tracking", "SELECT 'T' || c_custkey AS doc, 'Roadmap: FIX ' || (c_custkey % 150) || CASE c_custkey % 3 WHEN 0 THEN ' in src/e' || (c_custkey * 6) || '.js' WHEN 1 THEN ' and (me): Later, src/e' || (c_custkey * 7) || '.js:2' ELSE '' END AS content FROM {customer}")
_TODO_LINES = """l AS (SELECT path, unnest(c) AS content, generate_subscripts(c, 1) AS line FROM (SELECT path, string_split(content, chr(10)) AS c FROM sources)),
    n AS (SELECT path, line, regexp_extract(content, '^(?:.*?)(?://|#|/\\*|<!--|^[ \\t]*\\*[ \\t])(.*)$', 1) AS c FROM l),
    m AS (SELECT path, line, regexp_extract(c, '(?:^|[^A-Za-z0-9_])(TODO|FIXME|HACK|XXX|TEMP|WORKAROUND)[ \\t]*[(:][ \\t]*(.*)', ['kind', 'note']) AS x FROM n),
    todo AS (SELECT path, line, x.kind AS kind, trim(x.note) AS note FROM m WHERE x.kind <> '')"""


@query(f"""WITH {reference_queries.SOURCES.cte()}, {TRACKING.cte()}, {_TODO_LINES}, s AS (SELECT *, CASE WHEN length(note) > 20 THEN lower(note)[1:40] ELSE lower(note) END AS sought FROM todo)
    SELECT path, line, kind, note FROM s WHERE NOT EXISTS (SELECT 1 FROM tracking WHERE contains(lower(content), sought) AND (contains(content, path) OR length(note) > 30))""")
def untracked_todos(spark: SparkSession, sf_dir: str) -> DataFrame:
    todos = extract.annotations(reference_queries.SOURCES.df(spark, sf_dir), "path", "content")
    return upkeep.untracked_todos(todos, TRACKING.df(spark, sf_dir), "doc", "content")


LOG = Derived("log", "SELECT '- src/a' || p_partkey || '.py: agreed' AS entry FROM {part} WHERE p_size > 20")


@query(f"""WITH {document_queries.MARKED.cte()}, {LOG.cte()}, c AS (SELECT path, line, trim(regexp_extract(content, '(?i)(?://|#|/\\*|--)\\s*DRIFT:\\s*(.+)', 1)) AS comment
    FROM (SELECT path, unnest(c) AS content, generate_subscripts(c, 1) AS line FROM (SELECT path, string_split(content, chr(10)) AS c FROM marked WHERE contains(content, 'DRIFT:') AND NOT regexp_matches(path, '(^|/)(__tests__|tests?|spec)/|\\.(test|spec)\\.[^.]+$'))) WHERE regexp_matches(content, '(?i)(?://|#|/\\*|--)\\s*DRIFT:\\s*(.+)'))
    SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM log WHERE contains(entry, path))""")
def unlogged_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = markers.drift_comments(document_queries.MARKED.df(spark, sf_dir), "path", "content")
    return upkeep.unlogged_drift(comments, LOG.df(spark, sf_dir), "entry")


ANNOTATED = Derived("annotated", "SELECT 'src/f' || event_id || CASE user_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.py' ELSE '.ts' END AS path, CASE event_type WHEN 'view' THEN '// @doc docs/V' || (user_id % 9) || '.md' || chr(10) || '# @doc V' || (user_id % 9) || '.md /*@doc X.md' WHEN 'error' THEN repeat('x', 4090) || '// @doc FAR.md' WHEN 'click' THEN '@doc NONE.md' END AS content FROM {events}")


@query(f"""WITH {ANNOTATED.cte()} SELECT DISTINCT regexp_replace(d, '^.*/', '') AS doc, path FROM (SELECT path, unnest(regexp_extract_all(content[1:4096], '(?://|/\\*|#)\\s*@doc\\s+(\\S+\\.md)', 1)) AS d FROM annotated WHERE regexp_matches(path, '\\.(py|ts)$'))""")
def doc_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.doc_annotations(ANNOTATED.df(spark, sf_dir), "path", "content")


NOTES = Derived("notes", "SELECT 'N' || c_custkey || '.md' AS doc, '<!-- folioscope:validator ' || CASE c_custkey % 4 WHEN 0 THEN 'Ship_' || c_nationkey WHEN 1 THEN 'ship-' || c_nationkey ELSE 'odd' || c_nationkey END || ' N/A' || CASE c_custkey % 3 WHEN 0 THEN ': no ships here ' ELSE '' END || ' -->' || chr(10) || '<!-- folioscope:quality passive ' || CASE c_custkey % 3 WHEN 0 THEN 'off' WHEN 1 THEN '.5' ELSE '12.25' END || ' why --> <!-- folioscope:quality Passive 9 --> <!-- folioscope:quality negation 0 -->' AS content FROM {customer}")
KEYS = Derived("keys", "SELECT 'ship' || n_nationkey AS key FROM {nation}")


@query(f"""WITH {NOTES.cte()}, {KEYS.cte()}, m AS (SELECT doc, regexp_extract(content, '(?i)folioscope:validator\\s+([A-Za-z0-9_-]+)\\s+n/a\\b\\s*(?:[—:\\-]+\\s*([^>]*?))?\\s*-->', ['raw', 'reason']) AS x FROM notes),
    k AS (SELECT doc, x.raw AS raw, trim(x.reason) AS reason, key FROM m LEFT JOIN keys ON regexp_replace(lower(x.raw), '[^a-z0-9]', '', 'g') = key)
    SELECT doc, raw, key, reason FROM k WHERE key IS NULL UNION ALL SELECT min(doc), arg_min(raw, doc), key, arg_min(reason, doc) FROM k WHERE key IS NOT NULL GROUP BY key""")
def na_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.na_markers(NOTES.df(spark, sf_dir), "doc", "content", KEYS.df(spark, sf_dir))


@query(f"""WITH {NOTES.cte()} SELECT doc, 'passive' AS rule, x = 'off' AS off, TRY_CAST(x AS DOUBLE) AS threshold FROM (SELECT doc, regexp_extract(content, 'quality passive (\\S+)', 1) AS x FROM notes)
    UNION ALL SELECT doc, 'Passive', false, 9 FROM notes UNION ALL SELECT doc, 'negation', false, 0 FROM notes""")
def quality_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.quality_overrides(NOTES.df(spark, sf_dir), "doc", "content")


MODULES = Derived("modules", "SELECT CASE c_custkey % 4 WHEN 0 THEN 'ui/b' || (c_custkey % 160) || '.ts' WHEN 1 THEN 'ui/b' || (c_custkey % 160) || '.js' WHEN 2 THEN 'ui/b' || (c_custkey % 160) || '/index.mjs' ELSE 'db/c' END AS path FROM {customer}")


@query(f"""WITH {governance_queries.SCRIPTS.cte()}, {MODULES.cte()}, e AS (SELECT DISTINCT path AS src, t AS target, CASE WHEN t LIKE './%' THEN 'ui/' || t[3:] ELSE t[4:] END AS base FROM (SELECT path, unnest(regexp_extract_all(content, '(?:from |require\\()''([^'']+)''', 1)) AS t FROM scripts)),
    w AS (SELECT src, target, unnest([base || '.ts', base || '.tsx', base || '.js', base || '.mjs', base || '.jsx', base || '.cjs', base, base || '/index.ts', base || '/index.tsx', base || '/index.js', base || '/index.mjs', base || '/index.jsx', base || '/index.cjs']) AS path, generate_subscripts(range(13), 1) AS k FROM e)
    SELECT src, target, arg_min(path, k) FILTER (WHERE path IN (SELECT path FROM modules)) AS path FROM w GROUP BY 1, 2""")
def resolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = governance.imports(governance_queries.SCRIPTS.df(spark, sf_dir), "path", "content").where("NOT dynamic")
    return upkeep.resolved_imports(edges, MODULES.df(spark, sf_dir))


_DATED = "SELECT o_orderkey AS doc, CASE WHEN o_custkey % 3 = 0 THEN CAST(TIMESTAMP '2023-11-20 00:00:00' + INTERVAL 1 DAY * CAST(o_custkey % 70 AS INT) AS DATE) END AS reviewed, CASE WHEN o_custkey % 3 = 1 THEN TIMESTAMP '2023-11-20 07:30:00' + INTERVAL 1 DAY * CAST(o_custkey % 71 AS INT) END AS committed, CASE WHEN o_custkey % 7 = 0 THEN 'approved' END AS status FROM {orders}"
DATED = Derived("dated", _DATED)


@query(f"""WITH {DATED.cte()}, d AS (SELECT doc, status, coalesce(CAST(reviewed AS TIMESTAMP), committed) AS date, coalesce(CAST(reviewed AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 SECOND, committed) AS since FROM dated),
    e AS (SELECT ts, max(n) AS n FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS n FROM events) GROUP BY 1), t AS (SELECT count(*) AS total, max(ts) AS now FROM events),
    l AS (SELECT d.*, CASE WHEN since IS NULL THEN 0 ELSE total - coalesce(e.n, 0) END AS later, CAST(floor(epoch_us(now) / 86400000000.0 - epoch_us(date) / 86400000000.0) AS BIGINT) AS behind FROM d CROSS JOIN t ASOF LEFT JOIN e ON d.since >= e.ts),
    c AS (SELECT doc, CASE WHEN date IS NULL THEN CASE WHEN status IS NULL THEN 'FRS001' END WHEN later >= 10 THEN 'FRS002' WHEN behind > 30 THEN 'FRS003' END AS code, later, behind FROM l) SELECT * FROM c WHERE code IS NOT NULL""")
def stale_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").alias("committed"))
    return upkeep.stale_documents(DATED.df(spark, sf_dir), commits)


@query(f"""WITH {document_queries.DOCS.cte()} SELECT path, lower(heading) AS heading, count(*) AS n FROM {document_queries.HEADINGS_SQL} GROUP BY 1, 2 HAVING count(*) > 1""")
def repeated_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = markdown.headings(document_queries.DOCS.df(spark, sf_dir), "path", "content").select("path", F.lower("heading").alias("slug"))
    return extract.repeated_headings(heads, "path").withColumnRenamed("slug", "heading")

"""Queries for references to files, rules on one topic, what is gone, changed-only runs and watching, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import conflicts, extract, rules, text_index, validity
from ..sources.shared import stored, work_folder
from ..streaming import incremental, watch

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


# Files that pages name: a page's path is the file, the lines of all pages may name it.

_PATH = r"regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[?#].*$', ''), '/+$', '')"
_PAGE_FILES = f"""f AS (SELECT DISTINCT file, regexp_replace(file, '^.*/', '') AS base, regexp_replace(regexp_replace(file, '^.*/', ''), '\\.[^.]+$', '') AS stem FROM (SELECT {_PATH} AS file FROM pages) WHERE file <> '')"""
_TRACE = f"""{_PAGE_FILES}, l AS (SELECT page_id, unnest(c) AS content, generate_subscripts(c, 1) AS line FROM (SELECT page_id, string_split(html, chr(10)) AS c FROM pages)),
    r AS (SELECT file, page_id, line, CASE WHEN contains(content, file) THEN 'path' WHEN contains(content, base) THEN 'basename' WHEN contains(content, '`' || stem || '`') THEN 'module' END AS kind FROM f JOIN l ON contains(content, file) OR contains(content, base) OR contains(content, '`' || stem || '`'))"""


def _path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "^https?://[^/]*/", ""), "[?#].*$", ""), "/+$", "")


def _page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select(_path(F.col("url")).alias("file")).where("file <> ''")


def _traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = extract.numbered_lines(_t(spark, sf_dir, "pages"), "page_id", "html")
    return text_index.references(_page_files(spark, sf_dir), lines, ["page_id", "line"], "content")


@query(f"WITH {_TRACE} SELECT * FROM r")
def reverse_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traced(spark, sf_dir)


@query(f"WITH {_TRACE} SELECT page_id, count(DISTINCT file) AS n_files, url LIKE '%//m.%' AS is_agent_file FROM r JOIN pages USING (page_id) GROUP BY ALL")
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    agents = _t(spark, sf_dir, "pages").where(F.col("url").contains("//m.")).select("page_id")
    return text_index.impact(_traced(spark, sf_dir), "page_id", agents)


@query(f"WITH {_TRACE} SELECT file FROM f WHERE file NOT IN (SELECT file FROM r)")
def orphaned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index.orphans(_page_files(spark, sf_dir), _traced(spark, sf_dir))


@query(f"""WITH d AS (SELECT {_PATH} AS doc, html FROM pages), c AS (SELECT DISTINCT doc AS changed, regexp_replace(doc, '^.*/', '') AS base, regexp_replace(regexp_replace(doc, '^.*/', ''), '(?i)\\.md$', '') AS stem FROM d)
    SELECT DISTINCT changed, doc FROM c JOIN d ON contains(html, base) OR contains(html, '[[' || stem || '#') OR contains(html, '[[' || stem || '|') OR contains(html, '[[' || stem || ']') WHERE base <> '' AND doc <> changed AND doc <> base""")
def doc_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "pages").select(_path(F.col("url")).alias("doc"), "html")
    return text_index.mentions(docs, "doc", "html", docs.select("doc").distinct())


@query("""WITH n AS (SELECT DISTINCT substr(h, 2) AS name FROM (SELECT unnest(regexp_extract_all(html, 'href="(/[^"]+)"', 1)) AS h FROM pages) WHERE length(h) > 1)
    SELECT name FROM n WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(text, name))""")
def unnamed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _t(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]+)"'), F.lit(1))).alias("h"))
    names = links.where(F.length("h") > 1).select(F.expr("substring(h, 2)").alias("name"))
    return text_index.unnamed(names, _t(spark, sf_dir, "documents"), "name", "text")


# Rules: the sentences of documents that hold a word of command

_SIGNAL = r"(?i)\b(must|never|always|do not|don''t|should|require[sd]?|forbid|only)\b"
_RULES = rf"""al AS (SELECT doc_id, line, content, trim(content, E' \t\r\n\f\v') AS t, starts_with(trim(content, E' \t\r\n\f\v'), '```') AS f FROM (SELECT doc_id, unnest(c) AS content, generate_subscripts(c, 1) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS c FROM documents))),
    an AS (SELECT *, sum(CAST(f AS INT)) OVER (PARTITION BY doc_id ORDER BY line) AS n FROM al),
    cand AS (SELECT doc_id, line, unnest(c) AS rule, generate_subscripts(c, 1) - 1 AS place FROM (SELECT doc_id, line, CASE WHEN regexp_matches(t, '^(?:[-*+]|\d+[.)])[ \t]+(.*)$') THEN [regexp_extract(t, '^(?:[-*+]|\d+[.)])[ \t]+(.*)$', 1)]
        ELSE regexp_split_to_array(regexp_replace(regexp_replace(t, '^>[ \t]*', ''), '([.!?])[ \t]+', '\1' || chr(1), 'g'), chr(1)) END AS c FROM an WHERE NOT f AND n % 2 = 0 AND NOT regexp_matches(t, '^(#|<!--|\|)') AND t <> '')),
    rule AS (SELECT doc_id, line, place, trim(rule, E' \t\r\n\f\v')[1:200] AS rule FROM cand WHERE length(trim(rule, E' \t\r\n\f\v')) >= 8 AND regexp_matches(rule, '{_SIGNAL}'))"""
_SAID = rf"""{_RULES}, nr AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(rule), '[''’]', '', 'g'), '[^a-z0-9 \t\r\n\f]', ' ', 'g'), '[ \t\r\n\f\v]+', ' ', 'g')) AS norm FROM rule),
    sr AS (SELECT *, trim(regexp_replace(regexp_replace(norm, '\b(never|dont|do not|not|always|must|do|should|shall)\b', ' ', 'g'), ' +', ' ', 'g')) AS common, len(regexp_extract_all(norm, '\b(never|dont|do not|not)\b')) % 2 = 1 AS odd FROM nr)"""


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.instruction_rules(_t(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {_RULES} SELECT doc_id, line, place, rule FROM rule")
def instruction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir).select("doc_id", "line", "place", "rule")


_OPPOSED = _RULES.replace("rule AS (", "told AS (", 1) + """, rule AS (SELECT * FROM told UNION ALL SELECT doc_id, line, place + 1000, 'Never ' || rule FROM told WHERE contains(rule, 'only'))"""


@query(f"""WITH {_OPPOSED}{_SAID.removeprefix(_RULES)}, b AS (SELECT common FROM sr WHERE contains(common, ' ') GROUP BY common HAVING count(DISTINCT odd) = 2)
    SELECT doc_id, line, place, common, odd FROM sr WHERE common IN (SELECT common FROM b)""")
def instruction_negations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of documents beside the opposite of those that say ``only``."""
    told = _rules(spark, sf_dir).select("doc_id", "line", "place", "rule")
    opposite = told.where(F.col("rule").contains("only")).select("doc_id", "line", F.col("place") + 1000, F.concat(F.lit("Never "), F.col("rule")))
    return rules.contradictions(told.union(opposite), ["doc_id", "line", "place"], "rule")


_STOP = ", ".join(f"'{w}'" for w in conflicts.TOPIC_STOP_WORDS)
_CUT = "CASE WHEN length(w) > 5 AND w LIKE '%ing' THEN w[:-4] WHEN length(w) > 4 AND (w LIKE '%ed' OR w LIKE '%es') THEN w[:-3] WHEN length(w) > 3 AND w LIKE '%s' THEN w[:-2] ELSE w END"


@query(f"""WITH {_SAID}, st AS (SELECT *, list_transform(list_transform(list_filter(string_split(norm, ' '), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}) AND NOT regexp_matches(w, '^[0-9]+$')), lambda w: {_CUT}),
        lambda x: CASE WHEN length(x) > 3 AND x[-1] = x[-2] THEN x[:-2] ELSE x END) AS s FROM sr),
    d AS (SELECT * EXCLUDE (s), list_filter(s, lambda x, i: list_position(s, x) = i) AS s FROM st),
    p AS (SELECT a.doc_id AS a_file, a.line AS a_line, a.place AS a_place, b.doc_id AS b_file, b.line AS b_line, b.place AS b_place, list_filter(a.s, lambda x: list_contains(b.s, x)) AS shared, a.doc_id <> b.doc_id AS across
        FROM d a JOIN d b ON (a.doc_id, a.line, a.place) < (b.doc_id, b.line, b.place) WHERE a.norm <> b.norm AND NOT (a.common = b.common AND a.odd <> b.odd)),
    o AS (SELECT *, row_number() OVER (ORDER BY across DESC, len(shared) DESC, a_line, b_line, a_file, a_place, b_file, b_place) AS rank FROM p WHERE len(shared) >= 2)
    SELECT * EXCLUDE (shared), array_to_string(shared, ',') AS shared FROM o WHERE rank <= 40""")
def instruction_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.candidates(_rules(spark, sf_dir).withColumnRenamed("doc_id", "file"))


# What is gone: events add and remove users as commits do names, orders are documents on a time of their own that is laid over that of the events

_BEGIN, _WAS, _SCALE = "2024-01-01 00:00:00", "1995-01-01 00:00:00", 80
_CHANGES = "c AS (SELECT 'user_' || user_id AS symbol, ts AS at, event_type <> 'error' AS present FROM events)"
_REFS = f"r AS (SELECT o_orderkey AS doc, 'user_' || (o_custkey % 150) AS symbol, TIMESTAMP '{_BEGIN}' + to_seconds(CAST(floor((epoch(o_orderdate) - epoch(TIMESTAMP '{_WAS}')) / {_SCALE}) AS BIGINT)) AS at FROM orders)"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select(F.concat(F.lit("user_"), F.col("user_id")).alias("symbol"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "error").alias("present"))


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = F.floor((F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) - F.unix_timestamp(F.lit(_WAS).cast("timestamp"))) / _SCALE)
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(_BEGIN).cast("timestamp")) + passed)
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.concat(F.lit("user_"), F.col("o_custkey") % 150).alias("symbol"), at.alias("at"), F.lit(0).alias("place"))


@query(f"""WITH {_CHANGES}, {_REFS}, head AS (SELECT symbol, arg_max(c.present, c.at) AS present FROM c GROUP BY 1),
    n AS (SELECT symbol, c.at AS since, present, lead(c.at) OVER (PARTITION BY symbol ORDER BY c.at) AS until FROM c)
    SELECT DISTINCT doc, symbol FROM r JOIN n USING (symbol) JOIN head USING (symbol) WHERE NOT head.present AND n.present AND n.since <= r.at AND (until IS NULL OR r.at < until)""")
def reference_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.dangling(_refs(spark, sf_dir), _changes(spark, sf_dir))


@query(f"WITH {_CHANGES}, {_REFS} SELECT doc, r.symbol AS symbol, present FROM r ASOF LEFT JOIN c ON r.symbol = c.symbol AND r.at >= c.at")
def presence_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.as_of(_refs(spark, sf_dir), _changes(spark, sf_dir), "symbol", "at", "present").select("doc", "symbol", "present")


_CODE = "code AS (SELECT event_type AS file, event_id AS line, CASE WHEN user_id % 2 = 0 THEN 'f(' || user_id || '); // ADR-' ELSE '\"ADR ' || user_id || '\" # see ADR ' END || json_extract_string(props, '$.k') AS content FROM events)"


@query(f"""WITH {_CODE}, x AS (SELECT file, line, CAST(unnest(regexp_extract_all(CASE WHEN contains(content, '//') THEN substr(content, instr(content, '//')) ELSE substr(content, instr(content, ' # ')) END, '\\bADR[- ]?([0-9]{{1,5}})\\b', 1)) AS INTEGER) AS number FROM code)
    SELECT number, arg_min(file, (file, line)) AS file, arg_min(line, (file, line)) AS line, count(*) AS n FROM x WHERE number NOT IN (SELECT p_size FROM part) GROUP BY 1""")
def undefined_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    even = F.concat(F.lit("f("), F.col("user_id"), F.lit("); // ADR-"), k)
    odd = F.concat(F.lit('"ADR '), F.col("user_id"), F.lit('" # see ADR '), k)
    code = _t(spark, sf_dir, "events").select(F.col("event_type").alias("file"), F.col("event_id").alias("line"), F.when(F.col("user_id") % 2 == 0, even).otherwise(odd).alias("content"))
    defined = _t(spark, sf_dir, "part").select(F.col("p_size").alias("number"))
    return validity.undefined_records(validity.cited_records(code, "file"), defined, "file")


# Changed-only runs: documents come, then a revision of those that hold a token or an address, without them

_TOKEN, _ADDRESS = '"[0-9a-f]{40}"', "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+"
_WORDS = r"len(list_filter(regexp_split_to_array({0}, '[ \t\r\n\f\v]+'), lambda w: w <> ''))"
_REVISED = f"regexp_replace(regexp_replace(coalesce(text, ''), '{_TOKEN}', '\"\"', 'g'), '{_ADDRESS}', '<address>', 'g')"


def _measured(df: DataFrame) -> DataFrame:
    n_words = F.size(F.filter(F.split("text", rf"{t.SPACE}+", -1), lambda w: w != ""))
    return df.select("digest", n_words.cast("long").alias("n_words"), F.regexp_count("text", F.lit(_TOKEN)).cast("long").alias("n_tokens"))


@query(f"WITH r AS (SELECT doc_id, {_REVISED} AS text FROM documents) SELECT doc_id, {_WORDS.format('text')} AS n_words, len(regexp_extract_all(text, '{_TOKEN}')) AS n_tokens FROM r")
def changed_only_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "changed")
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("version"), "text")
    revised = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), _TOKEN, '""'), _ADDRESS, "<address>")
    for came in (docs, docs.select("doc_id", F.lit(1).alias("version"), revised.alias("text")).join(docs.select("doc_id", F.col("text").alias("old")), "doc_id").where("text <> old").drop("old")):
        came.write.mode("append").parquet(f"{folder}/arrived")
        incremental.run_changed(spark, f"{folder}/arrived", docs.schema, "text", _measured, folder)
    versions = spark.read.schema(docs.schema).parquet(f"{folder}/arrived")
    results = spark.read.parquet(f"{folder}/results")
    return incremental.merged(versions, results, "doc_id", "version", "text")


@query("""WITH s AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 6 HOURS, true) AS new FROM (SELECT DISTINCT event_id, user_id, event_type, ts FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
    SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 6 HOURS AS ended, count(*) AS n_changes, count(DISTINCT event_type) AS n_paths FROM n GROUP BY user_id, k""")
def watched_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "watched")
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    tick = events.agg((F.max("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), F.lit(None).cast("long").alias("user_id"), F.lit("tick").alias("event_type"), "ts")
    for name, came in (("events", events.unionByName(events)), ("tick", tick.select(*events.columns))):  # each change is told twice
        stored(came, f"{folder}/arrived/{name}")
        stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/arrived")
        bursts = watch.quiet_sessions(stream, "user_id", "ts", "event_type", "event_id", "6 hours", "1 day")
        bursts.writeStream.format("parquet").option("path", f"{folder}/bursts").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/bursts")

"""Queries for coverage, scores, rules and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, governance
from ..sources.derived import Derived

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


_CATEGORY = "CASE l_linenumber % 4 WHEN 0 THEN 'structure' WHEN 1 THEN 'testing' WHEN 2 THEN 'security' ELSE 'drift' END"


@query(f"""WITH c AS (SELECT l_suppkey AS owner, {_CATEGORY} AS category, l_quantity > 25 AS met, l_linenumber * 5 AS points FROM lineitem),
    p AS (SELECT owner, category, sum(CASE WHEN met THEN points ELSE 0 END) / sum(points) * 100 AS part FROM c GROUP BY 1, 2)
    SELECT owner, CAST(floor(sum(part / 100 * CASE category WHEN 'structure' THEN 25 WHEN 'testing' THEN 15 ELSE 10 END) + 0.5) AS BIGINT) AS score FROM p GROUP BY owner""")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    category = F.when(n == 0, "structure").when(n == 1, "testing").when(n == 2, "security").otherwise("drift")
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("owner"), category.alias("category"), (F.col("l_quantity") > 25).alias("met"), (F.col("l_linenumber") * 5).alias("points"))
    return governance.weighted_score(li, "owner")


@query("""SELECT p_partkey, CAST(greatest(5, floor(p_size * 3 * CASE WHEN p_partkey % 60 > 50 THEN 1.5::DOUBLE WHEN p_partkey % 60 > 20 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END
    * CASE WHEN p_retailprice % 100 > 80 THEN 0.7::DOUBLE WHEN p_retailprice % 100 > 60 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END * 0.3::DOUBLE + 0.5::DOUBLE)) AS BIGINT) AS tax FROM part""")
def doc_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", governance.doc_tax(F.col("p_size"), F.col("p_partkey") % 60, F.col("p_retailprice") % 100).alias("tax"))


@query("""WITH a AS (SELECT DISTINCT c_custkey AS id FROM customer), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority LIKE '1%'), j AS (SELECT a.id AS x, b.id AS y FROM a FULL JOIN b ON a.id = b.id)
    SELECT count(*) AS n, round(count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) / nullif(count(*), 0), 4) AS accuracy FROM j""")
def memory_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("id"))
    return governance.accuracy(drift.compared(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), orders, "id"))


PATHS = Derived("paths", """SELECT CASE event_id % 6 WHEN 0 THEN 'docs-canonical/U' || user_id || '.md' WHEN 1 THEN 'node_modules/x' || user_id || '/README.md' WHEN 2 THEN 'docs/g' || user_id || '.md' WHEN 3 THEN 'src/a.py' WHEN 4 THEN 'app/build/x.mdx' ELSE 'b' || user_id || '.rst' END AS path FROM {events}""")


@query(f"""WITH {PATHS.cte()} SELECT CASE WHEN path LIKE 'docs-canonical/%' THEN 'canonical' WHEN regexp_matches(path, '(^|/)(node_modules|dist|build)/') THEN 'ignored'
    WHEN regexp_matches(path, '\\.(md|mdx|rst)$') THEN 'tracked' ELSE 'unclassified' END AS tier, count(*) AS n FROM paths GROUP BY 1""")
def coverage_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PATHS.df(spark, sf_dir).groupBy(governance.coverage_tier(F.col("path")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


SPECS = Derived("specs", """SELECT CASE o_orderkey % 2 WHEN 0 THEN 't' ELSE 'a' END || o_orderkey AS path, 'REQ-' || (o_custkey % 700) || ' log in. See FR-' || (o_orderkey % 900) || ' and XREQ-9; ' || CASE o_orderstatus WHEN 'F' THEN 'US-' || (o_custkey % 99) ELSE 'NFR-7' END AS content FROM {orders}""")
_REQ = r"(SELECT path, unnest(regexp_extract_all(content, '(?:^|[^A-Za-z0-9-])((?:REQ|FR|NFR|US|UC|AC|SC|SYS|ARCH|MOD|STORY)-[0-9]{1,5})', 1)) AS req_id FROM specs)"


@query(f"""WITH {SPECS.cte()}, i AS (SELECT DISTINCT path LIKE 't%' AS test, req_id FROM {_REQ}), r AS (SELECT req_id FROM i WHERE NOT test), x AS (SELECT req_id FROM i WHERE test)
    SELECT req_id, 'TRC004' AS code FROM r WHERE req_id NOT IN (SELECT req_id FROM x) UNION ALL SELECT req_id, 'TRC005' FROM x WHERE req_id NOT IN (SELECT req_id FROM r)""")
def requirement_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = SPECS.df(spark, sf_dir)
    is_test = F.col("path").startswith("t")
    return governance.requirement_coverage(governance.requirement_ids(specs.where(~is_test), "path", "content"), governance.requirement_ids(specs.where(is_test), "path", "content"))


@query(f"WITH {SPECS.cte()} SELECT req_id, min(path) AS path FROM {_REQ} GROUP BY req_id")
def requirement_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.requirement_ids(SPECS.df(spark, sf_dir), "path", "content")


@query("""SELECT p_partkey AS doc, CASE WHEN p_size <= 2 THEN 'MISSING' WHEN p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) THEN 'UNLINKED'
    WHEN p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 2) THEN 'PARTIAL' ELSE 'TRACED' END AS state FROM part""")
def trace_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), (F.col("p_size") > 2).alias("present"))
    li = _t(spark, sf_dir, "lineitem").withColumn("doc", F.col("l_partkey"))
    return governance.traced(docs, li.where("l_quantity > 48").select("doc"), li.where("l_quantity < 2").select("doc"))


SCRIPTS = Derived("scripts", """SELECT 'ui/a' || event_id || '.js' AS path, CASE WHEN event_type <> 'purchase' THEN 'import x from ' || chr(39) || './b' || user_id || chr(39) || ';' || chr(10) || 'const y = require(' || chr(39) || '../db/c' || chr(39) || ');' || chr(10) || 'await import(' || chr(39) || './late' || user_id || chr(39) || ');' || chr(10) || 'process.env.KEY_' || upper(event_type) || '; // process.env.NOT_THIS' || chr(10) || 'let s = ' || chr(39) || 'process.env.NOR_THIS' || chr(39) || '; /* process.env.NO */ process.env.LAST_' || user_id END AS content FROM {events}""")


@query(f"WITH {SCRIPTS.cte()} " + """SELECT DISTINCT path, name FROM (SELECT path, unnest(regexp_extract_all(content, '//[^\\n]*|/\\*(?:[^*]|\\*[^/])*\\*/|''(?:[^''\\\\\\n]|\\\\.)*''|"(?:[^"\\\\\\n]|\\\\.)*"|`(?:[^`\\\\]|\\\\.)*`|(?:process\\.env\\.|import\\.meta\\.env\\.)([A-Z][A-Z0-9_]*)', 1)) AS name FROM scripts) WHERE name <> ''""")
def env_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.env_reads(SCRIPTS.df(spark, sf_dir), "path", "content")


_IMPORT = "(SELECT src, unnest(regexp_extract_all(content, '{0}', 1)) AS target, {1} AS dynamic FROM (SELECT path AS src, content FROM scripts))"
_FORMS = (("import\\s+(?:[^''\"\\n;]+?\\s+from\\s+)?[''\"]([^''\"]+)[''\"]", "false"), ("require\\(\\s*[''\"]([^''\"]+)[''\"]\\s*\\)", "false"), ("import\\(\\s*[''\"]([^''\"]+)[''\"]\\s*\\)", "true"))


@query(f"WITH {SCRIPTS.cte()} SELECT * FROM " + " UNION ALL SELECT * FROM ".join(_IMPORT.format(p, d) for p, d in _FORMS))
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.imports(SCRIPTS.df(spark, sf_dir), "path", "content")


LAYERED = Derived("layered", """SELECT event_type || '/u' || user_id AS src, CASE user_id % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'error' WHEN 2 THEN 'core' ELSE 'click' END || '/k' || (event_id % 10) AS dst FROM {events}""")
FORBIDDEN = Derived("forbidden", """SELECT DISTINCT event_type AS layer, CASE event_type WHEN 'view' THEN 'error' WHEN 'click' THEN 'view' ELSE 'click' END AS other FROM {events}""")


@query(f"WITH {LAYERED.cte()}, {FORBIDDEN.cte()} SELECT src, dst FROM layered JOIN forbidden ON layer = split_part(src, '/', 1) AND other = split_part(dst, '/', 1)")
def layer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.layer_violations(LAYERED.df(spark, sf_dir), FORBIDDEN.df(spark, sf_dir))


CLAIMS = Derived("claims", """SELECT 'p' || p_partkey AS doc, 'It has ' || p_size || ' validators and 3 commands. version: 2.' || (p_size % 7) || '.' || (p_partkey % 3) || CASE WHEN p_size = 50 THEN ', 99999999999999999999 commands, version: 2.99999999999.0 or @2.1.99999999999' ELSE '' END AS content FROM {part}""")


@query(f"""WITH {CLAIMS.cte()}, v AS (SELECT DISTINCT doc, unnest(regexp_extract_all(content, '(?:version:[ \\t]*|@v?|/tags/v|/releases/v)([0-9]+\\.[0-9]+\\.[0-9]+)', 1)) AS version FROM claims)
    SELECT doc, version FROM v WHERE split_part(version, '.', 1) = '2' AND (split_part(version, '.', 2)::HUGEINT, split_part(version, '.', 3)::HUGEINT) < (4, 0)""")
def stale_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.stale_versions(CLAIMS.df(spark, sf_dir), "doc", "content", (2, 4, 0))


@query(f"""WITH {CLAIMS.cte()}, r AS (SELECT DISTINCT doc, unnest(regexp_extract_all(content, '(?:^|[^0-9/.])([0-9]+ (?:commands|validators))(?:[^A-Za-z]|$)', 1)) AS raw FROM claims),
    x AS (SELECT doc, split_part(raw, ' ', 2) AS noun, split_part(raw, ' ', 1) AS claimed FROM r), y AS (SELECT *, CAST(CASE noun WHEN 'validators' THEN 27 ELSE 3 END AS BIGINT) AS actual FROM x)
    SELECT * FROM y WHERE TRY_CAST(claimed AS BIGINT) IS DISTINCT FROM actual""")
def count_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.count_claims(CLAIMS.df(spark, sf_dir), "doc", "content", {"validators": 27, "commands": 3})


APPLIED = Derived("applied", """SELECT 'replace-' || event_type AS type, 'u' || (user_id % 20) || '.md' AS file, props AS summary FROM {events} WHERE value > 15""")
CANDIDATES = Derived("candidates", """SELECT DISTINCT 'replace-' || event_type AS type, 'u' || (user_id % 20) || '.md' AS file, props AS summary FROM {events}""")


@query(f"""WITH {APPLIED.cte()}, {CANDIDATES.cte()} SELECT type, file, summary, sha256(type || '|' || file || '|' || summary)[1:12] AS mark FROM candidates c
    WHERE (SELECT count(*) FROM applied a WHERE a.type = c.type AND a.file = c.file AND a.summary = c.summary) < 2""")
def fix_pingpong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.repeated_fixes(APPLIED.df(spark, sf_dir), CANDIDATES.df(spark, sf_dir))


_ALARMS = Derived("alarms", "SELECT event_type AS code, CASE WHEN value > 90 THEN 'error' ELSE 'warn' END AS severity, 'value \"' || user_id || '\"' AS message, 'src/u' || (user_id % 7) || '.py' AS path, CAST(event_id AS INT) AS line FROM {events} WHERE value > 60")


@query(f"""WITH {_ALARMS.cte()} SELECT code, '{{"ruleId":"' || code || '","level":"' || CASE severity WHEN 'error' THEN 'error' ELSE 'warning' END || '","message":{{"text":"' || replace(message, '"', '\\"') || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || path || '"}},"region":{{"startLine":' || line || '}}}}}}]}}' AS result FROM alarms""")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.sarif_results(_ALARMS.df(spark, sf_dir)).select("code", "result")


@query(None)
def sarif_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = governance.first_by(_ALARMS.df(spark, sf_dir), ["code", "severity"], ["line"])
    return governance.sarif(first)


@query("SELECT * EXCLUDE (n) FROM (SELECT event_type, event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.first_by(_t(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"]).select("event_type", "event_id", "user_id")

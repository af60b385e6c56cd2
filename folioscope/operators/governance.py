"""Coverage, scores, rules and reports over small fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The weight of each score category.
WEIGHTS = {"structure": 25, "docQuality": 20, "testing": 15, "security": 10, "environment": 10, "drift": 10, "changelog": 5, "architecture": 5}
ENV_LEXER = r"""//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/|'(?:[^'\\\n]|\\.)*+'|"(?:[^"\\\n]|\\.)*+"|`(?:[^`\\]|\\.)*+`|(?:process\.env\.|import\.meta\.env\.)([A-Z][A-Z0-9_]*)"""


def weighted_score(checks: DataFrame, owner: str) -> DataFrame:
    """``owner, score``: points met of each category, weighted; rows ``owner, category, met, points``."""
    by = checks.groupBy(owner, "category").agg((F.sum(F.when(F.col("met"), F.col("points")).otherwise(0)) / F.sum("points") * 100).alias("part"))
    weight = F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return by.groupBy(owner).agg(F.floor(F.sum(F.col("part") / 100 * weight[F.col("category")]) + 0.5).cast("long").alias("score"))


def doc_tax(docs: Column, commits: Column, quality: Column) -> Column:
    """Minutes a week that the documents cost, five at least."""
    churn = F.when(commits > 50, 1.5).when(commits > 20, 1.2).otherwise(1.0)
    discount = F.when(quality > 80, 0.7).when(quality > 60, 0.85).otherwise(1.0)
    return F.greatest(F.lit(5), F.floor(docs * 3 * churn * discount * 0.3 + 0.5)).cast("long")


def accuracy(compared: DataFrame) -> DataFrame:
    """Share of keys that match (null without keys), from the states of a set drift."""
    n = F.count(F.lit(1))
    return compared.agg(n.alias("n"), F.round(F.count_if(F.col("state") == "matched") / F.when(n > 0, n), 4).alias("accuracy"))


def coverage_tier(path: Column) -> Column:
    return (
        F.when(path.rlike("^docs-canonical/"), "canonical").when(path.rlike("(^|/)(node_modules|dist|build)/"), "ignored")
        .when(path.rlike(r"\.(md|mdx|rst)$"), "tracked").otherwise("unclassified")
    )


def requirement_coverage(requirements: DataFrame, references: DataFrame, key: str = "req_id") -> DataFrame:
    """``key, code``: requirements that no test names, and names of no requirement."""
    r, x = requirements.select(key).distinct(), references.select(key).distinct()
    return r.join(x, key, "left_anti").withColumn("code", F.lit("TRC004")).unionByName(x.join(r, key, "left_anti").withColumn("code", F.lit("TRC005")))


def requirement_ids(df: DataFrame, key: str, text: str) -> DataFrame:
    """``req_id, key``: the first place of each requirement id."""
    found = df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?:^|[^A-Za-z0-9-])((?:REQ|FR|NFR|US|UC|AC|SC|SYS|ARCH|MOD|STORY)-[0-9]{1,5})"), F.lit(1))).alias("req_id"))
    return found.groupBy("req_id").agg(F.min(key).alias(key))


def traced(docs: DataFrame, sources: DataFrame, tests: DataFrame, key: str = "doc") -> DataFrame:
    """``key, state``: MISSING, UNLINKED, PARTIAL (sources only) or TRACED."""
    out = docs.join(sources.groupBy(key).agg(F.count(F.lit(1)).alias("_s")), key, "left").join(tests.groupBy(key).agg(F.count(F.lit(1)).alias("_t")), key, "left")
    state = F.when(~F.col("present"), "MISSING").when(F.col("_s").isNull(), "UNLINKED").when(F.col("_t").isNull(), "PARTIAL").otherwise("TRACED")
    return out.select(key, state.alias("state"))


def env_reads(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, name``: environment variables read in code, not in its comments and strings."""
    names = F.array_distinct(F.filter(F.regexp_extract_all(F.col(text), F.lit(ENV_LEXER), F.lit(1)), lambda x: x != ""))
    return df.select(key, F.explode(names).alias("name"))


def imports(df: DataFrame, key: str, text: str) -> DataFrame:
    """``src, target, dynamic`` of the import forms of a script."""
    forms = ((r"""import\s+(?:[^'"\n;]+?\s+from\s+)?['"]([^'"]+)['"]""", False), (r"""require\(\s*['"]([^'"]+)['"]\s*\)""", False), (r"""import\(\s*['"]([^'"]+)['"]\s*\)""", True))
    each = [F.transform(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)), _target(dynamic)) for p, dynamic in forms]
    return df.select(F.col(key).alias("src"), F.explode(F.concat(*each)).alias("x")).select("src", "x.target", "x.dynamic")


def _target(dynamic: bool):
    return lambda x: F.struct(x.alias("target"), F.lit(dynamic).alias("dynamic"))


def layer_violations(edges: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Edges from a layer to one that it must not import; layers are first path segments."""
    layered = edges.select("src", "dst", F.substring_index("src", "/", 1).alias("layer"), F.substring_index("dst", "/", 1).alias("other"))
    return layered.join(forbidden.select("layer", "other"), ["layer", "other"], "left_semi").select("src", "dst")


def stale_versions(df: DataFrame, key: str, text: str, current: tuple[int, int, int]) -> DataFrame:
    """``key, version``: older versions of the current major one."""
    found = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(?:version:[ \t]*|@v?|/tags/v|/releases/v)([0-9]+\.[0-9]+\.[0-9]+)"), F.lit(1)))).alias("version"))
    parts = [F.try_to_number(x, F.lit("9" * 38)) for x in (F.split("version", r"\.")[k] for k in range(3))]  # of any length; beyond 38 digits null
    triple = F.struct(*[x.alias(f"p{k}") for k, x in enumerate(parts)])
    now = F.struct(*[F.lit(x).cast("decimal(38,0)").alias(f"p{k}") for k, x in enumerate(current)])
    return found.where((parts[0] == current[0]) & (triple < now))


def count_claims(df: DataFrame, key: str, text: str, actual: dict[str, int]) -> DataFrame:
    """``key, noun, claimed, actual``: numbers claimed of a noun, as they are written, that aren't its count; each once."""
    nouns = "|".join(sorted(actual))
    raw = F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(rf"(?:^|[^0-9/.])([0-9]+ (?:{nouns}))(?:[^A-Za-z]|$)"), F.lit(1)))).alias("raw")
    known = F.create_map(*[x for k, v in actual.items() for x in (F.lit(k), F.lit(v))])
    x = df.select(key, raw).select(key, F.substring_index("raw", " ", -1).alias("noun"), F.substring_index("raw", " ", 1).alias("claimed"))
    return x.withColumn("actual", known[F.col("noun")].cast("long")).where("NOT try_cast(claimed AS BIGINT) <=> actual")


def repeated_fixes(applied: DataFrame, candidates: DataFrame, most: int = 2) -> DataFrame:
    """Candidate fixes without those that were applied ``most`` times already (by type, file and summary)."""
    mark = F.substring(F.sha2(F.concat_ws("|", "type", "file", "summary"), 256), 1, 12).alias("mark")
    done = applied.select(mark).groupBy("mark").count().where(F.col("count") >= most)
    return candidates.select("*", mark).join(done, "mark", "left_anti")


def _sarif_result() -> Column:
    level = F.when(F.col("severity") == "error", "error").otherwise("warning").alias("level")
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations")
    return F.struct(F.col("code").alias("ruleId"), level, F.struct(F.col("message").alias("text")).alias("message"), place)


def sarif_results(findings: DataFrame) -> DataFrame:
    """``findings`` (``code, severity, message, path, line``) with ``result``: each as a result of a SARIF 2.1.0 log, whatever their number."""
    return findings.withColumn("result", F.to_json(_sarif_result()))


def sarif(findings: DataFrame) -> DataFrame:
    """One row: the findings as a SARIF 2.1.0 log, for reports of findings, which are few; ``sarif_results`` has a row for each."""
    rules = F.array_sort(F.collect_set(F.struct(F.col("code").alias("id"))))
    run = F.struct(F.struct(F.struct(F.lit("folioscope").alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), F.array_sort(F.collect_list(_sarif_result())).alias("results"))
    return findings.agg(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")

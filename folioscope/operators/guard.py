"""A run of validators: what a baseline suppresses, what remains, and how the run ends; secrets with their exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint, trimmed
from .extract import SECRETS
from .findings import classified, weighted

#: Lines whose match is an example, by the reading of the scan.
SAFE_LINES = (r"(?i)example", r"(?i)placeholder[ \t]*=[ \t]*[\"']", r"['\"]password123['\"]", r"<!--.*-->")


def run(results: DataFrame, findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """``validator, severity, errors, warnings, passed, total, suppressed, status, quality`` and the effective counts.

    ``results``: ``place, validator, severity, errors, warnings, passed, total, applicable, skipped, threw``;
    ``findings``: ``validator, seq, severity, code, location, message``; ``baseline``: ``fingerprint, budget``.
    One that threw is one failed check. A baseline only counts where every error and
    warning is a finding; a budget is used up in the order of validators and findings.
    """
    threw, live = F.col("threw").isNotNull(), ~F.coalesce("skipped", F.lit(False))
    count = lambda c, if_threw: F.when(~live, 0).when(threw, if_threw).otherwise(F.col(c)).cast("long").alias(c)
    base = results.select("place", "validator", "severity", (~live).alias("skipped"), (threw & live).alias("threw"), count("errors", 1), count("warnings", 0), count("passed", 0), count("total", 1), "applicable")
    by = findings.groupBy("validator").agg(F.count(F.lit(1)).alias("n"))
    open_to_it = base.join(by, "validator").where("NOT skipped AND NOT threw AND errors + warnings = n").select("validator", "place")
    marked = findings.join(open_to_it, "validator").withColumn("fingerprint", fingerprint(F.col("code"), F.col("location"), F.col("message")))
    held = marked.join(baseline.groupBy("fingerprint").agg(F.max("budget").alias("budget")), "fingerprint")
    used = F.row_number().over(Window.partitionBy("fingerprint").orderBy("place", "seq")) <= F.col("budget")
    gone = held.withColumn("used", used).where("used").groupBy("validator").agg(F.count_if(F.col("severity") == "error").alias("_e"), F.count_if(F.coalesce(F.col("severity") != "error", F.lit(True))).alias("_w"))
    left = base.join(gone, "validator", "left").withColumns({"_e": F.coalesce("_e", F.lit(0)), "_w": F.coalesce("_w", F.lit(0))})
    removed = F.col("_e") + F.col("_w")
    left = left.withColumns({"errors": F.col("errors") - F.col("_e"), "warnings": F.col("warnings") - F.col("_w"), "suppressed": removed})
    left = left.withColumn("total", F.when(removed > 0, F.col("passed") + F.col("errors") + F.col("warnings")).otherwise(F.col("total")))
    severity = F.when(F.col("severity").isin("high", "low"), F.col("severity")).otherwise("medium")
    out = weighted(classified(left).withColumn("severity", severity))
    status, quality = F.when(F.col("skipped"), "skipped").otherwise(F.col("status")), F.when(~F.col("skipped"), F.col("quality"))
    return out.select("place", "validator", "severity", "errors", "warnings", "passed", "total", "suppressed", status.alias("status"), quality.alias("quality"), "effective_errors", "effective_warnings")


def outcome(rows: DataFrame) -> DataFrame:
    """One row: the sums over validators that weren't skipped, and the status that the exit code follows."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    total = rows.where("status <> 'skipped'").agg(*map(n, ("errors", "warnings", "passed", "total", "suppressed", "effective_errors", "effective_warnings")))
    return total.withColumn("status", F.when(F.col("effective_errors") > 0, "FAIL").when(F.col("effective_warnings") > 0, "WARN").otherwise("PASS"))


def pragma_suppresses(line: Column, code: Column, pragma: str) -> Column:
    """Whether a line holds ``pragma`` for a code: bare, ``-secret``, or a list of codes, ``SEC*`` and ``all``."""
    pattern = rf"(?i){pragma}(-secret)?\b[ \t]*([A-Za-z0-9_,*-]+)?"
    asked = F.filter(F.split(F.upper(F.regexp_extract(line, pattern, 2)), ","), lambda x: x != "")
    hit = F.exists(asked, lambda x: (x == "ALL") | (x == F.upper(code)) | (x.endswith("*") & F.startswith(F.upper(code), F.regexp_replace(x, r"\*$", ""))))
    secret = F.regexp_extract(line, pattern, 1) != ""
    bare = F.regexp_extract(line, pattern, 2) == ""
    return F.coalesce(line.rlike(pattern) & F.when(secret, F.upper(code).startswith("SEC")).otherwise(bare | hit), F.lit(False))


def secret_findings(df: DataFrame, key: str, text: str, pragma: str = "folioscope:ignore") -> DataFrame:
    """``key, line, code, severity, confidence``: the first secret of each kind in a text.

    Matches that are examples are passed over, and one under a pragma (on its line or the
    one before) ends the search for its kind. A value of three words, or two that end a
    sentence, is a warning. Texts without any match are not shuffled.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    kinds = [F.struct(F.lit(c).alias("code"), F.split(whole, p, -1).alias("parts"), F.regexp_extract_all(whole, F.lit(p), F.lit(0)).alias("hits")) for c, p in SECRETS.items()]
    lines = df.select(key, F.split(whole, "\n", -1).alias("lines"), F.explode(F.filter(F.array(*kinds), lambda k: F.size(k["hits"]) > 0)).alias("k"))
    each = lines.select(key, "lines", "k.code", F.posexplode(F.zip_with("k.hits", F.slice("k.parts", 1, F.size("k.hits")), lambda h, p: F.struct(h.alias("hit"), p.alias("part")))).alias("place", "x"))
    feeds = lambda c: F.length(F.regexp_replace(c, "[^\n]", ""))
    w = Window.partitionBy(key, "code").orderBy("place")
    before = F.sum(feeds(F.col("x.part"))).over(w) + F.coalesce(F.sum(feeds(F.col("x.hit"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = each.withColumn("line", (before + 1).cast("int"))
    here, above = F.element_at("lines", F.col("line")), F.when(F.col("line") > 1, F.element_at("lines", F.greatest(F.col("line") - 1, F.lit(1)))).otherwise("")
    at = at.select(key, "code", "place", "line", F.col("x.hit").alias("hit"), here.alias("here"), above.alias("above"))
    safe = F.col("hit").rlike(SAFE_LINES[0])
    for pattern in SAFE_LINES:
        safe = safe | F.col("here").rlike(pattern)
    first = at.where(~safe).withColumn("n", F.row_number().over(w)).where("n = 1")
    kept = first.where(~pragma_suppresses(F.col("here"), F.col("code"), pragma) & ~pragma_suppresses(F.col("above"), F.col("code"), pragma))
    value = trimmed(F.regexp_extract("hit", "['\"]([^'\"]*)['\"]", 1))
    words = F.size(F.filter(F.split(value, r"[ \t\r\n\f\x0B]+"), lambda x: x != ""))
    is_prose = (words >= 3) | ((words >= 2) & value.rlike("[.!?]$"))
    return kept.select(key, F.col("line").cast("long").alias("line"), "code", F.when(is_prose, "warn").otherwise("error").alias("severity"), F.when(is_prose, "low").otherwise("high").alias("confidence"))

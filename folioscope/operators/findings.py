"""Findings: classification, severity, suppression against a baseline, summaries, grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint


def classified(results: DataFrame) -> DataFrame:
    """Adds ``status`` and ``quality`` to rows of ``errors, warnings, passed, total, applicable``.

    Nothing found where nothing applied is ``na``, not a pass.
    """
    clean = (F.col("errors") == 0) & (F.col("warnings") == 0)
    na = clean & (~F.coalesce("applicable", F.lit(True)) | (F.col("total") == 0))
    status = F.when(na, "na").when(F.col("errors") > 0, "fail").when(F.col("warnings") > 0, "warn").otherwise("pass")
    ratio = F.col("passed") / F.when(F.col("total") > 0, F.col("total"))
    quality = F.when(na, F.lit(None)).when(F.col("errors") > 0, "LOW").when(F.col("warnings") > 0, "MEDIUM").when(ratio >= 0.9, "HIGH").otherwise("MEDIUM")
    return results.withColumns({"status": status, "quality": quality.cast("string")})


def weighted(results: DataFrame, severity: str = "severity") -> DataFrame:
    """High severity makes errors of warnings, low drops them; others keep them."""
    high, low = F.col(severity) == "high", F.col(severity) == "low"
    return results.withColumns(
        {
            "effective_errors": F.col("errors") + F.when(high, F.col("warnings")).otherwise(0),
            "effective_warnings": F.when(high | low, 0).otherwise(F.col("warnings")).cast("long"),
        }
    )


def unsuppressed(findings: DataFrame, baseline: DataFrame, order: str) -> DataFrame:
    """Findings beyond the number that the baseline holds for their fingerprint, in order."""
    marked = findings.withColumn("fingerprint", fingerprint(F.col("code"), F.col("location"), F.col("message")))
    n = F.row_number().over(Window.partitionBy("fingerprint").orderBy(order))
    held = marked.withColumn("_n", n).join(baseline.select("fingerprint", F.col("budget").alias("_budget")), "fingerprint", "left")
    return held.where(F.col("_n") > F.coalesce("_budget", F.lit(0))).drop("_n", "_budget")


def summary(findings: DataFrame, order: str) -> DataFrame:
    """``code, n, message`` (of the first by order), most frequent first."""
    return findings.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min_by("message", order).alias("message")).orderBy(F.desc("n"), "code")


def grade(score: Column) -> Column:
    return F.when(score >= 95, "A+").when(score >= 80, "A").when(score >= 65, "B").when(score >= 50, "C").when(score >= 30, "D").otherwise("F")


def renormalised(signals: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """Weighted mean over the signals that apply (are not null), and the weakest of them."""
    top = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    below = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    weakest = F.array_min(F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.lit(k).alias("k"), F.lit(c).alias("name"))) for k, c in enumerate(weights)]), lambda x: x.isNotNull()))
    return signals.select(key, F.round(top / F.when(below > 0, below), 4).alias("score"), weakest["name"].alias("weakest"))


def trend(history: DataFrame, order: str, score: str, last: int = 10) -> DataFrame:
    """One row: first and latest score of the last entries, and their difference."""
    tail = history.orderBy(F.desc(order)).limit(last)
    return tail.agg(F.min_by(score, order).alias("first"), F.max_by(score, order).alias("latest"), F.count(F.lit(1)).alias("entries")).withColumn("delta", F.round(F.col("latest") - F.col("first"), 4))


def spark_bucket(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(7), F.floor(score / 100 * 8))).cast("long")

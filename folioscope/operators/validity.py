"""What was there at a time and is not there now: as-of lookups in a log of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A code name among prose words has an inner capital, an underscore or two capitalised parts.
COMPOUND = r"[a-z][A-Z]|_|^[A-Z][a-z]+[A-Z]"
#: How decision records are cited, and comment marks that such a citation follows.
CITATION = r"\bADR[- ]?([0-9]{1,5})\b"
WHOLE_COMMENT = r"^[ \t]*(//|/\*|\*|#|--|<!--)"
COMMENT_MARKS = ("//", "/*", "<!--", " # ", " -- ")


def code_names(text: Column) -> Column:
    """The code names that a text holds in backticks, in order, each once; flags and plain words are none."""
    ticked = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("`([^`\n]{2,80})`"), F.lit(1))
    cut = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"\(.*$", ""), "[.,;:]+$", ""))
    named = lambda x: x.rlike("^[A-Za-z_][A-Za-z0-9_]{3,79}$") & x.rlike(COMPOUND)
    plain = F.filter(ticked, lambda x: ~F.trim(x).startswith("-"))
    return F.array_distinct(F.filter(F.transform(plain, cut), named))


def cited_records(lines: DataFrame, key: str) -> DataFrame:
    """``key, line, number``: decision records cited in comments of code; ``lines``: ``key, line, content``."""
    marks = [F.when(F.instr("content", m) > 0, F.instr("content", m)) for m in COMMENT_MARKS]
    begins = F.when(F.col("content").rlike(WHOLE_COMMENT), 1).otherwise(F.least(*marks))
    comment = F.substring(F.col("content"), begins, F.length("content"))
    cited = lines.where(F.col("content").contains("ADR")).where(begins.isNotNull()).select(key, "line", F.explode(F.regexp_extract_all(comment, F.lit(CITATION), F.lit(1))).alias("n"))
    return cited.select(key, "line", F.col("n").cast("int").alias("number"))


def undefined_records(cited: DataFrame, defined: DataFrame, key: str) -> DataFrame:
    """``number, file, line, n``: cited numbers that no record defines, with the first place and the number of places."""
    first = cited.groupBy("number").agg(F.min(F.struct(key, "line")).alias("at"), F.count(F.lit(1)).alias("n"))
    return first.join(defined.select("number").distinct(), "number", "left_anti").select("number", F.col(f"at.{key}").alias("file"), F.col("at.line").alias("line"), "n")


def as_of(asked: DataFrame, changes: DataFrame, key: str, at: str, value: str, unit: str = "day") -> DataFrame:
    """``asked`` with ``value``: that of the last change of its key at or before its time; null where there is none.

    Each change holds until the next one. Time is cut into slices of ``unit``: within
    the slice of a question the changes before it are seen in order, and what holds
    when a slice begins is the last change of an earlier one. So a key with most of the
    changes is as many groups as it has slices, and no question meets a range of changes.
    Of changes at one instant the greatest value counts. Null keys and times find nothing.
    """
    slot = F.date_trunc(unit, at)
    made = changes.select(key, F.col(at).alias("_at"), F.col(value).alias("_v")).where(F.col(key).isNotNull() & F.col("_at").isNotNull())
    ids = [c for c in asked.columns if c != value]
    q = asked.select(F.col(key), F.col(at).alias("_at"), F.struct(*ids).alias("_q"))
    log = made.groupBy(key, "_at").agg(F.max("_v").alias("_v"))
    rows = log.select(key, "_at", "_v", F.lit(None).cast(q.schema["_q"].dataType).alias("_q")).unionByName(q.select(key, "_at", F.lit(None).cast(log.schema["_v"].dataType).alias("_v"), "_q"))
    rows = rows.withColumn("_slot", F.date_trunc(unit, "_at"))
    within = Window.partitionBy(key, "_slot").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("_here", F.max(F.when(F.col("_v").isNotNull(), F.struct("_at", "_v"))).over(within)).where("_q IS NOT NULL")
    ends = log.groupBy(key, F.date_trunc(unit, "_at").alias("_slot")).agg(F.max(F.struct("_at", "_v")).alias("_last"))
    slots = ends.unionByName(seen.where("_here IS NULL").select(key, "_slot").distinct().withColumn("_last", F.lit(None).cast(ends.schema["_last"].dataType)))
    slots = slots.groupBy(key, "_slot").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    held = slots.select(F.col(key), "_slot", F.max("_last").over(before).alias("_before"))  # a row a key and slice
    found = seen.join(held, [key, "_slot"], "left")
    return found.select("_q.*", F.coalesce("_here._v", "_before._v").alias(value))


def dangling(refs: DataFrame, changes: DataFrame, most: int = 80) -> DataFrame:
    """``doc, symbol``: names that were there when their document last changed and are gone now.

    ``refs``: ``doc, symbol, at, place`` (the first ``most`` places of a document count);
    ``changes``: ``symbol, at, present``. Names that are there now, and those that never
    were when the document changed, are none; so are documents without a time.
    """
    now = changes.where("at IS NOT NULL").groupBy("symbol").agg(F.max_by("present", F.struct("at", "present")).alias("present"))
    gone = now.where("NOT present").select("symbol")
    asked = refs.where((F.col("place") < most) & F.col("at").isNotNull()).select("doc", "symbol", "at").distinct().join(gone, "symbol", "left_semi")
    return as_of(asked, changes.join(gone, "symbol", "left_semi"), "symbol", "at", "present").where("present").select("doc", "symbol")

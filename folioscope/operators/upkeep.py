"""What upkeep needs: notes that nothing tracks, deviations that no log holds, marks in files and documents, imports resolved, documents gone stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_index
from .extract import later_than
from .markdown import joined_path


def untracked_todos(todos: DataFrame, docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``todos`` (``path, line, kind, note``) that no tracking document holds.

    A document tracks a note when it holds its text in whatever case (of more than 20
    characters the first 40) and either names its file or the text has more than 30.
    """
    said = F.lower(F.trim(F.coalesce("note", F.lit(""))))
    t = todos.withColumn("_said", said).withColumn("_sought", F.when(F.length("_said") > 20, F.substring("_said", 1, 40)).otherwise(F.col("_said")))
    low = docs.select(F.col(doc).alias("_doc"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    texts = text_index.found_in(low, ["_doc"], "_low", t, "_sought").select("_doc", F.col("pattern").alias("_sought"))
    named = text_index.found_in(docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")), ["_doc"], "_text", t, "path").select("_doc", F.col("pattern").alias("path"))
    long = t.where(F.length("_said") > 30).join(texts.select("_sought").distinct(), "_sought", "left_semi").select("path", "line")
    # files meet the few documents that name them first: a text as such may stand in many documents and many notes
    near = t.where((F.length("_said") <= 30) & (F.col("_said") != "")).select("path", "_sought").distinct().join(named, "path")
    short = t.join(near.join(texts, ["_doc", "_sought"], "left_semi").select("path", "_sought").distinct(), ["path", "_sought"], "left_semi").where("length(_said) <= 30").select("path", "line")
    empty = t.where(F.col("_said") == "").join(named.select("path").distinct(), "path", "left_semi").select("path", "line")
    tracked = long.unionByName(short).unionByName(empty).distinct()
    return t.drop("_said", "_sought").join(tracked, ["path", "line"], "left_anti").select(*todos.columns)


def unlogged_drift(comments: DataFrame, log: DataFrame, text: str) -> DataFrame:
    """``comments`` (``path, line, ...``) of files that the log of deviations doesn't name."""
    missing = text_index.unnamed(comments.select("path"), log, "path", text)
    return comments.join(missing, "path", "left_semi")


#: How a file says which document describes it, and how far from its start.
ANNOTATION, HEAD = r"(?://|/\*|#)[ \t\r\n\f]*@doc[ \t\r\n\f]+([^ \t\r\n\f]+\.md)", 4096
CODE = r"\.(?:js|mjs|cjs|ts|tsx|jsx|py|rb|go|rs|java)$"


def doc_annotations(files: DataFrame, path: str, text: str) -> DataFrame:
    """``doc, path``: documents (by base name) that code files name in a ``@doc`` comment near their start, each pair once."""
    head = F.substring(F.col(text), 1, HEAD)
    code = files.where(F.col(path).rlike(CODE) & F.contains(head, F.lit("@doc")))
    found = code.select(F.col(path).alias("path"), F.explode(F.regexp_extract_all(head, F.lit(ANNOTATION), F.lit(1))).alias("doc"))
    return found.select(text_index.base_name(F.col("doc")).alias("doc"), "path").distinct()


def _plain_key(x) -> F.Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def na_markers(docs: DataFrame, doc: str, text: str, keys: DataFrame, mark: str = "folioscope") -> DataFrame:
    """``doc, raw, key, reason``: comments that say of a validator that it doesn't apply; ``key`` is null for one that isn't known.

    Keys are compared without case and marks. Of a known one the first document counts, by name.
    """
    form = rf"(?i)<!--\s*{mark}:validator\s+([A-Za-z0-9_-]+)\s+n/a\b\s*(?:[—:\-]+\s*([^>]*?))?\s*-->"
    held = docs.where(F.contains(F.lower(F.col(text)), F.lit(f"{mark}:validator")))
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(form), F.lit(1)).alias("raw"), F.regexp_extract_all(F.col(text), F.lit(form), F.lit(2)).alias("reason"))
    each = held.select(F.col(doc).alias("doc"), F.posexplode(pairs).alias("place", "x")).select("doc", "place", "x.raw", F.trim(F.coalesce("x.reason", F.lit(""))).alias("reason"))
    known = keys.select("key", _plain_key(F.col("key")).alias("_plain")).distinct()
    marked = each.withColumn("_plain", _plain_key(F.col("raw"))).join(known, "_plain", "left")
    unknown = marked.where("key IS NULL").select("doc", "raw", "key", "reason")
    first = marked.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc", "place", "raw", "reason")).alias("m"))
    return unknown.unionByName(first.select("m.doc", "m.raw", "key", "m.reason"))


def quality_overrides(docs: DataFrame, doc: str, text: str, mark: str = "folioscope") -> DataFrame:
    """``doc, rule, off, threshold``: the first override of each rule in each document."""
    form = rf"(?i)<!--\s*{mark}:quality\s+([A-Za-z0-9_-]+)\s+(off|[0-9]*\.?[0-9]+)\b"
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(form), F.lit(1)).alias("rule"), F.regexp_extract_all(F.col(text), F.lit(form), F.lit(2)).alias("value"))
    each = docs.select(F.col(doc).alias("doc"), F.posexplode(pairs).alias("place", "x")).groupBy("doc", "x.rule").agg(F.min_by("x.value", "place").alias("value"))
    off = F.lower("value") == "off"
    return each.select("doc", "rule", off.alias("off"), F.when(~off, F.col("value").cast("double")).alias("threshold"))


#: Endings that an import may leave out, in the order in which they are tried.
ENDINGS = (".ts", ".tsx", ".js", ".mjs", ".jsx", ".cjs")


def resolved_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """``src, target, path``: the file that a relative import means, null if there is none; ``edges``: ``src, target``.

    Tried are the path with each ending, the path itself, then an index file in it; the first that is there counts.
    """
    each = edges.select("src", "target").where(F.col("target").startswith(".")).distinct()
    base = joined_path(F.regexp_extract("src", "^(.*/)[^/]*$", 1), F.col("target"))
    ways = [F.concat("base", F.lit(e)) for e in ENDINGS] + [F.col("base")] + [F.concat("base", F.lit(f"/index{e}")) for e in ENDINGS]
    tried = each.withColumn("base", base).select("src", "target", F.posexplode(F.array(*ways)).alias("place", "path"))
    hit = tried.join(files.select("path").distinct(), "path", "left_semi").groupBy("src", "target").agg(F.min_by("path", "place").alias("path"))
    return each.join(hit, ["src", "target"], "left").select("src", "target", "path")


def stale_documents(docs: DataFrame, commits: DataFrame, commits_since: int = 10, days: int = 30) -> DataFrame:
    """``doc, code, later, behind``: documents without a date (FRS001), with many commits since (FRS002), or far behind the latest commit (FRS003).

    ``docs``: ``doc, reviewed`` (a date), ``committed, status``; ``commits``: ``committed``. A
    date of review goes before that of the last commit and covers its whole day. A
    document without a date that is approved is none; nor is any under three commits.
    """
    date = F.coalesce(F.col("reviewed").cast("timestamp"), F.col("committed").cast("timestamp"))
    since = F.when(F.col("reviewed").isNotNull(), F.col("reviewed").cast("timestamp") + F.expr("INTERVAL 1 DAY - INTERVAL 1 SECOND")).otherwise(date)
    d = docs.select("doc", date.alias("date"), since.alias("reviewed"), "status")
    later = later_than(commits, d.select("doc", "reviewed"))
    now = commits.agg(F.max(F.col("committed").cast("timestamp")).alias("now"), F.count("committed").alias("n"))  # one row
    x = d.join(later, "doc").crossJoin(F.broadcast(now)).where("n >= 3")
    behind = F.floor((F.unix_micros("now") - F.unix_micros("date")) / 86_400_000_000)
    code = F.when(F.col("date").isNull(), F.when(~F.col("status").eqNullSafe("approved"), "FRS001")).when(F.col("later") >= commits_since, "FRS002").when(behind > days, "FRS003")
    return x.select("doc", code.alias("code"), "later", behind.cast("long").alias("behind")).where("code IS NOT NULL")

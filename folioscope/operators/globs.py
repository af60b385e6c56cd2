"""Tables of globs against tables of paths, met on what is literal in a glob.

A glob begins or ends with literal text; the longer of both is its key. A path can
only fit where it begins (or ends) with that text, so it is cut to each length that
a key has, and both sides meet on equal text. Only then is the pattern tried. A glob
without literal ends meets every path, as it must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_pattern(glob: Column) -> Column:
    """A regular expression for a glob, in which any run of ``*`` stands for any characters."""
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(glob, r"[.+?^${}()|\[\]\\]", r"\\$0"), r"\*+", ".*"), F.lit("$"))


def matches(globs: DataFrame, paths: DataFrame, glob: str = "glob", path: str = "path") -> DataFrame:
    """``glob, path``: which paths fit which globs, each pair once.

    A glob with a slash is held against the whole path, one without against the base
    name. Null and blank globs fit nothing.
    """
    entry = F.trim(F.col(glob))
    g = globs.select(F.col(glob).alias("glob"), entry.alias("entry")).where("entry <> ''").distinct()
    begin, end = F.regexp_extract("entry", r"^([^*]*)", 1), F.regexp_extract("entry", r"([^*]*)$", 1)
    at_end = F.length(end) > F.length(begin)
    g = g.select("glob", glob_pattern(F.col("entry")).alias("pattern"), F.contains("entry", F.lit("/")).alias("whole"), at_end.alias("at_end"), F.when(at_end, end).otherwise(begin).alias("key"))
    cuts = g.select("whole", "at_end", F.length("key").alias("n")).distinct()  # by length of a key: few rows, whatever the number of globs
    p = paths.select(F.col(path).alias("path")).where("path IS NOT NULL").distinct()
    subject = F.when(F.col("whole"), F.col("path")).otherwise(F.regexp_replace("path", "^.*/", ""))
    cut = p.join(F.broadcast(cuts)).withColumn("subject", subject).where(F.length("subject") >= F.col("n"))
    key = F.when(F.col("n") == 0, "").when(F.col("at_end"), F.expr("right(subject, n)")).otherwise(F.expr("left(subject, n)"))
    near = cut.select("path", "subject", "whole", "at_end", key.alias("key")).join(g, ["whole", "at_end", "key"])
    return near.where(F.rlike("subject", F.col("pattern"))).select("glob", "path").distinct()


def compared(globs: DataFrame, paths: DataFrame, glob: str = "glob", path: str = "path") -> DataFrame:
    """``name, side``: globs that fit no path (``documented_only``) and paths that no glob fits (``actual_only``)."""
    both = matches(globs, paths, glob, path)
    only = globs.select(F.col(glob).alias("glob")).where("glob IS NOT NULL").distinct().join(both, "glob", "left_anti")
    rest = paths.select(F.col(path).alias("path")).where("path IS NOT NULL").distinct().join(both, "path", "left_anti")
    return only.select(F.col("glob").alias("name"), F.lit("documented_only").alias("side")).unionByName(rest.select(F.col("path").alias("name"), F.lit("actual_only").alias("side")))


def traced(wanted: DataFrame, paths: DataFrame, annotated: DataFrame | None = None) -> DataFrame:
    """``doc, n_sources, linked``: documents with the number of source files that their globs fit.

    ``wanted``: ``doc, glob``. A document is linked when a source fits, or when a file
    says so itself (``annotated``: ``doc``). Markdown files are no sources.
    """
    sources = paths.where(~F.lower("path").endswith(".md"))
    hits = wanted.join(matches(wanted, sources), "glob").groupBy("doc").agg(F.count_distinct("path").alias("n_sources"))
    docs = wanted.select("doc").distinct().join(hits, "doc", "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)).cast("long"))
    if annotated is None:
        return docs.withColumn("linked", F.col("n_sources") > 0)
    said = annotated.select("doc").distinct().withColumn("_said", F.lit(True))
    return docs.join(said, "doc", "left").select("doc", "n_sources", ((F.col("n_sources") > 0) | F.coalesce("_said", F.lit(False))).alias("linked"))

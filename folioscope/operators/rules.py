"""Rules in instruction files: what is one, and which contradict each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .extract import numbered_lines
from .markdown import joined_path

#: Words that make a rule of a sentence, negations, and words that only give polarity.
SIGNAL = r"(?i)\b(must|never|always|do not|don't|should|require[sd]?|forbid|only)\b"
NEGATIONS = r"\b(never|dont|do not|not)\b"
POLARITY = r"\b(never|dont|do not|not|always|must|do|should|shall)\b"


def instruction_rules(df: DataFrame, key: str, text: str, generated: str | None = None) -> DataFrame:
    """``key, line, section, place, rule``: list items, and sentences of other lines, with a word of command.

    Fenced blocks, headings, tables and comments give none, nor do files that hold the
    text ``generated`` (they mirror another). Rules are cut to 200 characters, as findings show them.
    """
    files = df if generated is None else df.where(~F.contains(F.coalesce(F.col(text), F.lit("")), F.lit(generated)))
    trimmed = numbered_lines(files, key, text).withColumn("t", t.trimmed(F.col("content")))
    fence, head = F.col("t").startswith("```"), r"^#{2,3}[ \t]+(.+)$"
    heading = F.regexp_extract("content", head, 1) != ""
    rows = trimmed.where(fence | heading | F.col("t").rlike(SIGNAL))
    w = Window.partitionBy(key).orderBy("line")
    rows = rows.withColumn("fences", F.sum(fence.cast("int")).over(w))
    rows = rows.where(~fence & (F.col("fences") % 2 == 0)).withColumn("section", F.coalesce(F.last(F.when(heading, t.trimmed(F.regexp_extract("content", head, 1))), True).over(w), F.lit("")))
    item = r"^(?:[-*+]|[0-9]+[.)])[ \t]+(.*)$"
    parts = F.when(F.col("t").rlike(item), F.array(F.regexp_extract("t", item, 1))).otherwise(F.split(F.regexp_replace("t", r"^>[ \t]*", ""), r"(?<=[.!?])[ \t]+", -1))
    each = rows.where(~F.col("t").rlike(r"^(#|<!--|\|)")).select(key, "line", "section", F.posexplode(parts).alias("place", "raw"))
    rule = t.trimmed(F.col("raw"))
    return each.where((F.length(rule) >= 8) & rule.rlike(SIGNAL)).select(key, "line", "section", F.col("place").cast("long").alias("place"), F.substring(rule, 1, 200).alias("rule"))


def contradictions(rules: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, common, odd``: rules that others contradict.

    Two rules contradict each other when they are in the same ``common`` and differ in
    ``odd`` (the parity of their negations); a row a rule holds all pairs without writing them.
    """
    norm = t.rule_norm(F.col(text))
    common = t.trimmed(F.regexp_replace(F.regexp_replace(norm, POLARITY, " "), " +", " "))
    x = rules.select(*keys, common.alias("common"), (F.regexp_count(norm, F.lit(NEGATIONS)) % 2 == 1).alias("odd")).where("instr(common, ' ') > 0")
    both = x.groupBy("common").agg(F.bool_or("odd").alias("a"), F.bool_or(~F.col("odd")).alias("b")).where("a AND b").select("common")
    return x.join(both, "common", "left_semi").select(*keys, "common", "odd")


#: Endings of files that a rule may point to.
POINTED = "md|mjs|cjs|js|ts|tsx|jsx|json|ya?ml|py|sh|toml|txt|rs|go|css|html"


def stale_pointers(rules: DataFrame, files: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, pointed``: paths that a rule names, in backticks or with a slash, and that no file of ``files`` (``path``) has; each once a line."""
    cut = lambda x: t.trimmed(F.regexp_replace(x, "[#:].*$", ""))
    ticked = F.filter(F.transform(F.regexp_extract_all(F.col(text), F.lit("`([^`]+)`"), F.lit(1)), cut), lambda x: x.rlike(rf"(?i)^[A-Za-z0-9_.-][A-Za-z0-9_./-]*\.(?:{POINTED})$"))
    bare = F.transform(F.regexp_extract_all(F.col(text), F.lit(rf"""(?i)(?:^|[ \t("'])([A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+\.(?:{POINTED}))\b"""), F.lit(1)), cut)
    named = rules.select(*keys, F.explode(F.concat(ticked, bare)).alias("pointed")).distinct().withColumn("path", joined_path(F.lit(""), F.col("pointed")))
    return named.join(files.select("path").distinct(), "path", "left_anti").select(*keys, "pointed")

"""Markdown documents: headings, links, where links lead, and units that document code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .extract import anchor_suggestions, numbered_lines

LINK = r"\[[^\]]+\]\(((?!https?:|mailto:)[^)]+)\)"
WIKI = r"(?<!!)\[\[([^\]|#\n]+(?:#[^\]|\n]*)?)(?:\|[^\]\n]*)?\]\]"
#: What makes a heading the signature of a unit of code.
HTTP_SIGNATURE = r"(?i)^`?[ \t]*(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)[ \t]+/?`?[^ \t\r\n]"
SYMBOL_SIGNATURE = r"^`[^` \t][^`]*`[ \t]*$"
CALL = r"(?:^|[ \t`.])([A-Za-z_][A-Za-z0-9_]*)\((?:\)|[^)]*\))"
UNIT_WORD = "[A-Za-z0-9][A-Za-z0-9'-]*"


def lines_outside_fences(df: DataFrame, key: str, text: str, wanted: str) -> DataFrame:
    """``key, line, content`` of lines that match ``wanted`` and stand in no block fenced by ```.

    Only those lines and the fences are shuffled.
    """
    fence = F.col("content").startswith("```")
    rows = numbered_lines(df, key, text).where(fence | F.col("content").rlike(wanted))
    before = F.sum(fence.cast("int")).over(Window.partitionBy(key).orderBy("line"))
    return rows.withColumn("_fences", before).where(~fence & (F.col("_fences") % 2 == 0)).drop("_fences")


def headings(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line, level, heading, slug``."""
    pattern = r"^(#{1,6})[ \t\r\f\x0B]+([^\n]+?)[ \t\r\f\x0B]*$"
    found = lines_outside_fences(df, key, text, pattern)
    heading = F.regexp_extract("content", pattern, 2)
    return found.select(key, "line", F.length(F.regexp_extract("content", pattern, 1)).alias("level"), heading.alias("heading"), t.slug(heading).alias("slug"))


def links(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line, place, wiki, file, anchor`` of links to files and anchors, not to hosts; null is the same file, no anchor."""
    found = lines_outside_fences(df, key, text, r"\]\(|\[\[")
    plain = F.regexp_replace("content", "`[^`]+`", "")
    marked = lambda pattern, wiki: F.transform(F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(wiki).alias("wiki"), t.trimmed(x).alias("raw")))
    each = found.select(key, "line", F.posexplode(F.concat(marked(LINK, False), marked(WIKI, True))).alias("place", "x")).select(key, "line", F.col("place").cast("long").alias("place"), "x.wiki", "x.raw")
    angle = F.col("raw").startswith("<") & F.col("raw").contains(">")
    target = F.when(F.col("wiki"), F.col("raw")).when(angle, F.regexp_extract("raw", "^<([^>]*)>", 1)).otherwise(F.regexp_extract("raw", r"^[^ \t\r\f\x0B]*", 0))
    before = F.regexp_extract("target", "^[^#]*", 0)
    anchor = F.when(F.instr("target", "#") > 0, F.regexp_extract("target", "^[^#]*#(.*)$", 1))
    file = F.when(F.col("wiki"), t.trimmed(before)).otherwise(F.regexp_extract(before, r"^[^?]*", 0))
    out = each.withColumn("target", target).select(key, "line", "place", "wiki", F.nullif(file, F.lit("")).alias("file"), F.nullif(F.when(F.col("wiki"), t.trimmed(anchor)).otherwise(anchor), F.lit("")).alias("anchor"))
    return out.where("NOT wiki OR file IS NOT NULL")


def joined_path(folder: Column, path: Column) -> Column:
    """A relative path from a folder, without ``.`` and ``..``; what leaves the root, or starts there, keeps a mark of it."""

    def step(acc: Column, x: Column) -> Column:
        inside = (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != "..")
        return F.when((x == "") | (x == "."), acc).when((x == "..") & inside, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))

    whole = F.when(folder == "", path).otherwise(F.concat(folder, F.lit("/"), path))
    parts = F.aggregate(F.split(whole, "/", -1), F.expr("CAST(array() AS array<string>)"), step)
    return F.when(path.startswith("/"), path).otherwise(F.array_join(parts, "/"))


def decoded(x: Column) -> Column:
    """Percent codes decoded; as it is where they are malformed."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(x, r"\+", "%2B")), x)


def _folder(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "^(.*)/[^/]*$", 1), "/+$", "")


def _stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), r"(?i)\.mdx?$", ""))


def resolved_links(found: DataFrame, docs: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``target`` (null: none found) and ``checked`` to ``links`` of ``docs``; columns ``path`` in both tables.

    A target is looked for from the link's folder and from the root, as written and
    then decoded; that of a wikilink also by its bare name, documents first. Links to
    other than Markdown files aren't checked; wikilinks are only where one leads somewhere.
    """
    known = files.select(F.col("path").alias("candidate")).unionByName(docs.select(F.col("path").alias("candidate"))).distinct()
    with_md = F.when(F.lower("file").rlike(r"\.mdx?$"), F.col("file")).otherwise(F.concat("file", F.lit(".md")))
    name = F.when(F.col("wiki"), with_md).otherwise(F.col("file"))
    tries = [joined_path(_folder(F.col("path")), name), joined_path(F.lit(""), name)]
    tries += [F.when(~F.col("wiki"), joined_path(_folder(F.col("path")), decoded(name))), F.when(~F.col("wiki"), joined_path(F.lit(""), decoded(name)))]
    asked = found.where("file IS NOT NULL AND (wiki OR lower(file) LIKE '%.md')").select("path", "line", "place", "wiki", F.posexplode(F.array(*tries)).alias("rank", "candidate"), _stem(name).alias("stem"))
    hits = asked.join(known, "candidate").groupBy("path", "line", "place").agg(F.min_by("candidate", "rank").alias("_hit"))
    in_docs = docs.select(F.col("path"), F.lit(0).alias("other")).unionByName(files.select("path", F.lit(1).alias("other")))
    by_stem = in_docs.where(F.col("path").rlike(r"(?i)\.mdx?$")).groupBy(_stem(F.col("path")).alias("stem")).agg(F.min_by("path", F.struct("other", "path")).alias("_named"))
    named = asked.where("wiki AND rank = 0").join(by_stem, "stem").select("path", "line", "place", "_named")
    out = found.join(hits, ["path", "line", "place"], "left").join(named, ["path", "line", "place"], "left")
    target = F.when(F.col("file").isNull(), F.col("path")).otherwise(F.coalesce("_hit", "_named"))
    used = F.broadcast(out.where("wiki").agg(F.coalesce(F.bool_or(target.isNotNull()), F.lit(False)).alias("_used")))  # one row
    checked = F.when(F.col("wiki"), F.col("_used")).otherwise(F.col("file").isNull() | F.lower("file").endswith(".md"))
    return out.crossJoin(used).select(*found.columns, F.when(checked, target).alias("target"), checked.alias("checked"))


def link_findings(docs: DataFrame, files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """``path, line, place, code, wanted, suggestion, fixable``: links to no file (XRF001) or to no heading (XRF002).

    A fix is safe where the suggestion is within two edits and no other heading is.
    Headings are known of ``docs`` only.
    """
    docs = docs.select(F.col(path).alias("path"), F.col(text).alias("content"))
    known = headings(docs, "path", "content").select(F.col("path").alias("target"), F.col("slug")).distinct()
    found = resolved_links(links(docs, "path", "content"), docs, files).where("checked")
    lost = found.where("target IS NULL").select("path", "line", "place", F.lit("XRF001").alias("code"), F.col("file").alias("wanted"))
    anchors = found.where("target IS NOT NULL AND anchor IS NOT NULL").withColumn("slug", t.slug(decoded(F.col("anchor"))))
    missed = anchors.join(known, (anchors.target == known.target) & ((known.slug == anchors.slug) | (known.slug == anchors.anchor)), "left_anti")
    asked, has = missed.select(F.col("target").alias("file"), F.col("slug").alias("anchor")).distinct(), known.select(F.col("target").alias("file"), F.col("slug").alias("anchor"))
    best = anchor_suggestions(asked, has)
    near = asked.join(has.withColumnRenamed("anchor", "other"), "file").where(F.levenshtein("anchor", "other") <= 2).groupBy("file", "anchor").agg(F.count(F.lit(1)).alias("near"), F.min("other").alias("only"))
    safe = (F.col("near") == 1) & (F.col("only") == F.col("suggestion")) & ~F.col("wiki")
    broken = missed.withColumnsRenamed({"anchor": "_raw", "file": "_file"}).withColumnsRenamed({"target": "file", "slug": "anchor"})
    broken = broken.join(best, ["file", "anchor"], "left").join(near, ["file", "anchor"], "left")
    broken = broken.select("path", "line", "place", F.lit("XRF002").alias("code"), F.col("_raw").alias("wanted"), "suggestion", F.coalesce(safe, F.lit(False)).alias("fixable"))
    return lost.select("*", F.lit(None).cast("string").alias("suggestion"), F.lit(False).alias("fixable")).unionByName(broken)


def is_signature(heading: Column) -> Column:
    """Whether a heading names a route, a symbol in backticks or a call, not a topic."""
    x = t.trimmed(heading)
    name = F.regexp_extract(x, CALL, 1)
    return x.rlike(HTTP_SIGNATURE) | x.rlike(SYMBOL_SIGNATURE) | ((name != "") & (name.rlike("[a-z][A-Z]|_") | x.rlike(r"\([ \t]*\)")))


def units(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line, heading, words, prose``: sections headed by a signature; ``prose`` leaves fenced blocks out.

    A section runs to the next heading of its level or above; those within belong to it.
    """
    head = r"^(#{1,6})[ \t\r\f\x0B]+(.*)$"

    def as_heading(x: Column, i: Column) -> Column:
        heading = t.trimmed(F.regexp_extract(x, head, 2))
        return F.struct((i + 1).alias("line"), F.length(F.regexp_extract(x, head, 1)).alias("level"), F.lit(0).alias("stop"), heading.alias("heading"))

    def step(acc: Column, h: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        is_open = F.coalesce(last["stop"] == 0, F.lit(False))
        closes = is_open & (h["level"] <= last["level"])
        closed = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["line"].alias("line"), last["level"].alias("level"), h["line"].alias("stop"), last["heading"].alias("heading"))))
        rest = F.when(closes, closed).otherwise(acc)
        return F.when((~is_open | closes) & is_signature(h["heading"]), F.concat(rest, F.array(h))).otherwise(rest)

    lines = df.select(key, t.lines(F.col(text)).alias("lines"))
    heads = F.filter(F.transform("lines", as_heading), lambda h: h["level"] > 0)
    start = F.expr("CAST(array() AS array<struct<line: int, level: int, stop: int, heading: string>>)")
    each = lines.select(key, "lines", F.explode(F.aggregate(heads, start, step)).alias("u"))
    stop = F.when(F.col("u.stop") == 0, F.size("lines") + 1).otherwise(F.col("u.stop"))
    body = F.array_join(F.slice("lines", F.col("u.line") + 1, stop - F.col("u.line") - 1), "\n")
    parts = F.split(body, "(?m)^[ \\t\\r\\f\\x0B]*```[^\\n]*", -1)
    prose = F.aggregate(F.filter(parts, lambda x, i: i % 2 == 0), F.lit(0), lambda a, x: a + F.regexp_count(x, F.lit(UNIT_WORD)))
    return each.select(key, F.col("u.line").cast("long").alias("line"), F.col("u.heading").alias("heading"), F.regexp_count(body, F.lit(UNIT_WORD)).cast("long").alias("words"), prose.cast("long").alias("prose"))


def unit_smells(found: DataFrame, lazy: int = 6, bloated: int = 300) -> DataFrame:
    """``code`` of units: in name only (APS002, first) or too long (APS001)."""
    code = F.when(F.col("prose") <= lazy, "APS002").when(F.col("words") >= bloated, "APS001")
    return found.withColumn("code", code).where("code IS NOT NULL")

"""Sections of documents: where they end, what they hold, whether generated ones are stale, and putting them in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADING = r"^(#{1,6})[ \t]+(.+?)[ \t]*$"


def ends(headings: DataFrame, key: str, place: str = "place", level: str = "level") -> DataFrame:
    """``headings`` with ``end``: the place of the next heading of the same or a higher level; null where the section goes to the end.

    There are six levels, so the next smaller or equal one is the least of the next
    headings of each level up to the own: one sort of a document's headings, no self join.
    """
    after = Window.partitionBy(key).orderBy(place).rowsBetween(1, Window.unboundedFollowing)
    next_of = [F.min(F.when(F.col(level) == k, F.col(place))).over(after) for k in range(1, 7)]
    own = F.array(*[F.when(F.col(level) >= k, x) for k, x in enumerate(next_of, 1)])
    return headings.withColumn("end", F.array_min(F.filter(own, lambda x: x.isNotNull())))


def section(text: Column, heading: Column) -> Column:
    """The lines from the first heading that contains ``heading``, in whatever case, to the next of the same or a higher level.

    All of the text without a ``heading``; empty where there is none such. Fences are not looked at.
    """
    whole = F.coalesce(text, F.lit(""))
    needle = F.trim(F.regexp_replace(F.lower(F.coalesce(heading, F.lit(""))), r"^#+[ \t\r\n\f]*", ""))
    marked = F.transform(F.split(whole, "\n", -1), lambda x: F.struct(x.alias("line"), F.length(F.regexp_extract(x, HEADING, 1)).alias("level"), F.lower(F.regexp_extract(x, HEADING, 2)).alias("title")))

    def step(acc: Column, x: Column) -> Column:
        opens = (acc["level"] == 0) & (x["level"] > 0) & F.contains(x["title"], needle)
        closes = (acc["level"] > 0) & (x["level"] > 0) & (x["level"] <= acc["level"])
        level = F.when(opens, x["level"]).when(closes, -1).otherwise(acc["level"])
        return F.struct(level.alias("level"), F.when(level > 0, F.concat(acc["out"], F.array(x["line"]))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("level"), F.expr("CAST(array() AS array<string>)").alias("out"))
    cut = F.aggregate(marked, start, step, lambda acc: F.array_join(acc["out"], "\n"))
    return F.when(needle == "", whole).otherwise(cut)


def first_difference(expected: Column, actual: Column) -> Column:
    """``line, expected, actual`` of the first line (from 1) where two texts differ; null where they don't."""
    pairs = F.zip_with(F.split(expected, "\n", -1), F.split(actual, "\n", -1), lambda e, a: F.struct(e.alias("expected"), a.alias("actual")))
    places = F.transform(pairs, lambda p, k: F.struct((k + 1).cast("long").alias("line"), p["expected"].alias("expected"), p["actual"].alias("actual")))
    return F.get(F.filter(places, lambda p: ~p["expected"].eqNullSafe(p["actual"])), F.lit(0))


def stale_sections(expected: DataFrame, actual: DataFrame, keys: list[str], shown: int = 60) -> DataFrame:
    """``keys, line, documented, generated``: generated sections whose text isn't what it would be now.

    Both sides have ``keys, body``, ``actual`` also ``pinned``. White space around a
    body doesn't count; pinned sections, and those that a document lacks, are no finding.
    """
    space = F.lit(" \t\n\x0b\x0c\r")
    e = expected.select(*keys, F.btrim("body", space).alias("_e"))
    a = actual.where(~F.coalesce("pinned", F.lit(False))).select(*keys, F.btrim("body", space).alias("_a"))
    both = e.join(a, keys).where("_e <> _a").withColumn("d", first_difference(F.col("_e"), F.col("_a")))
    cut = lambda x: F.substring(F.coalesce(x, F.lit("")), 1, shown)
    return both.select(*keys, F.col("d.line").alias("line"), cut(F.col("d.actual")).alias("documented"), cut(F.col("d.expected")).alias("generated"))


def rendered(section_id: Column, body: Column, source: str = "code", mark: str = "folioscope:section") -> Column:
    return F.concat(F.lit(f"<!-- {mark} id="), section_id, F.lit(f" source={source} -->\n"), _bare(body), F.lit(f"\n<!-- /{mark} -->"))


def _bare(body: Column) -> Column:
    return F.regexp_replace(body, r"^\n+|\n+$", "")


def upserted(text: Column, section_id: Column, body: Column, source: str = "code", position: str = "end", mark: str = "folioscope:section") -> Column:
    """``text, action``: a document with the body of a section replaced, or the section put in where it has none.

    ``position``: ``end``, ``top`` (after the first heading) or ``after:<id>``; where
    that isn't found, the end. Doing it twice changes nothing more.
    """
    whole = F.coalesce(text, F.lit(""))
    lines = F.split(whole, "\n", -1)
    named = lambda i: F.concat(F.lit(rf"""^[ \t]*<!--[ \t]*{mark}\b[^>]*\bid=["']?"""), F.regexp_replace(i, r"[.+*?^${}()|\[\]\\]", r"\\$0"), F.lit(r"""["']?([ \t][^>]*)?-->[ \t]*$"""))
    closes = rf"^[ \t]*<!--[ \t]*/{mark}[ \t]*-->[ \t]*$"

    def first(fits, after: Column) -> Column:
        """The first line behind ``after`` that fits, from 1; 0 if none does."""
        at = F.array_position(F.slice(F.transform(lines, lambda x: F.coalesce(fits(x), F.lit(False))), after + 1, F.size(lines)), F.lit(True))
        return F.when(at > 0, after + at).otherwise(0).cast("int")

    open_at = lambda i: first(lambda x: F.rlike(x, named(i)), F.lit(0))
    close_at = lambda o: first(lambda x: x.rlike(closes), o)
    o = open_at(section_id)
    c = close_at(o)
    there = (o > 0) & (c > 0)
    joined = lambda *parts: F.array_join(F.concat(*parts), "\n")
    head = lambda n: F.slice(lines, F.lit(1), n)
    tail = lambda n: F.slice(lines, n, F.greatest(F.size(lines) - n + 1, F.lit(0)))
    old = F.array_join(F.slice(lines, o + 1, F.greatest(c - o - 1, F.lit(0))), "\n")
    swapped = joined(head(o), F.array(_bare(body)), tail(F.greatest(c, F.lit(1))))
    block = rendered(section_id, body, source, mark)
    at_end = F.concat(F.regexp_replace(whole, r"\n+$", ""), F.lit("\n\n"), block, F.lit("\n"))
    at = F.lit(0)
    if position.startswith("after:"):
        other = open_at(F.lit(position.removeprefix("after:").strip()))
        at = F.when(other > 0, close_at(other)).otherwise(0)
    elif position == "top":
        at = first(lambda x: x.rlike(r"^#{1,6}[ \t]"), F.lit(0))
    put_in = F.when(at > 0, joined(head(at), F.array(F.lit(""), block), tail(at + 1))).otherwise(at_end)
    action = F.when(there, F.when(old == _bare(body), "unchanged").otherwise("replaced")).otherwise("inserted")
    return F.struct(F.when(there, F.when(old == _bare(body), whole).otherwise(swapped)).otherwise(put_in).alias("text"), action.alias("action"))

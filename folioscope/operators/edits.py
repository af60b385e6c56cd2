"""Sets of edits applied to texts by position, in one pass over each text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def places(text: Column, pattern: str, group: int = 1) -> Column:
    """``begin, end, found`` (characters from 0) of a group of each match of a pattern; the pattern must end with the group, and must not look behind it."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    own = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.split(text, pattern, -1)
    each = F.zip_with(F.slice(parts, F.lit(1), F.size(hits)), F.arrays_zip(hits.alias("h"), own.alias("o")), lambda p, x: F.struct(F.length(p).alias("gap"), F.length(x["h"]).alias("hit"), F.length(x["o"]).alias("own"), x["o"].alias("found")))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["gap"] + x["hit"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct((end - x["own"]).alias("begin"), end.alias("end"), x["found"].alias("found")))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<begin:int,end:int,found:string>>)").alias("out"))
    return F.aggregate(each, start, step, lambda acc: acc["out"])


def sound(edits: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, begin, end, by, applied``: each different edit once; one that begins before an earlier one ends, itself refused or not, is refused.

    Edits go in order of their places; two at one place without length are both kept,
    in order of what they put in. Edits that end before they begin are refused.
    """
    each = edits.select(*keys, F.col("begin").cast("int").alias("begin"), F.col("end").cast("int").alias("end"), F.col("by")).distinct()
    before = Window.partitionBy(*keys).orderBy("begin", "end", "by").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    return each.withColumn("applied", (F.col("begin") >= reached) & (F.col("end") >= F.col("begin")) & F.col("by").isNotNull())


def applied(texts: DataFrame, edits: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, text, n_applied, n_refused``: texts with their edits; those without any stay as they are.

    A document's edits meet its text in one row and are laid over it in one fold, so
    positions are those of the text as it was, whatever other edits do.
    """
    by = sound(edits, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("applied"), F.struct("begin", "end", "by")))).alias("_e"), F.count_if(~F.col("applied")).alias("n_refused"))
    both = texts.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_t")).join(by, keys, "left")

    def step(acc: Column, e: Column) -> Column:
        kept = F.substring(F.col("_t"), acc["at"] + 1, e["begin"] - acc["at"])
        return F.struct(e["end"].alias("at"), F.concat(acc["out"], F.array(kept, e["by"])).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<string>)").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.array(F.substring(F.col("_t"), acc["at"] + 1, F.length("_t"))))
    folded = F.array_join(F.aggregate("_e", start, step, rest), "")
    n = F.coalesce(F.size("_e"), F.lit(0))
    return both.select(*keys, F.when(n > 0, folded).otherwise(F.col("_t")).alias(text), F.greatest(n, F.lit(0)).cast("long").alias("n_applied"), F.coalesce("n_refused", F.lit(0)).cast("long").alias("n_refused"))

"""JSON of any shape as variants: leaf paths, what doesn't parse, and keys that are used and not defined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Calls that translate a key, and the attribute that names one.
USED_KEY = r"""(?:\b(?:i18n\.)?t\([ \t\r\n\f]*|\bi18nKey[ \t\r\n\f]*=[ \t\r\n\f]*)[`'"]([a-zA-Z][A-Za-z0-9_.-]*\.[A-Za-z0-9_.-]+)[`'"]"""


def parsed(df: DataFrame, text: str, name: str = "v") -> DataFrame:
    """``df`` with ``text`` as a variant; null where it is no JSON."""
    return df.withColumn(name, F.try_parse_json(F.col(text)))


def leaves(df: DataFrame, key: str, variant: str, depth: int = 64) -> DataFrame:
    """``key, path, value``: every leaf of every object, its names joined by points.

    Arrays, numbers, texts and nulls are leaves; an empty object has none, and what is
    no object at the top has none either. Objects are opened level by level, all rows
    together; only what is still an object goes on. Deeper than ``depth`` is an error.
    """
    spark = df.sparkSession
    shape = "substring(schema_of_variant(value), 1, 6) = 'OBJECT'"
    level = df.select(F.col(key).alias("id"), F.lit(None).cast("string").alias("path"), F.col(variant).alias("value")).where(shape)
    found = []
    for _ in range(depth):
        opened = spark.sql("SELECT s.id, concat_ws('.', s.path, x.key) AS path, x.value FROM {level} s, LATERAL variant_explode(s.value) x", level=level)
        found.append(opened.where(f"NOT coalesce({shape}, false)").select("id", "path", F.to_json("value").alias("value")))
        level = opened.where(shape)
        if level.isEmpty():
            break
    else:
        raise ValueError(f"objects in objects, more than {depth} deep")
    return reduce(DataFrame.unionByName, found).select(F.col("id").alias(key), "path", "value")


def used_keys(df: DataFrame, text: str) -> DataFrame:
    """``name`` of keys that code translates, each once."""
    return df.where(F.col(text).contains("t(") | F.col(text).contains("i18nKey")).select(F.explode(F.regexp_extract_all(F.col(text), F.lit(USED_KEY), F.lit(1))).alias("name")).distinct()


def missing_keys(used: DataFrame, defined: DataFrame) -> DataFrame:
    """``name`` of keys that are used and that no leaf defines."""
    return used.select("name").join(defined.select(F.col("path").alias("name")).distinct(), "name", "left_anti")


#: Methods of an operation in a specification of an interface.
OPERATIONS = ("get", "post", "put", "delete", "patch", "options", "head")


def spec_endpoints(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, method, path, incomplete``: the operations of specifications in JSON.

    One that declares ``paths`` and yields no operation is a row without one,
    ``incomplete``: it was not understood, which is not the same as having none.
    """
    spark = df.sparkSession
    own = parsed(df.select(F.col(key).alias("id"), F.col(text).alias("text")), "text")
    paths = own.select("id", F.expr("try_variant_get(v, '$.paths', 'variant')").alias("value"))
    by_path = spark.sql("SELECT s.id, x.key AS path, x.value FROM {paths} s, LATERAL variant_explode(s.value) x", paths=paths)
    each = spark.sql("SELECT s.id, s.path, x.key AS method FROM {by_path} s, LATERAL variant_explode(s.value) x", by_path=by_path)
    found = each.where(F.col("method").isin(*OPERATIONS)).select("id", F.upper("method").alias("method"), "path", F.lit(False).alias("incomplete"))
    declared = own.where(F.col("text").rlike(r"""(^|\n)[ \t]*["']?paths["']?[ \t]*:|[{,][ \t]*"paths"[ \t]*:""")).select("id").distinct()
    lost = declared.join(found.select("id").distinct(), "id", "left_anti")
    none = F.lit(None).cast("string")
    return found.unionByName(lost.select("id", none.alias("method"), none.alias("path"), F.lit(True).alias("incomplete"))).withColumnRenamed("id", key)

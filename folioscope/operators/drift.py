"""Set drift between what is documented and what is there, as joins on a normal key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compared(documented: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """``key, state``: matched, documented_only or actual_only; each key once."""
    a = documented.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_d", F.lit(1))
    b = actual.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(1))
    state = F.when(F.col("_d").isNull(), "actual_only").when(F.col("_a").isNull(), "documented_only").otherwise("matched")
    return a.join(b, key, "full").select(key, state.alias("state"))


def path_key(path: Column) -> Column:
    """An endpoint path without query, decoration and parameter names; null if it isn't a path."""
    x = F.regexp_replace(F.trim(path), "^[|'\"`]+|[|'\"`]+$", "")
    x = F.regexp_replace(F.trim(x), "[?#].*$", "")
    x = F.regexp_replace(x, r"\[{1,2}[^\]]*\]{1,2}|\{[^}/]+\}|:[^/]+", "{}")
    x = F.when(F.length(x) > 1, F.regexp_replace(x, "/+$", "")).otherwise(x)
    return F.when(x.startswith("/"), x)


def api_drift(documented: DataFrame, actual: DataFrame, from_spec: bool, cap: int = 15) -> DataFrame:
    """``code, place, severity, confidence, shown``: documented endpoints that aren't there (API004), and those there that no document has (API005).

    Rows are ``method, path``. A specification is proof, so what it lacks is an error
    that can be fixed; code that a scan found is not, so there it is a weak warning.
    Nothing documented or nothing found is no comparison and gives no rows. ``cap``
    rows of each code are shown, then one with the number of the rest.
    """
    keyed = lambda df: df.select(F.upper("method").alias("method"), path_key(F.col("path")).alias("path")).where("path IS NOT NULL").select(F.concat_ws(" ", "method", "path").alias("endpoint"))
    state = compared(keyed(documented), keyed(actual), "endpoint")
    sides = state.agg(F.bool_or(F.col("state") != "actual_only").alias("d"), F.bool_or(F.col("state") != "documented_only").alias("a"))  # one row
    wrong = state.where("state <> 'matched'").crossJoin(F.broadcast(sides)).where("d AND a")
    code = F.when(F.col("state") == "documented_only", "API004").otherwise("API005")
    shown = capped(wrong.select(code.alias("code"), "endpoint", F.col("endpoint").alias("shown")), "code", ["endpoint"], cap, "shown")
    absent = F.col("code") == "API004"
    severity = F.when(absent & F.lit(from_spec), "error").otherwise("warn")
    confidence = F.when(absent & ~F.lit(from_spec), "low").otherwise("high")
    return shown.select("code", "place", severity.alias("severity"), confidence.alias("confidence"), "shown")


def entity_key(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[_-]", ""), "s$", "")


def divergent(specs: DataFrame, spec: str, key: str) -> DataFrame:
    """Keys that some but not all specifications have: ``key, n_specs``."""
    total = specs.agg(F.count_distinct(spec).alias("total"))
    return specs.groupBy(key).agg(F.count_distinct(spec).alias("n_specs")).crossJoin(F.broadcast(total)).where("n_specs < total").drop("total")  # total is one row


def capped(findings: DataFrame, group: str, order: list[str], cap: int, shown: str) -> DataFrame:
    """The first ``cap`` rows of each group, and a row that says how many more there are."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    ranked = findings.select(group, *order, shown, n.alias("place"))
    first = ranked.where(F.col("place") <= cap).select(group, F.col("place").cast("long").alias("place"), F.col(shown).cast("string").alias("shown"))
    more = findings.groupBy(group).agg((F.count(F.lit(1)) - cap).alias("left")).where("left > 0")
    return first.unionByName(more.select(group, F.lit(cap + 1).cast("long").alias("place"), F.concat(F.lit("... and "), F.col("left").cast("string"), F.lit(" more")).alias("shown")))


#: Rows, and pairs of them, that a task of ``sharing_pairs`` holds on average; tasks at most.
HELD, MOST_TASKS = 250_000, 10_000


def sharing_pairs(rows: DataFrame, owner: str, item: str, held: int = HELD) -> DataFrame:
    """Pairs of owners that share items: ``a, b, shared``.

    Rows are dealt by item and pairs by pair over as many tasks as there is need of, by
    their numbers, so what a task holds doesn't grow with the table.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = lambda n: min(MOST_TASKS, max(cores, -(-int(n or 0) // held)))
    known = rows.select(F.col(owner).alias("a"), F.col(item).alias("item")).where("a IS NOT NULL AND item IS NOT NULL")
    x = known.repartition(tasks(rows.count()), "item").distinct()
    n = x.groupBy("item").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.expr("n * (n - 1) DIV 2"))).first()[0]
    pairs = x.join(x.withColumnRenamed("a", "b"), "item").where("a < b").select("a", "b")
    return pairs.repartition(tasks(n), "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))

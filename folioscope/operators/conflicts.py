"""Pairs of rules on one topic, best first, without a look at all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.shared import stored, work_folder
from .rules import NEGATIONS, POLARITY

#: Words that say nothing about the topic of a rule.
TOPIC_STOP_WORDS = (
    "the", "a", "an", "to", "of", "in", "for", "and", "or", "with", "without",
    "on", "at", "by", "from", "as", "is", "are", "be", "been", "being", "it",
    "its", "this", "that", "these", "those", "you", "your", "we", "our", "all",
    "any", "each", "every", "when", "where", "while", "if", "then", "than",
    "so", "but", "not", "no", "never", "always", "must", "should", "shall",
    "do", "dont", "does", "did", "done", "can", "cannot", "cant", "may",
    "might", "will", "would", "could", "only", "before", "after", "into",
    "over", "under", "via", "per", "also", "ever", "instead", "rather",
    "avoid", "ensure", "require", "requires", "required", "forbid", "forbidden",
    "e", "g", "i", "etc", "please",
)
#: Stems that two rules on one topic share at least.
LEAST_SHARED = 2


def stem(word: Column) -> Column:
    """A word without a common ending, and without the last of two equal letters."""
    n, cut = F.length(word), lambda k: F.substring(word, F.lit(1), F.length(word) - k)
    x = F.when((n > 5) & word.endswith("ing"), cut(3)).when((n > 4) & (word.endswith("ed") | word.endswith("es")), cut(2)).when((n > 3) & word.endswith("s"), cut(1)).otherwise(word)
    return F.regexp_replace(x, r"^(.{2,}(.))\2$", "$1")


def stems(norm: Column) -> Column:
    """The stems of a normal rule's words that say something, in order, each once."""
    said = F.filter(F.split(norm, " ", -1), lambda w: (F.length(w) >= 3) & ~w.isin(*TOPIC_STOP_WORDS) & ~w.rlike("^[0-9]+$"))
    return F.array_distinct(F.transform(said, stem))


def _meeting(sets: DataFrame, at_least: int, *same: str) -> DataFrame:
    """Pairs of ``sets`` with ``at_least`` stems in common, as ``x`` and ``y`` and what they share.

    The rarest stems of each set, so many that sets with ``at_least`` in common share one,
    bring them together; of those that both have only the first one makes a row.
    """
    lead = F.slice("ranked", F.lit(1), F.size("ranked") - at_least + 1)
    led = sets.where(F.size("ranked") >= at_least).withColumn("lead", lead)
    side = lambda x: led.select(*same, F.explode("lead").alias("stem"), F.struct(*[c for c in led.columns if c != "ranked"]).alias(x))
    near = side("x").join(side("y"), ["stem", *same]).where("x.key < y.key")
    told = (F.col("x.norm") == F.col("y.norm")) | ((F.col("x.common") == F.col("y.common")) & (F.col("x.odd") != F.col("y.odd")))
    near = near.where(~told & (F.element_at(F.array_intersect("x.lead", "y.lead"), 1) == F.col("stem")))
    return near.select("x", "y", F.array_intersect("x.own", "y.own").alias("shared")).where(F.size("shared") >= at_least)


def _work(sets: DataFrame, *same: str) -> dict[int, int]:
    """How many pairs of sets meet on a stem, by the overlap that is asked for; a row an overlap."""
    each = sets.select(*same, F.posexplode("ranked").alias("pos", "stem"), F.size("ranked").alias("size"))
    each = each.groupBy("stem", *same, (F.col("size") - F.col("pos")).alias("at_least")).agg(F.count(F.lit(1)).alias("n"))
    met = F.sum("n").over(Window.partitionBy("stem", *same).orderBy(F.desc("at_least")))
    grown = each.withColumn("n", met).withColumn("more", F.col("n") * F.col("n") - F.coalesce(F.lag("n").over(Window.partitionBy("stem", *same).orderBy(F.desc("at_least"))), F.lit(0)) ** 2)
    steps = {r.at_least: int(r.more) for r in grown.groupBy("at_least").agg(F.sum("more").alias("more")).collect()}
    total, out = 0, {}
    for k in range(max(steps, default=LEAST_SHARED), LEAST_SHARED - 1, -1):
        total += steps.get(k, 0)
        out[k] = total
    return out or {LEAST_SHARED: 0}


#: Meetings that the first search makes at most, and how many times as many the next one may make.
FIRST_WORK, MORE_WORK = 1_000_000, 4


def _least_overlap(sets: DataFrame, pairs_of: Column, most: int, *same: str) -> int:
    """The highest overlap at which ``most`` pairs of rows are sure to be found, or the least that counts; ``pairs_of``: how many a pair of sets is sure to give."""
    work, budget = _work(sets, *same), FIRST_WORK
    at_least = max(work)
    while True:
        at_least = max(LEAST_SHARED, min([at_least, *[k for k in work if work[k] <= budget]]))
        found = _meeting(sets, at_least, *same).groupBy(F.size("shared").alias("n")).agg(F.sum(pairs_of).alias("pairs")).collect()  # a row an overlap
        total = 0
        for r in sorted(found, key=lambda r: -r.n):
            total += r.pairs
            if total >= most:
                return r.n
        if at_least == LEAST_SHARED:
            return LEAST_SHARED
        budget = max(MORE_WORK * work[at_least], work[at_least - 1])
        at_least -= 1


def candidates(rules: DataFrame, most: int = 40) -> DataFrame:
    """``rank, a_file, a_line, a_place, b_file, b_line, b_place, shared, across``: the ``most`` best pairs of rules to judge.

    ``rules``: ``file, line, place, rule``. Two rules are a pair when they share two
    stems; copies and plain contradictions are no pairs, as those are proven elsewhere.
    Pairs across files come first, then those with more stems in common, then by lines.

    Rules that are the same in normal form are one set of stems. The highest overlap that
    still gives enough pairs is searched for from above, as far down at a time as the
    number of sets that would meet allows; only sets that share one of their rarest
    stems meet. Pairs of sets become pairs of rules at that overlap alone. Of a rule that
    a file repeats, its first ``most`` places take part, and of a set's rules on one line of
    their files the first ``most`` can come first in a pair; no other pair can be among the best.
    """
    folder = work_folder(rules.sparkSession, "conflicts")
    said = stored(rules.select("file", "line", "place", t.rule_norm(F.col("rule")).alias("norm")), f"{folder}/said")
    common = t.trimmed(F.regexp_replace(F.regexp_replace("norm", POLARITY, " "), " +", " "))
    files = said.groupBy("norm").agg(F.count_distinct("file").alias("files"))
    own = files.select("norm", "files", common.alias("common"), (F.regexp_count("norm", F.lit(NEGATIONS)) % 2 == 1).alias("odd"), stems(F.col("norm")).alias("own"))
    own = stored(own.where(F.size("own") >= LEAST_SHARED).withColumn("key", F.monotonically_increasing_id()), f"{folder}/own")
    counts = own.select(F.explode("own").alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("n"))
    ranked = own.select("key", F.explode("own").alias("stem")).join(counts, "stem").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "stem"))).alias("r"))
    sets = stored(own.join(ranked.select("key", F.col("r.stem").alias("ranked")), "key"), f"{folder}/sets")
    again = F.row_number().over(Window.partitionBy("file", "norm").orderBy("line", "place"))
    rows = said.withColumn("_n", again).where(F.col("_n") <= most).join(sets.select("norm", "key"), "norm")
    rows = stored(rows.select("key", F.struct("file", "line", "place").alias("id")), f"{folder}/rows")

    sure = F.col("x.files") * F.col("y.files") - F.least("x.files", "y.files")
    met = _meeting(sets, _least_overlap(sets, sure, most))
    x, y = ([F.col(f"{s}.key").alias(f"{r}_key") for s, r in ((one, "a"), (other, "b"))] + [F.array_intersect(f"{one}.own", f"{other}.own").alias("shared")] for one, other in (("x", "y"), ("y", "x")))
    first = F.row_number().over(Window.partitionBy("key", "id.line").orderBy("id.file", "id.place"))
    a = rows.withColumn("_n", first).where(F.col("_n") <= most).select(F.col("key").alias("a_key"), F.col("id").alias("a"))
    b = rows.select(F.col("key").alias("b_key"), F.col("id").alias("b"))
    order = [F.desc("across"), F.desc(F.size("shared")), "a.line", "b.line", "a", "b"]
    every = met.select(*x).union(met.select(*y)).join(a, "a_key").join(b, "b_key").where("a.file < b.file").select("a", "b", "shared", F.lit(True).alias("across"))
    best = stored(every.orderBy(*order).limit(most), f"{folder}/across")
    if best.count() < most:
        within = rows.join(sets, "key").withColumn("file", F.col("id.file")).withColumn("key", F.col("id"))
        within = _meeting(within, _least_overlap(within, F.lit(1), most, "file"), "file")
        found = within.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), "shared", F.lit(False).alias("across"))
        best = best.union(found.orderBy(*order).limit(most)).orderBy(*order).limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(  # a few rows from here on
        F.col("rank").cast("long").alias("rank"),
        *[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in ("a", "b") for c in ("file", "line", "place")],
        F.array_join("shared", ",").alias("shared"),
        "across",
    )

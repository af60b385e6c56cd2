"""Which of many patterns stand in which of many texts, through an index of words and of their rarest grams.

A pattern without blanks, quotes or angle brackets can only stand within a word, a
stretch of text between those. So patterns are looked for in the different words of all
texts, and texts are looked up by the words that hold one. Other patterns are looked for
in whole texts, in the way that follows.

A pattern can only stand in a text that holds each of its grams (``GRAM``
characters in a row; a shorter pattern is its own gram). So texts are looked up by
one gram of each pattern, the one that the fewest texts hold; a pattern with a gram
that no text holds is gone before any text is looked at. What comes up is compared
with the whole pattern. No pair of a text and a pattern is made without a gram in
common, and a frequent gram only counts for patterns that have no rarer one.

Up to SENT patterns are sent to the texts, which then stay where they are. More
than that are joined on grams, with keys of texts, and texts are fetched by key; the
grams of texts pass a sieve of bounded size first, so that those of no pattern aren't shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored, work_folder

#: Characters of a gram, and patterns that are sent to all tasks at most (some tens of MB).
GRAM, SENT = 6, 200_000
#: Bits that number the words, of 64 bits each, of a sieve that is sent to all tasks: a million rows at most.
SIEVE_BITS = 20


def grams(text: Column, n: int) -> Column:
    """The different stretches of ``n`` characters of a text, in time linear in it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _slot(gram: Column) -> tuple[Column, Column]:
    """The word of the sieve that a gram falls to, and its bit there."""
    h = F.xxhash64(gram)
    return F.shiftrightunsigned(h, 64 - SIEVE_BITS).alias("_word"), F.expr("shiftleft(1L, CAST(pmod(xxhash64(gram), 64) AS INT))").alias("_bit")


def _sieved(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``held`` whose ``gram`` may be among those of ``wanted``; few others pass, and no row is shuffled."""
    word, bit = _slot(F.col("gram"))
    words = wanted.select(word, bit).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return held.withColumn("_word", word).join(F.broadcast(words), "_word").where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")


#: What ends a word.
BETWEEN = r'[ \t\r\n\f\x0B"<>]+'


def _wanted(patterns: DataFrame, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Different patterns that stand within a word wherever they stand, and others."""
    p = patterns.select(F.col(pattern).alias("pattern")).where("pattern IS NOT NULL AND pattern <> ''").distinct()
    p = stored(p.withColumn("_plain", ~F.col("pattern").rlike(BETWEEN)), f"{work_folder(patterns.sparkSession, 'patterns')}/all")
    return p.where("_plain").select("pattern"), p.where("NOT _plain").select("pattern")


def _words(texts: DataFrame, text: str) -> DataFrame:
    """``word, _text``: the different words of all texts, written, as texts of their own."""
    words = texts.select(F.explode(F.split(text, BETWEEN, -1)).alias("word")).where("word <> ''").distinct()
    return stored(words, f"{work_folder(texts.sparkSession, 'words')}/all").withColumn("_text", F.col("word"))


def found_in(texts: DataFrame, keys: list[str], text: str, patterns: DataFrame, pattern: str = "pattern", most: int = SENT) -> DataFrame:
    """``keys, pattern``: each pattern that stands somewhere in each text, once.

    Case counts. Null and empty patterns and null texts have no hits. Texts with the
    same keys count as one.
    """
    ids = [f"_k{i}" for i in range(len(keys))]
    out = [*[F.col(i).alias(k) for i, k in zip(ids, keys, strict=True)], "pattern"]
    named = texts.where(F.col(text).isNotNull()).select(*[F.col(k).alias(i) for i, k in zip(ids, keys, strict=True)], F.col(text).alias("_text"))
    plain, others = _wanted(patterns, pattern)
    found = [_by_grams(named, ids, others, most)]
    if not plain.isEmpty():
        hits = _by_grams(_words(named, "_text"), ["word"], plain, most).withColumnRenamed("word", "gram")
        hits = stored(hits, f"{work_folder(texts.sparkSession, 'hits')}/all")
        few = hits.limit(most + 1).count() <= most
        held = named.select(*ids, F.explode(F.array_distinct(F.split("_text", BETWEEN, -1))).alias("gram"))
        near = held.join(F.broadcast(hits), "gram") if few else _sieved(held, hits).join(hits, "gram")
        found.append(near.select(*ids, "pattern").distinct())
    return reduce(DataFrame.unionAll, found).select(*out)


def _by_grams(named: DataFrame, ids: list[str], p: DataFrame, most: int) -> DataFrame:
    """``ids, pattern``: each of the different patterns ``p`` that stands in each ``_text``, once."""
    sizes = sorted(r.n for r in p.select(F.least(F.length("pattern"), F.lit(GRAM)).alias("n")).distinct().collect())  # GRAM rows at most
    if not sizes:
        return named.select(*ids, F.lit("").alias("pattern")).where("false")
    few = p.limit(most + 1).count() <= most
    sent = F.broadcast if few else (lambda df: df)

    own = p.select("pattern", F.explode(F.when(F.length("pattern") >= GRAM, grams(F.col("pattern"), GRAM)).otherwise(F.array("pattern"))).alias("gram"))
    held = F.explode(F.concat(*[grams(F.col("_text"), n) for n in sizes])).alias("gram")
    sieved = (lambda df, wanted: df) if few else _sieved
    counts = sieved(named.select(held), own.select("gram"))
    if few:
        counts = counts.join(sent(own.select("gram").distinct()), "gram", "left_semi")
    counts = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))  # grams of no pattern that pass the sieve meet none below
    rated = own.join(counts, "gram", "left").groupBy("pattern").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("all_held"))
    chosen = rated.where("all_held").select("pattern", "gram")
    near = sieved(named.select(*ids, *(["_text"] if few else []), held), chosen).join(sent(chosen), "gram")
    if not few:
        near = near.select(*ids, "pattern").join(named, ids)
    return near.where(F.contains("_text", F.col("pattern"))).select(*ids, "pattern").distinct()


#: The ways in which a line can name a file, the surest first.
KINDS = ("path", "basename", "module")


def base_name(path: Column) -> Column:
    return F.regexp_replace(path, "^.*/", "")


def _forms(files: DataFrame, file: str) -> DataFrame:
    """``file, rank, pattern``: what a line may hold of a file's path."""
    path = F.regexp_replace(F.col(file), r"^\./", "")
    base = base_name(path)
    ticked = F.concat(F.lit("`"), F.regexp_replace(base, r"\.[^.]+$", ""), F.lit("`"))
    kinds = F.array(*[F.struct(F.lit(k).alias("rank"), x.alias("pattern")) for k, x in enumerate((path, base, ticked))])
    return files.select(F.col(file).alias("file"), F.inline(kinds)).where("pattern <> ''").distinct()


def references(files: DataFrame, lines: DataFrame, keys: list[str], text: str, file: str = "file", most: int = SENT) -> DataFrame:
    """``file, keys, kind``: the lines that name a file, by the first of its path, its base name and its stem in backticks."""
    forms = _forms(files, file)
    hits = found_in(lines, keys, text, forms, most=most).join(forms, "pattern")
    best = hits.groupBy("file", *keys).agg(F.min("rank").alias("rank"))
    return best.select("file", *keys, F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1).alias("kind"))


def impact(found: DataFrame, doc: str, agents: DataFrame | None = None) -> DataFrame:
    """``doc, n_files, is_agent_file``: which documents changed files affect; ``agents`` has the documents that instruct agents."""
    each = found.groupBy(doc).agg(F.count_distinct("file").alias("n_files"))
    if agents is None:
        return each.withColumn("is_agent_file", F.lit(False))
    marked = agents.select(doc).distinct().withColumn("_agent", F.lit(True))
    return each.join(marked, doc, "left").select(doc, "n_files", F.coalesce("_agent", F.lit(False)).alias("is_agent_file"))


def orphans(files: DataFrame, found: DataFrame, file: str = "file") -> DataFrame:
    """Files that no document names."""
    return files.select(F.col(file).alias("file")).distinct().join(found.select("file"), "file", "left_anti")


def mentions(docs: DataFrame, doc: str, text: str, changed: DataFrame, most: int = SENT) -> DataFrame:
    """``changed, doc``: documents that name a changed one by its base name, or by its stem in a link of double brackets; not itself."""
    base = base_name(F.col(doc))
    stem = F.regexp_replace(base, r"(?i)\.md$", "")
    ways = F.array(base, *[F.concat(F.lit("[["), stem, F.lit(end)) for end in ("#", "|", "]")])
    forms = changed.select(F.col(doc).alias("changed"), base.alias("base"), F.explode(ways).alias("pattern")).where("base <> ''").distinct()
    hits = found_in(docs, [doc], text, forms, most=most).join(forms, "pattern")
    return hits.where((F.col(doc) != F.col("changed")) & (F.col(doc) != F.col("base"))).select("changed", doc).distinct()


def unnamed(required: DataFrame, texts: DataFrame, key: str, text: str, most: int = SENT) -> DataFrame:
    """Required names that stand in no text, whatever their number."""
    names = required.select(key).where(F.col(key).isNotNull()).distinct()
    plain, others = _wanted(names, key)
    digested = texts.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("_digest"), F.col(text).alias("_text"))
    seen = _by_grams(digested, ["_digest"], others, most).select(F.col("pattern").alias(key))
    if not plain.isEmpty():
        words = _words(digested, "_text")  # most names are words, and only the rest is looked for within them
        rest = stored(plain.join(words.select(F.col("word").alias("pattern")), "pattern", "left_anti"), f"{work_folder(texts.sparkSession, 'rest')}/all")
        held = _by_grams(words, ["word"], rest, most).select("pattern")
        plain = rest.join(held, "pattern", "left_anti")
    rest = plain.unionAll(others).select(F.col("pattern").alias(key)).join(seen, key, "left_anti")
    return rest.unionAll(names.where(F.col(key) == ""))  # an empty name has no hits

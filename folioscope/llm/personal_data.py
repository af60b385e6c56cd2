"""Personal data by base patterns and boosted trees, in DataFrame functions only.

Generators propose spans, overlapping as they may: the base patterns, and wider
ones for written-out addresses and for digits in any grouping. Each proposal has
format and context features in a few bins, and their counts by feature values (a
table bounded by the bins) train gradient-boosted trees on the driver.

A proposal of the documents is labelled where a base pattern decides on its form:
right if that has the same span, else wrong. Forms that no base pattern can have
(``(at)``, numbers without a plus, cards in other groups) are labelled by the small
table ``LABELLED``; in the documents they count neither way. Thresholds are calibrated
on what would be added, over a third of the documents and of that table. The trees
become one column expression that scores all. Base spans always stay; the method adds.

Defined results: a null text is empty; rows are taken one by one, so repeated
rows and ids give repeated results, and of equal scores all are added or none; a text
of any length is searched whole; other columns don't matter, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import work_dir, written

KINDS = ("email", "ip", "card", "phone")
# Possessive forms of the base patterns, begun only where a run begins or the last match ended: the same matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of these has none of the pattern.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Wider generators: written-out addresses, and digits in any grouping.
WIDE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+)+",
    "number": r"(?<![0-9])[+(]{0,2}[0-9](?:[\x20().\-/]{0,3}[0-9]){8,18}+(?![0-9])",
}
WIDE_HINTS = {"email": r"@|[(\[{]at[)\]}]", "number": r"[0-9][\x20().\-/]{0,3}[0-9]"}
CONTEXT = r"(?i)(?:tel|phone|call|fax|mobil|handy|card|visa|karte|carte|tarjeta|konto|account|iban|mail|contact|kontakt|ip|host|server)\W{0,4}\w{0,8}\W{0,3}$"
CONTEXT_CHARS = 24
#: Feature -> number of bins; their product bounds the table of counts.
BINS = {"digits": 7, "plus": 2, "brackets": 2, "dots": 3, "dashes": 2, "spaces": 3, "context": 2, "left": 2, "right": 2, "letters": 2, "luhn": 2, "ending": 2}
#: Texts with forms beyond the base patterns; what is personal stands in double angle brackets.
LABELLED = (
    "write to <<joe(at)mail.org>> for details", "my mail is <<anna.berg [at] firma.de>> today", "<<info{at}shop.example>> answers", "contact: <<kim (at) example (dot) org>>",
    "reach <<j.doe(at)uni(dot)edu>> or visit", "e-mail <<lee_w[at]post[dot]net>>.", "ask <<office (at) stadt.de>>, please", "mail <<max%x(at)host.co>> soon", "send it to <<pat[at]lists.site.fr>>",
    "sure, <<ana(at)correo.es>> works", "kontakt <<uwe (at) verein (dot) de>> heute", "the address <<sam [at] mail.com>> is old", "meet me (at) home. Then we go", "we stay [at] work. Next week",
    "look (at) this. And that", "he was (at) school. She left", "f(at) x. Y", "sold {at} cost. Prices rose", "met (at) noon. Later", "three (at) most. Four",
    "Tel. <<030 123 45 67>> after six", "phone <<(555) 010-9999>> now", "call <<555-010-9999>> today", "Handy: <<0171/123 45 67>>", "fax <<0049 30 1234567>> or post", "mobil <<0151 2345678>>",
    "call me: <<(030) 123-4567>>", "phone: <<555.010.1234>>", "Tel: <<01 44 55 66 77>>", "tel <<91 123 45 67 89>>", "ring <<(212) 555-0187>> at night", "our office, <<(415) 555-0132>>, is open",
    "phone <<0800 123 4567>>", "Telefon: <<089/1234-5678>>", "at <<(808) 555-0100>> since May", "tel. <<02 33 44 55 66>>",
    "born 2023-04-05 12 days late", "from 2019-01-01 2020-01-01 on", "ISBN 978-3-16-148410-0 sold", "ISBN 978 0 306 40615 7", "order 1234567890 shipped", "id=1234567890123;", "a total of 1 000 000 000 users",
    "1.234.567.890 people", "since 1700000000 seconds", "pages 100-200-300", "ticket 123456789", "part no 555-123-456-78", "x1234567890y", "ref 20-30-40-50-60", "value 3141592653", "2024/01/31 23/59",
    "build 2024.01.31.1159", "serial 99 88 77 66 55 44", "sum 12.345.678,90 and 123.456.789", "lot 0123456789 of",
    "card <<4111.1111.1111.1111>> ok", "Karte <<5500/0000/0000/0004>>", "visa <<4012.8888.8888.1881>>", "carte <<4222 - 2222 - 2222 - 2220>>", "card: <<3782.822463.10005>>", "<<6011.1111.1111.1117>> was charged", "tarjeta <<5105/1051/0510/5100>>",
    "card 4111.1111.1111.1112 is wrong", "stamp 20240131235959", "run 2024-01-31 23.59.59", "number 1234.5678.9012.3456", "trace 8007782375593431", "code 5500/0000/0000/0005", "batch 1111.2222.3333.4445", "key 99999999999999",
)


@dataclass(frozen=True)
class Settings:
    trees: int = 30
    depth: int = 3
    rate: float = 0.3
    precision: float = 0.95
    weight: int = 5  # a proposal of LABELLED counts as so many of a document


def _placed(text: Column, pattern: str, hint: str, valid: Callable[[Column], Column]) -> Column:
    """Matches as ``array<struct<start, end, match>>`` in code points; invalid ones are dropped without another try."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    empty = F.expr("CAST(array() AS array<struct<start:int,end:int,match:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")))
        return F.struct(end.alias("at"), F.when(x["match"].isNotNull() & valid(x["match"]), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(hint), found).otherwise(empty)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, k: Column) -> Column:
        own = F.substring(F.reverse(digits), k, F.lit(1)).cast("int")
        twice = own * 2
        return total + F.when(k % 2 == 1, own).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _small_parts(x: Column) -> Column:
    def small(part: Column) -> Column:
        own = F.ltrim(part, F.lit("0"))
        return (F.length(own) <= 3) & (F.coalesce(F.expr("1") * F.when(F.length(own) <= 3, F.concat(F.lit("0"), own)).cast("int"), F.lit(999)) <= 255)

    return F.forall(F.split(x, r"\."), small)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda x: F.lit(True),
    "ip": _small_parts,
    "card": lambda x: F.length(_digits(x)).between(14, 19) & F.when(F.length(_digits(x)).between(14, 19), _luhn(_digits(x))).otherwise(False),
    "phone": lambda x: F.length(_digits(x)).between(10, 15),
}


def _proposals(text: Column, name: str) -> Column:
    """A wide generator's spans with their kind and features."""

    def described(x: Column) -> Column:
        n = F.length(_digits(x["match"]))
        plus = x["match"].startswith("+")
        dots = F.length(x["match"]) - F.length(F.replace(x["match"], F.lit("."), F.lit("")))
        spaces = F.length(x["match"]) - F.length(F.replace(x["match"], F.lit(" "), F.lit("")))
        kind = F.lit("email") if name == "email" else F.when(plus | (n < 14), F.lit("phone")).otherwise(F.lit("card"))
        kind = kind if name == "email" else F.when((dots == 3) & (n <= 12) & ~plus & (spaces == 0), F.lit("ip")).otherwise(kind)
        before = F.substring(text, F.greatest(F.lit(1), x["start"] + 1 - CONTEXT_CHARS), F.least(F.lit(CONTEXT_CHARS), x["start"]))
        bins = {
            "digits": F.when(n < 9, 0).when(n == 9, 1).when(n < 12, 2).when(n < 14, 3).when(n == 16, 5).when(n < 16, 4).otherwise(6),
            "plus": plus.cast("int"),
            "brackets": x["match"].rlike(r"[(\[{]").cast("int"),
            "dots": F.when(dots == 0, 0).when(dots == 3, 2).otherwise(1),
            "dashes": x["match"].contains("-").cast("int"),
            "spaces": F.least(F.lit(2), spaces),
            "context": before.rlike(CONTEXT).cast("int"),
            "left": F.substring(text, x["start"], F.when(x["start"] > 0, 1).otherwise(0)).rlike(r"[A-Za-z0-9_.=\"-]").cast("int"),
            "right": F.substring(text, x["end"] + 1, F.lit(1)).rlike(r"[A-Za-z0-9_=\"-]").cast("int"),
            "letters": x["match"].rlike("[A-Za-z]").cast("int"),
            "luhn": VALID["card"](x["match"]).cast("int"),
            "ending": x["match"].rlike(r"(?:[^ ]\.|[)\]] ?)[a-z]{2,7}$").cast("int"),
        }
        return F.struct(kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), *[bins[b].alias(b) for b in BINS])

    return F.transform(_placed(text, WIDE[name], WIDE_HINTS[name], lambda x: F.lit(True)), described)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def proposed(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fold, base, wide`` of every row: base spans, and proposals that aren't base spans or are confirmed by one."""
    body = F.coalesce(F.col("text"), F.lit(""))
    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    base = F.concat(*[_spans(_placed(body, PATTERNS[k], HINTS[k], VALID[k]), k) for k in KINDS])
    wide = F.concat(_proposals(body, "email"), _proposals(body, "number"))
    return source.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3).cast("int").alias("fold"), base.alias("base"), wide.alias("wide"))


Tree = float | tuple[str, int, "Tree", "Tree"]


def _grown(rows: list[dict], depth: int) -> Tree:
    """A regression tree on gradients (one Newton step a leaf) over binned features."""
    g, h = sum(r["g"] for r in rows), sum(r["h"] for r in rows)
    best: tuple[float, str, int] | None = None
    if depth:
        for f, bins in BINS.items():
            for cut in range(bins - 1):
                lg = sum(r["g"] for r in rows if r[f] <= cut)
                lh = sum(r["h"] for r in rows if r[f] <= cut)
                if lh < 1e-3 or h - lh < 1e-3:
                    continue
                gain = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, cut)
    if best is None:
        return g / (h + 1)
    _, f, cut = best
    return f, cut, _grown([r for r in rows if r[f] <= cut], depth - 1), _grown([r for r in rows if r[f] > cut], depth - 1)


def _value(tree: Tree, row: dict) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def boosted(rows: list[dict], s: Settings) -> tuple[float, list[Tree]]:
    """Log-odds start and trees; rows have ``n`` proposals of which ``y`` are confirmed."""
    n, y = sum(r["n"] for r in rows), sum(r["y"] for r in rows)
    start = math.log((y + 0.5) / (n - y + 0.5))
    score, trees = [start] * len(rows), []
    for _ in range(s.trees):
        for r, z in zip(rows, score, strict=True):
            p = 1 / (1 + math.exp(-z))
            r["g"], r["h"] = r["y"] - r["n"] * p, r["n"] * p * (1 - p)
        trees.append(_grown(rows, s.depth))
        score = [z + s.rate * _value(trees[-1], r) for z, r in zip(score, rows, strict=True)]
    return start, trees


def _scored(x: Column, start: float, trees: list[Tree], rate: float) -> Column:
    def of(tree: Tree) -> Column:
        return F.when(x[tree[0]] <= tree[1], of(tree[2])).otherwise(of(tree[3])) if isinstance(tree, tuple) else F.lit(float(tree))

    total = F.lit(start)
    for t in trees:
        total = total + F.lit(rate) * of(t)
    return total


#: Of a proposal ``x``, by its kind: whether a base pattern decides on its form.
JUDGED = {"email": "x.brackets = 0 AND x.spaces = 0", "ip": "true", "card": "x.dots = 0 AND x.brackets = 0", "phone": "x.plus = 1 OR x.left = 1 OR x.right = 1"}


def _counted(each: DataFrame, held: Column, right: Column) -> list[dict]:
    """Proposals ``x`` by feature values: how many, and how many are right."""
    columns = [held.alias("held"), F.col("x.kind").alias("kind"), *[F.col(f"x.{b}").alias(b) for b in BINS], right.cast("int").alias("y")]
    return [r.asDict() for r in each.select(*columns).groupBy("held", "kind", *BINS).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()]


def labelled(spark: SparkSession) -> list[dict]:
    """Counted proposals of LABELLED, every third text being held out."""
    rows = []
    for k, marked in enumerate(LABELLED):
        start, end = marked.find("<<"), marked.find(">>") - 2
        rows.append(F.struct(F.lit(k).alias("k"), F.lit(marked.replace("<<", "").replace(">>", "")).alias("text"), F.lit(start).alias("start"), F.lit(end).alias("end")))
    texts = spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    each = texts.select("k", "start", "end", F.explode(F.concat(_proposals(F.col("text"), "email"), _proposals(F.col("text"), "number"))).alias("x"))
    return _counted(each, F.col("k") % 3 == 1, (F.col("x.start") == F.col("start")) & (F.col("x.end") == F.col("end")))


def selectors(found: DataFrame, s: Settings) -> dict[str, tuple[float, list[Tree], float]]:
    """By kind: the trees, and the lowest score from which what would be added is precise in the calibration fold.

    Confirmed proposals train but don't calibrate: they are base spans already.
    """
    each = found.select("fold", "base", F.explode("wide").alias("x"))
    confirmed = F.exists("base", lambda b: (b["kind"] == F.col("x.kind")) & (b["start"] == F.col("x.start")) & (b["end"] == F.col("x.end")))
    judged = F.lit(False)
    for kind, condition in JUDGED.items():
        judged = judged | ((F.col("x.kind") == kind) & F.expr(condition))
    known = each.withColumn("right", confirmed).where(F.col("right") | judged)
    rows = _counted(known, F.col("fold") == 1, F.col("right"))
    extra = labelled(found.sparkSession)
    out = {}
    for kind in KINDS:
        of_kind = lambda rows, held: sorted((r for r in rows if r["kind"] == kind and r["held"] == held), key=lambda r: [r[b] for b in BINS])  # noqa: E731, B023
        train = of_kind(rows, False) + [{**r, "n": s.weight * r["n"], "y": s.weight * r["y"]} for r in of_kind(extra, False)]
        if not train:
            continue
        start, trees = boosted(train, s)
        wrong = [{**r, "n": r["n"] - r["y"], "y": 0} for r in of_kind(rows, True)]
        scored = sorted(((start + s.rate * sum(_value(t, r) for t in trees), r["n"], r["y"]) for r in wrong + of_kind(extra, True) if r["n"]), reverse=True)
        n = y = 0
        cut = math.inf
        for k, (z, more, right) in enumerate(scored):
            n, y = n + more, y + right
            if (k + 1 == len(scored) or scored[k + 1][0] < z) and y >= s.precision * n:
                cut = z
        if cut < math.inf:
            out[kind] = (start, trees, cut - 1e-9)
    return out


def _joined(spans: Column) -> Column:
    """Spans as text, by start, then kind as listed, then end."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], F.array_position(order, x["kind"]), x["end"], x["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """``doc_id, base, spans`` of every row, spans being ``array<struct<kind, start, end>>``."""
    found = written(proposed(df, doc_id, text), f"{work_dir(df.sparkSession, 'personal-data')}/proposed")
    chosen = selectors(found, s)

    def wanted(x: Column) -> Column:
        out = F.lit(False)
        for kind, (start, trees, cut) in chosen.items():
            out = out | ((x["kind"] == kind) & (_scored(x, start, trees, s.rate) >= cut))
        return out

    added = F.transform(F.filter("wide", wanted), lambda x: F.struct(x["kind"], x["start"], x["end"]))
    return found.select("doc_id", "base", F.array_distinct(F.concat("base", added)).alias("spans"))


def summarised(spans: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans as text."""
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(df: DataFrame, doc_id: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """``doc_id, text`` with every span replaced by its kind in brackets, overlaps as one."""
    keyed = df.select(F.struct(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body")).alias("row"), F.col(text).alias("text"))
    both = personal_spans(keyed, "row", "text", s).withColumnRenamed("doc_id", "row")
    order = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"], x["end"], x["kind"].alias("kind"))))
    body = F.col("row.body")

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(body, acc["at"] + 1, F.greatest(F.lit(0), x["start"] - acc["at"]))
        mark = F.when(x["start"] >= acc["at"], F.concat(F.lit("["), x["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], gap, mark).alias("out"))

    done = F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    rest = F.substring("row.body", F.col("done.at") + 1, F.length("row.body"))
    return both.select("row", done.alias("done")).select(F.col("row.id").alias(doc_id), F.concat("done.out", rest).alias(text))

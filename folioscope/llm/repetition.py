"""Periodic runs of words, found by divide and conquer.

The words of a text become numbers. A text is cut at its middle word, its halves
at theirs, and so on; all texts of a batch go down level by level together. A run
that is at least ``times`` periods long and crosses a middle shows as equal words
at the distance of its period to the right or left of it. How far they are equal,
in both directions, are values of two Z-functions of the piece at its middle. A
value can only matter if it is 8 words at least (``_shortest``), so all distances
of all middles are first held against their first words; the pieces where some
distance passes get the whole Z-functions, which take time linear in the piece.
Runs that a higher middle has found are cut off at a piece's border and dropped
here; of equal intervals the smallest period stays.

A text is worked on as a whole, in one task: some 40 bytes of memory a word.

Defined results: null, empty and blank texts have no words and no runs; a text of
one word over and over is one run of period 1; repeated rows each have their own
result; columns of ``df`` that are named like a result are replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import carried, trimmed

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words that are worked on together (more only where one text has more).
TOGETHER = 200_000
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)


def z_function(a: list[int]) -> list[int]:
    """For each position the length of the longest prefix of ``a`` that starts there."""
    n = len(a)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and a[k] == a[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def _shortest(least: int, times: int) -> int:
    """Words that are equal on the longer side of a middle, at least, for any period.

    A run of period q has ``max(least, times * q) - q`` equal pairs in all.
    """
    return min(-(-(max(least, times * q) - q) // 2) for q in range(1, least + 1))


def _equal_for(s: np.ndarray, x: np.ndarray, y: np.ndarray, step: int, low: np.ndarray, high: np.ndarray, words: int) -> np.ndarray:
    """Which pairs of positions agree on the ``words`` words from them on, in the direction of ``step``."""
    at = np.arange(len(x))
    for j in range(words):
        a, b = x[at] + j * step, y[at] + j * step
        inside = (a >= low[at]) & (b < high[at])
        at, a, b = at[inside], a[inside], b[inside]
        at = at[s[a] == s[b]]
    return at


def _crossing(words: list[int], lo: int, mid: int, hi: int, qs: list[tuple[int, bool]], least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """``start, end, period`` within the piece, for periods ``q`` to the right (or left) of its middle."""
    forward = z_function([*words[mid:hi], -1, *words[lo:hi]])
    backward = z_function([*words[lo:mid][::-1], -1, *words[lo:hi][::-1]])
    f0, b0 = hi - mid + 1 - lo, mid - lo + 1 + hi - 1
    for q, right in qs:
        x, y = (mid, mid + q) if right else (mid - q, mid)
        other = y if right else x
        f = forward[f0 + other] if other < hi else 0
        b = backward[b0 - (other - 1)] if other > lo else 0
        if q + f + b >= max(least, times * q):
            yield x - b, y + f, q


def runs_of(s: np.ndarray, ends: np.ndarray, least: int = 24, times: int = 3) -> dict[int, list[tuple[int, int, int]]]:
    """The runs of each text with any: number of the text -> ``(start, length, period)`` by start, then period.

    ``s`` has the words' numbers, text after text; ``ends`` where each text ends.
    """
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    short = _shortest(least, times)
    long_enough = np.flatnonzero(ends - begins >= least)
    text, lo, hi = long_enough, begins[long_enough], ends[long_enough].astype(np.int64)
    found: dict[int, dict[tuple[int, int], int]] = defaultdict(dict)
    while len(lo):
        mid, most = (lo + hi) // 2, (hi - lo) // times
        piece = np.repeat(np.arange(len(lo)), most)
        q = np.arange(len(piece)) - np.repeat(np.cumsum(most) - most, most) + 1
        middle, low, high = mid[piece], lo[piece], hi[piece]
        wanted: dict[int, set[tuple[int, bool]]] = defaultdict(set)
        for right, x in ((True, middle), (False, middle - q)):
            y = x + q
            for at in (_equal_for(s, x, y, 1, low, high, short), _equal_for(s, x - 1, y - 1, -1, low, high, short)):
                for k, period in zip(piece[at].tolist(), q[at].tolist(), strict=True):
                    wanted[k].add((period, right))
        for k, qs in wanted.items():
            a, b, t = int(lo[k]), int(hi[k]), int(text[k])
            first, last = int(begins[t]), int(ends[t])
            for start, end, period in _crossing(s[a:b].tolist(), 0, int(mid[k]) - a, b - a, sorted(qs), least, times):
                start, end = start + a, end + a
                goes_on = start == a and start > first and s[start - 1] == s[start - 1 + period] or end == b and end < last and s[end] == s[end - period]
                if not goes_on:
                    old = found[t].get((start - first, end - first), period)
                    found[t][start - first, end - first] = min(old, period)
        text, lo, hi = np.concatenate([text, text]), np.concatenate([lo, mid]), np.concatenate([mid, hi])
        keep = hi - lo >= least
        text, lo, hi = text[keep], lo[keep], hi[keep]
    return {t: sorted((a, b - a, p) for (a, b), p in own.items()) for t, own in found.items()}


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by a space, of each run only its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return " ".join(words) if keep.all() else " ".join([words[i] for i in np.flatnonzero(keep)])


def _slices(column: pa.Array) -> Iterator[tuple[int, list[list[str]]]]:
    """Rows from a place on, as words, TOGETHER of them."""
    at, rows, n = 0, [], 0
    for k in range(len(column)):
        rows.append(_WORD.findall(column[k].as_py() or ""))
        n += len(rows[-1])
        if n >= TOGETHER:
            yield at, rows
            at, rows, n = k + 1, [], 0
    if rows:
        yield at, rows


def repetitions(df: DataFrame, text: str = "text", carry: list[str] | None = None, least: int = 24, times: int = 3) -> DataFrame:
    """The columns of ``carry`` (all but the text by default), ``n_words``, ``runs`` and ``collapsed``.

    A run is a stretch of at least ``least`` words and ``times`` times its
    smallest period, which no neighbouring word continues. ``collapsed`` has the
    words that stay when each run is cut to its first period.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has at least two words and two periods")
    names = ("n_words", "runs", "collapsed")
    carry = carried(df, carry, (text, *names))
    schema = T.StructType([*[df.schema[c] for c in carry], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in _slices(batch.column(len(carry))):
                number: defaultdict[str, int] = defaultdict(count().__next__)
                sizes = np.array([len(w) for w in rows], np.int64)
                s = np.fromiter((number[w] for own in rows for w in own), np.int32, sizes.sum())
                found = runs_of(s, np.cumsum(sizes), least, times)
                runs = [found.get(k, []) for k in range(len(rows))]
                texts = [collapsed(w, r) for w, r in zip(rows, runs, strict=True)]
                listed = pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in runs], kind)
                part = batch.slice(at, len(rows))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sizes), listed, pa.array(texts, pa.string())], names=schema.names)

    return df.select(*carry, F.col(text).alias("_text")).mapInArrow(lambda b: trimmed(find(b)), schema)


def with_planted(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` where texts whose ``crc32(doc_id)`` is a multiple of 10 go on periodically from some word on.

    With ``h`` that number and ``g = h div 10``, each word from ``a = g % n`` on
    becomes word ``a + (i - a) % p``, ``p = 1 + (n - a) div (3 + g % 8)``. A null
    id, and a text without words, change nothing.
    """
    space = F.lit(" \t\n\x0b\x0c\r")
    h = F.crc32(F.col(doc_id).cast("string"))
    chosen = df.withColumn(text, F.btrim(text, space)).where((h % 10 == 0) & (F.col(text) != ""))
    others = df.where(F.coalesce(h % 10 != 0, F.lit(True)) | (F.coalesce(F.btrim(text, space), F.lit("")) == ""))
    words, g = F.split(text, r"[\x20\x09-\x0D]+"), F.floor(h / 10)
    n = F.size(words)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    turns = F.ceil((n - a) / p).cast("int")
    planted = F.concat(F.slice(words, 1, a), F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), turns)), F.lit(1), n - a))
    return others.unionByName(chosen.withColumn(text, F.concat_ws(" ", planted)))


def _over(a: Column, b: Column) -> Column:
    """Whether run ``a`` has more periods than ``b``; of equal ones the first in order stays."""
    return a["length"] * b["period"] > b["length"] * a["period"]


def summarised(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """A row a document: the number of runs, the one with most periods and digests of all runs and of the words that stay."""
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(_over(r, b), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        F.col(doc_id).alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"), digest(F.concat_ws("", lines)).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256")
    ).select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )

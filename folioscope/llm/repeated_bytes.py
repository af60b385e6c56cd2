"""Stretches of bytes that occur elsewhere, by a depth-limited radix sort of suffixes.

Every suffix counts only through its first ``length`` bytes, its window. Windows
are sorted by digits, most significant first, and one that is alone after a digit
goes no further; those that are equal to the last digit are the repeated ones.

The first digit deals windows out to tasks and must lose most of them, for there
is a window a byte. It is the window's anchor: of its grams (``gram`` bytes each)
the one with the smallest hash, the first of equal ones. The anchor depends on the
window's bytes alone, so equal windows have it in the same place, and neighbouring
windows share it: a span of them is one row. The second digit is a digest of the
whole span: rows that agree in it have all windows in common, so that copies, in
whatever number, are one row from there on. What is left (anchors whose spans
differ) is sorted in tasks, by digits of 8 bytes, through the whole window. An
anchor with more than ``hot`` different spans (the border of a passage that many
documents hold) is not brought together in one task: its windows are counted by
their digest.

So all that is shuffled is a row for some 70 bytes of text, then a few of those;
texts stay where they are as long as what is sent to them is under SENT bytes, and
are shuffled beyond that. Texts of more than PIECE bytes are cut up into pieces
that overlap, so memory does not grow with them but for the text itself. Anchors'
hashes have 64 bits and digests of spans 64 more; all other comparisons are of
bytes, those of hot anchors of 128-bit digests.

Defined results: a null text is empty; windows never reach across documents; a
text shorter than ``length`` keeps all; copies of a document lose all of their
bytes in every copy, repeated rows and ids too; columns of ``df`` that are named
like a result are replaced; an empty table gives an empty result. A text of few
different bytes can have an anchor at every byte: a row a byte at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import ROW_KEY, carried, trimmed, with_row_key, work_dir, written

#: Bytes worked on together, and bytes of lists that are sent to all tasks at most.
PIECE, SENT = 1 << 20, 64 << 20
#: Bytes of spans sorted together, unless one anchor has more.
SORTED_TOGETHER = 2 << 20
#: Different spans of an anchor that one task sorts.
HOT = 2000
_BASE, _MUL = 0xD6E8FEB86659FD93, np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64(PIECE - 1)
_OCCURRENCE = "h long, d long, file long, row long, place long"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Anchors:
    """Finds the anchors of windows; holds the powers that rolling hashes need."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.up, self.down = _powers(_BASE, PIECE), _powers(pow(_BASE, -1, 1 << 64), PIECE)

    def hashes(self, x: np.ndarray) -> np.ndarray:
        n, k = len(x), self.gram
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        g = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
        g = (g ^ (g >> np.uint64(31))) * _MUL
        return g ^ (g >> np.uint64(29))

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window of ``x`` the place of its anchor, and the hashes of all grams."""
        g, wide = self.hashes(x), self.length - self.gram + 1
        key = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
        blocks = np.full(-(-len(key) // wide) * wide, ~np.uint64(0))
        blocks[: len(key)] = key
        blocks = blocks.reshape(-1, wide)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(after[: len(key) - wide + 1], before[wide - 1 : len(key)])
        return (least & _PLACE).astype(np.int64), g

    def spans(self, pieces: list[tuple[int, int, bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
        """``document, h, d, place`` of the spans in ``(document, place in it, bytes)`` pieces of PIECE bytes in all."""
        data = b"".join(p for _, _, p in pieces)
        if len(data) < self.length:
            return
        anchor, g = self.of(np.frombuffer(data, np.uint8))
        sizes = np.array([len(p) for _, _, p in pieces])
        ends = np.cumsum(sizes)
        piece = np.repeat(np.arange(len(pieces)), sizes)[: len(anchor)]
        start = np.flatnonzero(np.arange(len(anchor)) + self.length <= ends[piece])
        anchor, piece = anchor[start], piece[start]
        if not len(start):
            return
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])]))
        n = np.diff(np.append(first, len(start)))
        lo, at = start[first], anchor[first]
        digests = b"".join([hashlib.blake2b(data[a:b], digest_size=8).digest() for a, b in zip(lo.tolist(), (lo + n - 1 + self.length).tolist(), strict=True)])
        of = piece[first]
        own = lo - (ends - sizes)[of] + np.array([p for _, p, _ in pieces], np.int64)[of]
        yield np.array([d for d, _, _ in pieces])[of], g[at].view(np.int64), np.frombuffer(digests, "<i8"), _packed(own, n, at - lo)


def _packed(start: np.ndarray, n: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """First window, number of windows and the anchor's offset in the first, as one number."""
    return start << 32 | n << 16 | offset


def _pieces(texts: list[bytes | None], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """All texts in pieces that overlap by a window less a byte, PIECE bytes together at most."""
    own, n = [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t or b"") - length + 1), PIECE - length + 1):
            p = (t or b"")[at : at + PIECE]
            if len(p) < length:
                continue
            if n + len(p) > PIECE:
                yield own
                own, n = [], 0
            own.append((k, at, p))
            n += len(p)
    if own:
        yield own


def _occurrences(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """A row a span: the hash of its anchor, the digest of its bytes and its place."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for pieces in _pieces(part.column(2).to_pylist(), length):
                    for document, h, d, place in anchors.spans(pieces):
                        of = pa.array(document)
                        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(d), part.column(0).take(of), part.column(1).take(of), pa.array(place)], names=["h", "d", "file", "row", "place"])

    return keyed.mapInArrow(lambda b: trimmed(find(b)), _OCCURRENCE)


def equal_windows(data: bytes, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows at ``starts`` equal another one of their group: a radix sort by digits of 8 bytes, most significant first."""
    digits = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    active = np.arange(len(starts))
    label = np.unique(group, return_inverse=True)[1]
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        _, digit = np.unique(digits[starts[active] + at], return_inverse=True)
        _, label, n = np.unique(label * (digit.max(initial=0) + 1) + digit, return_inverse=True, return_counts=True)
        together = n[label] > 1
        active, label = active[together], label[together]
    return active


def _sorted(spans: DataFrame, length: int) -> DataFrame:
    """``file, row, begin, end`` of stretches of repeated windows in spans that are alone with their digest."""

    def stretches(rows: list[tuple]) -> pa.RecordBatch:
        data = b"".join(r[4] for r in rows)
        h, one = np.array([r[0] for r in rows]), np.array([r[5] for r in rows])
        place = np.array([r[3] for r in rows])
        start, n, offset = place >> 32, place >> 16 & 0xFFFF, place & 0xFFFF
        begin = np.cumsum([0, *[len(r[4]) for r in rows]])[:-1]
        of = np.repeat(np.arange(len(rows)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        bucket = np.unique(h, return_inverse=True)[1][of] << 16 | (offset[of] - k)
        hit = np.sort(equal_windows(data, begin[of] + k, bucket, length))
        hit = hit[one[of[hit]]]
        new = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])])) if len(hit) else hit
        last = np.append(new[1:], len(hit)) - 1 if len(hit) else hit
        own = of[hit[new]]
        columns = [np.array([r[c] for r in rows], np.int64)[own] for c in (1, 2)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(start[own] + k[hit[new]]), pa.array(start[own] + k[hit[last]] + length)], names=["file", "row", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size > SORTED_TOGETHER and r[0] != waiting[-1][0]:
                    yield stretches(waiting)
                    waiting, size = [], 0
                waiting.append(r)
                size += len(r[4])
        if waiting:
            yield stretches(waiting)

    dealt = spans.select("h", "file", "row", "place", "span", "one").repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(lambda b: trimmed(run(b)), "file long, row long, begin long, end long")


def _counted(spans: DataFrame, length: int) -> DataFrame:
    """The same by counting windows by digest: copies are added up before they are shuffled."""
    first, n, offset = F.shiftright("place", 32), F.shiftright("place", 16).bitwiseAND(0xFFFF), F.col("place").bitwiseAND(0xFFFF)
    each = spans.select("*", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    window = F.substring("span", F.col("k").cast("int") + 1, F.lit(length))
    windows = each.select("h", (offset - F.col("k")).alias("offset"), F.unhex(F.md5(window)).alias("m"), "file", "row", "one", (first + F.col("k")).alias("begin"))
    again = windows.groupBy("h", "offset", "m").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return windows.where("one").join(again, ["h", "offset", "m"]).select("file", "row", "begin", (F.col("begin") + length).alias("end"))


def _attached(keyed: DataFrame, lists: DataFrame, column: str, row_bytes: int, how: str) -> DataFrame:
    """``keyed`` joined with a written table of lists by document, which are sent to the texts while they are under SENT bytes."""
    size = lists.agg(F.sum(F.size(column) * row_bytes + 64).alias("n")).first().n or 0
    return keyed.join(F.broadcast(lists) if size <= SENT else lists, ["file", "row"], how)


def _spans(keyed: DataFrame, members: DataFrame, length: int, base: str) -> DataFrame:
    """The bytes of each member, from its document."""
    lists = written(members.groupBy("file", "row").agg(F.collect_list(F.struct("h", "place", "m", "one")).alias("own")), f"{base}/members")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, rows = batch.slice(at, 64), []
                for file, row, text, own in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    for x in own:
                        start, n = x["place"] >> 32, x["place"] >> 16 & 0xFFFF
                        rows.append((x["h"], x["m"], file, row, x["place"], x["one"], text[start : start + n - 1 + length]))
                kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["h", "m", "file", "row", "place", "one", "span"])

    joined = _attached(keyed, lists, "own", 40, "inner").select("file", "row", "text", "own")
    return written(joined.mapInArrow(lambda b: trimmed(cut(b)), "h long, m long, file long, row long, place long, one boolean, span binary"), f"{base}/spans")


def merged(begins: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """The union of stretches, as maximal ones in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(begins, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


_STRETCHES = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _by_document(stretches: DataFrame, base: str) -> DataFrame:
    """``file, row, removed``: the union of each document's stretches."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[{"begin": a, "end": b} for a, b in merged(*x)] for x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, _STRETCHES)], names=["file", "row", "removed"])

    lists = stretches.groupBy("file", "row").agg(F.collect_list(F.struct("begin", "end")).alias("x"))
    lists = lists.select("file", "row", "x.begin", "x.end")
    return written(lists.mapInArrow(lambda b: trimmed(unite(b)), "file long, row long, removed array<struct<begin:long,end:long>>"), f"{base}/removed")


def without_repeats(df: DataFrame, text: str = "text", carry: list[str] | None = None, length: int = 200, hot: int = HOT) -> DataFrame:
    """The columns of ``carry`` (all but the text by default), ``n_bytes``, ``removed`` and ``kept``.

    ``removed`` has the maximal stretches ``begin, end`` of bytes covered by a
    window of ``length`` bytes that also starts elsewhere, ``kept`` the other
    bytes (they may cut a character in two).
    """
    if not 8 <= length <= 4096:
        raise ValueError("windows have 8 to 4096 bytes")
    gram = max(4, length // 5)
    spark = df.sparkSession
    base = work_dir(spark, "repeats")
    carry = carried(df, carry, (text, "n_bytes", "removed", "kept"))
    source = df.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = with_row_key(source).select("*", F.col(f"{ROW_KEY}.file").alias("file"), F.col(f"{ROW_KEY}.row").alias("row")).drop(ROW_KEY)
    keyed = rows.select("file", "row", "text")

    found = written(_occurrences(keyed, length, gram), f"{base}/anchors")
    again = written(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), f"{base}/again")
    live = written(found.join(again, "h"), f"{base}/live")
    classes = live.groupBy("h", "d").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "row", "place")).alias("first"))
    classes = written(classes.select("h", "d", "n", "first.*"), f"{base}/classes")
    whole = live.join(classes.where("n > 1").select("h", "d"), ["h", "d"])  # both sides are tables, so that a skewed join can be split
    begin, n = F.shiftright("place", 32), F.shiftright("place", 16).bitwiseAND(0xFFFF)
    whole = whole.select("file", "row", begin.alias("begin"), (begin + n - 1 + length).alias("end"))
    buckets = classes.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("n") == 1).alias("ones")).where("m > 1 AND ones > 0").select("h", "m")
    buckets = written(buckets, f"{base}/buckets")
    members = classes.join(buckets, "h").select("h", "m", "file", "row", "place", (F.col("n") == 1).alias("one"))
    spans = _spans(keyed, members, length, base)
    stretches = whole.unionByName(_sorted(spans.where(F.col("m") <= hot), length)).unionByName(_counted(spans.where(F.col("m") > hot), length))
    removed = _by_document(stretches, base)

    schema = T.StructType(
        [*[df.schema[c] for c in carry], T.StructField("n_bytes", T.LongType()), T.StructField("removed", removed.schema["removed"].dataType), T.StructField("kept", T.BinaryType())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, kept = batch.slice(at, 256), []
                texts, lists = part.column(len(carry)).to_pylist(), part.column(len(carry) + 1).to_pylist()
                for t, own in zip(texts, lists, strict=True):
                    edges = [0, *[e for x in own or [] for e in (x["begin"], x["end"])], len(t)]
                    kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array([x or [] for x in lists], _STRETCHES), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], *columns], names=schema.names)

    last = _attached(rows, removed, "removed", 32, "left")
    return last.select(*[f"_c{i}" for i in range(len(carry))], "text", "removed").mapInArrow(lambda b: trimmed(cut(b)), schema)


def summarised(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    removed = F.reduce("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])
    return found.select(F.col(doc_id).alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

"""Best-fit packing of token sequences, improved by swap-based local search.

Only lengths matter to a packing, and there are at most ``capacity`` of them,
so the plan is made over the histogram of piece lengths: bins with equal
contents are one entry with a count. Best fit in decreasing order gives the
first plan. Local search then takes the emptiest bins and moves their pieces into
other underfull bins, or exchanges one for one or two for one, whenever that
increases the sum of squared fills, in sweeps over the kinds of bins until one
empties no bin; equal bins change together. The plan is made on the driver: it holds
a row for each different content of a bin, not for each document, and its work is
bounded by those kinds (10 million pieces of 500 to 1023 tokens take no longer than
100,000). It is written as a table, and
pieces find their place there by their length and their rank within it.

Defined results: null and empty texts are the end id alone; a text longer than a
sequence is cut into pieces, each packed by itself; ties between equal lengths go
by task and row; repeated rows are packed once each; other columns, whatever
their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import trimmed, work_dir, written
from .tokens import default_path, tokens

Contents = tuple[int, ...]
Bins = dict[Contents, int]
#: Pieces that a row of the written plan places at most.
PLACED = 1 << 16
#: Steps of a sweep that follow one kind of bin.
STEPS = 256


def best_fit(histogram: dict[int, int], capacity: int) -> Bins:
    """Best fit in decreasing length, over counts: contents (descending) -> bins."""
    by_room: dict[int, Counter] = {}

    def put(contents: tuple[int, ...], room: int, n: int) -> None:
        by_room.setdefault(room, Counter())[contents] += n

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        rooms = sorted(r for r in by_room if r >= size)
        while left and rooms:
            room = rooms[0]
            kinds = by_room[room]
            if not kinds:
                del by_room[room]
                rooms.pop(0)
                continue
            contents, n = next(iter(kinds.items()))
            n = min(n, left)
            kinds[contents] -= n
            if not kinds[contents]:
                del kinds[contents]
            left -= n
            put((*contents, size), room - size, n)
            if room - size >= size and room - size not in rooms:
                bisect.insort(rooms, room - size)
        each = capacity // size
        if left >= each:
            put((size,) * each, capacity - each * size, left // each)
        if left % each:
            put((size,) * (left % each), capacity - left % each * size, 1)
    return {c: n for kinds in by_room.values() for c, n in kinds.items()}


class _Underfull:
    """Bins with room, and what they could take in.

    A bin with room ``r`` that gives up ``y`` (no piece, one or two of them) can
    take a longer piece of at most ``y + r``. By that ``reach`` the bins are kept,
    the least ``y`` of each reach on top; entries of bins that are gone are
    passed over when they come up.
    """

    def __init__(self, bins: Bins, capacity: int):
        self.capacity, self.full, self.bins, self.n = capacity, Counter(), Counter(), 0
        self.reach: list[list[tuple[int, int, Contents, Contents]]] = [[] for _ in range(capacity + 1)]
        self.least = np.full(2 * capacity + 1, capacity + 1)
        self.listed: set[Contents] = set()
        self.number = 0
        for c, n in bins.items():
            self.add(c, n)

    def take(self, c: Contents, n: int) -> None:
        self.n -= n
        self.bins[c] -= n
        if not self.bins[c]:
            del self.bins[c]

    def add(self, c: Contents, n: int) -> None:
        if not c:
            return
        self.n += n
        c = tuple(sorted(c, reverse=True))
        room = self.capacity - sum(c)
        if not room:
            self.full[c] += n
            return
        if c not in self.bins and c not in self.listed:
            self.listed.add(c)
            sizes = sorted(set(c))
            outs = [()] + [(y,) for y in sizes] + [(y, z) for k, y in enumerate(sizes) for z in sizes[k:] if y != z or c.count(y) > 1]
            for y, out in {sum(out): out for out in reversed(outs)}.items():
                self.number += 1
                heapq.heappush(self.reach[room + y], (y, self.number, c, out))
                self.least[room + y] = self.reach[room + y][0][0]
        self.bins[c] += n

    def taker(self, x: int, donor: Contents) -> tuple[Contents, Contents] | None:
        """The bin that ``x`` of the donor's fills up best, and what it gives up; it gets fuller than the donor is now."""
        aside, found, room = [], None, self.capacity - sum(donor)
        while not found and len(at := np.flatnonzero(self.least[x : x + room] < x)):
            heap = self.reach[x + at[0]]
            _, _, c, out = heap[0]
            if c not in self.bins:
                heapq.heappop(heap)
                self.listed.discard(c)
            elif c == donor and self.bins[c] == 1:
                aside.append((x + at[0], heapq.heappop(heap)))
            else:
                found = c, out
            self.least[x + at[0]] = heap[0][0] if heap else self.capacity + 1
        for reach, entry in aside:
            heapq.heappush(self.reach[reach], entry)
            self.least[reach] = self.reach[reach][0][0]
        return found


def _without(c: Contents, *sizes: int) -> Contents:
    left = list(c)
    for s in sizes:
        left.remove(s)
    return tuple(left)


def _step(u: _Underfull, donor: Contents) -> Contents | None:
    """One move or exchange from the donor that raises the squared fill, for all equal bins at once: what it leaves of the donor, None if there is none."""
    for x in dict.fromkeys(donor):
        if found := u.taker(x, donor):
            other, out = found
            n = u.bins[donor] // 2 if other == donor else min(u.bins[donor], u.bins[other])
            u.take(donor, n)
            u.take(other, n)
            u.add((*_without(other, *out), x), n)
            left = tuple(sorted((*_without(donor, x), *out), reverse=True))
            u.add(left, n)
            return left
    return None


def local_search(bins: Bins, capacity: int) -> Bins:
    """Move and exchange pieces between underfull bins until bins empty or nothing helps.

    Each step changes all equal pairs of bins and raises the sum of squared
    fills. A sweep takes each kind of underfull bin once, the emptiest first, and
    goes on with what each step leaves of it, then with the bins of its kind that a
    step didn't reach, STEPS in all; it ends at once at the least number of bins that
    the lengths allow. Sweeps end with one that empties no bin. So the work is bounded
    by the kinds of bins, whatever the number of pieces.
    """
    least = -(-sum(sum(c) * n for c, n in bins.items()) // capacity)
    u = _Underfull(bins, capacity)
    full = u.full
    n_bins = lambda: u.n + sum(full.values())
    before = None
    while (now := n_bins()) > least and now != before:
        before = now
        for kind in sorted(u.bins, key=lambda c: (sum(c), c)):
            if n_bins() <= least:
                break
            stack = [kind]
            for _ in range(STEPS):
                if not stack:
                    break
                left = _step(u, stack[-1]) if stack[-1] in u.bins else None
                if left is None:
                    stack.pop()
                elif left:
                    stack.append(left)
    return dict(u.full + u.bins)


def plan(histogram: dict[int, int], capacity: int) -> tuple[Bins, dict[int, tuple[np.ndarray, ...]]]:
    """The bins and, by length, arrays (first rank, first sequence, pieces a bin, offset)."""
    whole = {k: n for k, n in histogram.items() if k < capacity}
    bins = local_search(best_fit(whole, capacity), capacity)
    if full := histogram.get(capacity):
        bins[(capacity,)] = full
    used: Counter = Counter()
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for contents in sorted(bins):
        n, offset = bins[contents], 0
        for size, each in sorted(Counter(contents).items(), reverse=True):
            rows.setdefault(size, []).append((used[size], first, each, offset))
            used[size] += n * each
            offset += size * each
        first += n
    if used != Counter({k: n for k, n in histogram.items() if n}):
        raise AssertionError("the plan doesn't hold each piece once")
    return bins, {k: tuple(np.array(v, np.int64).T) for k, v in rows.items()}


def _places(spark: SparkSession, histogram: dict[int, int], capacity: int, base: str) -> DataFrame:
    """``length, rank, sequence_id, offset`` of every piece, from the written plan."""
    _, where = plan(histogram, capacity)
    parts = []
    for size, (ranks, firsts, each, offsets) in where.items():
        n = np.diff(np.append(ranks, histogram[size]))
        cuts = -(-n // PLACED)
        part = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        row = np.repeat(np.arange(len(n)), cuts)
        parts.append(np.stack([np.full(len(row), size), ranks[row], firsts[row], each[row], offsets[row], part * PLACED, np.minimum(n[row], (part + 1) * PLACED)]))
    names = ["length", "first", "sequence", "each", "at", "begin", "end"]
    columns = np.concatenate(parts, axis=1) if parts else np.empty((len(names), 0), np.int64)
    table = pa.table({x: pa.array(c) for x, c in zip(names, columns.astype(np.int64), strict=True)})
    # dealt with its own columns as key: an equal share of rows, not of pieces, each
    rows = written(spark.createDataFrame(table), f"{base}/plan").repartition("length", "first", "begin")
    piece = rows.select("*", F.explode(F.sequence("begin", F.col("end") - 1)).alias("k"))
    sequence = F.col("sequence") + F.floor(F.col("k") / F.col("each"))
    return piece.select(
        "length", (F.col("first") + F.col("k")).alias("rank"), sequence.cast("long").alias("sequence_id"), (F.col("at") + F.col("k") % F.col("each") * F.col("length")).alias("offset")
    )


def pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of every text: ``doc_id, piece, start, length, ids_crc32[, ids], task, number``.

    ``task`` and ``number`` (among the task's pieces of this length) give each
    piece a rank within its length without a shuffle of the pieces.
    """
    path = tokenizer or default_path()
    ids = [T.StructField("ids", T.BinaryType())] if with_ids else []
    longs = [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]
    schema = T.StructType(
        [T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("piece", T.IntegerType()), *longs, *ids, T.StructField("task", T.IntegerType()), T.StructField("number", T.LongType())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, of = TaskContext.get().partitionId(), Counter(), tokens(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, piece, start, length, crc, kept, number = [], [], [], [], [], [], []
                for k, own in enumerate(of.encode([t or "" for t in part.column(1).to_pylist()])):
                    own += end
                    for p, lo in enumerate(range(0, len(own), 4 * capacity)):
                        x = own[lo : lo + 4 * capacity]
                        row.append(k)
                        piece.append(p)
                        start.append(lo // 4)
                        length.append(len(x) // 4)
                        crc.append(zlib.crc32(x))
                        number.append(seen[len(x) // 4])
                        seen[len(x) // 4] += 1
                        if with_ids:
                            kept.append(x)
                columns = [part.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
                columns += [pa.array(kept, pa.binary())] if with_ids else []
                columns += [pa.array([task] * len(row), pa.int32()), pa.array(number, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return df.select(doc_id, text).mapInArrow(lambda b: trimmed(cut(b), "tokens"), schema)


def packed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces with their place: ``sequence_id`` and ``offset`` within it."""
    spark = df.sparkSession
    base = work_dir(spark, "packing")
    cut = written(pieces(df, doc_id, text, capacity, end_id, tokenizer, with_ids), f"{base}/pieces")
    counts = written(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), f"{base}/counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    places = _places(spark, histogram, capacity, base)
    by_task = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("n").over(by_task) - F.col("n")
    ranked = cut.join(counts.select("length", "task", before.alias("before")), ["length", "task"])
    out = [f.name for f in cut.schema.fields if f.name not in ("task", "number")]
    rows = ranked.select(*out, (F.col("before") + F.col("number")).alias("rank"))
    return rows.join(places, ["length", "rank"]).select(*out, "sequence_id", "offset")

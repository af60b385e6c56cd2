"""N-gram Jaccard join as a blocked sparse product of documents by n-grams.

The incidence matrix is never multiplied whole. Columns are ordered from rare
to frequent by estimated document frequency; two sets can only reach the
threshold if they share one of the first ``n - ceil(t * n) + 1`` columns of
each, a bound that follows from the sizes alone. Those columns are dealt out
by n-gram. Overlap counts of pairs accumulate over the columns of few sets, and
pairs below a bound derived from their sizes are discarded, as are those whose
first shared column stands too late in one of the two; in longer columns
neighbours by size hold together as far as such a first column allows. What is left forms clusters. Within a cluster the product is taken block by block over all
columns: overlap counts accumulate column chunk by column chunk, and pairs
below the bound of their sizes are discarded. Large clusters are split into
blocks of bounded bytes, each pair of blocks being a task of its own.

Sets are of 64-bit hashes of n-grams; documents of equal sets (128-bit digest)
are one class, and the product runs over classes.

Defined results: null, empty or blank texts have an empty set and link with
nothing; texts of fewer than ``k`` words have their word sequence as the only
n-gram; repeated rows and ids are separate members of a class; rows with a
null id take part, and a component of null ids only has a null id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .rows import ROW_KEY, named, numbered, spread_join, trimmed, with_row_key, without, work_dir, written

_MUL = np.uint64(0xBF58476D1CE4E5B9)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Counters of the frequency estimate: bounded, one byte each when broadcast.
COUNTER_BITS = 24
#: One in this many (document, n-gram) incidences is counted for the estimate.
THIN = 16
#: Bits of the filter of documents that are in a cluster; bounded likewise.
FILTER_BITS = 24
#: Words whose hashes a task remembers; then it starts anew.
CACHE_WORDS = 100_000


@dataclass(frozen=True)
class Limits:
    """Size of a block: bytes of its sets, and documents."""

    block_bytes: int = 16 << 20
    block_docs: int = 2048


#: Sets of a block, and entries of theirs, that are multiplied at once with as many of another.
TILE, TILE_ENTRIES = 512, 1 << 18
#: Digests that a task remembers, so that copies repeat no work; then it starts anew.
SEEN = 50_000


class WordHashes(dict):
    """64-bit hashes of words, remembered up to CACHE_WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MUL
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the k-word shingles of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    wide = min(k, len(h))
    out = np.full(len(h) - wide + 1, wide, np.uint64)
    for j in range(wide):
        out = _mix(out * _STEP + h[j : len(h) - wide + 1 + j])
    return np.unique(out)


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _class_id(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _counter(s: np.ndarray) -> np.ndarray:
    return (_mix(s * _STEP) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """log2 levels of estimated document frequency, by counter.

    All documents are counted, each incidence with a chance of 1 in THIN that
    depends on its document and n-gram only. The levels merely order columns:
    results do not depend on them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, found = batch.slice(at, 512), []
                for doc_key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = shingle_set(text, k, hashes)
                    own = _mix(np.array([doc_key], np.int64).view(np.uint64) * _STEP)
                    found.append(_counter(s[_mix(s ^ own) % np.uint64(THIN) == 0]))
                slots, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(n, pa.int64())], names=["slot", "n"])

    counted = docs.select("doc_key", "text").mapInArrow(lambda b: trimmed(count(b)), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    level = F.least(F.lit(63), F.floor(F.log2("n")).cast("int"))
    packed = counted.where("n >= 2").select((F.col("slot").cast("long") * 64 + level).alias("p"))
    got = packed.toArrow().column("p").to_numpy()
    levels = np.zeros(1 << COUNTER_BITS, np.uint8)
    levels[got >> 6] = got & 63
    return levels


def _signed(s: np.ndarray) -> pa.Array:
    return pa.array(s.view(np.int64), pa.int64())


def _sets(docs: DataFrame, k: int, percent: int, levels: np.ndarray, base: str) -> DataFrame:
    """Each row's set size, digest, class id and the leading columns of its set."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    fields = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType(
        [*fields, T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("cid", T.LongType()), T.StructField("lead", T.ArrayType(T.LongType()))]
    )
    names = [f.name for f in fields]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, of, seen = WordHashes(), shared.value, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes, digests, leads, ends = [], [], [], [0]
                for text in part.column(part.schema.get_field_index("text")).to_pylist():
                    s = shingle_set(text, k, hashes)
                    n, d = len(s), _digest(s)
                    lead = s[:0]
                    if n and d not in seen:  # the columns of a copy are those of the first
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(d)
                        order = np.argsort(of[_counter(s)], kind="stable")[: n - (percent * n + 99) // 100 + 1]
                        lead = s[order]
                    sizes.append(n)
                    digests.append(d)
                    leads.append(lead)
                    ends.append(ends[-1] + len(lead))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(np.concatenate(leads)))
                cids = [None if d is None else _class_id(d) for d in digests]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(part.schema.get_field_index(x)) for x in names], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(cids, pa.int64()), lists],
                    names=[*names, "n", "digest", "cid", "lead"],
                )

    return written(docs.mapInArrow(lambda b: trimmed(build(b)), schema), f"{base}/sets")


def _bounds(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """How many leading columns two sets that link must share, by their sizes.

    The overlap must reach ``percent / (100 + percent)`` of both sizes together.
    Beyond the shared leading columns it can't be more than what follows the
    leading columns of one of the two.
    """
    least = -(-percent * (n_a + n_b) // (100 + percent))
    rest = (percent * np.maximum(n_a, n_b) + 99) // 100 - 1
    return np.maximum(1, least - rest)


#: Columns of at most so many classes are counted pair by pair.
FEW = 32
#: Bits of the place in a posting, below those of the size, and of a size that a reach is compared with.
PLACE_BITS, SIZE_BITS = 31, 40
#: The count of a pair that stays together without one.
_ALWAYS = 1 << 40


def _near(percent: int):
    """Sorted postings (h, at, cid) -> pairs (a, b, shared, need, first) of each column.

    ``at`` is the size of a set and the place of the column among its leading ones.
    Two sets can only link if the first column that they share leaves enough columns
    after it in both; for each size and place that is a reach, the largest size of a
    partner. ``first`` says that both are within the other's reach here.

    A column of few classes gives all its pairs, to be counted; a longer one
    only links neighbours by size up to the largest reach before them, which holds
    together all its classes that can link by it as their first, and says of each class
    (as a pair with itself) that it is in one more such column. Neither keeps more than
    a batch and FEW rows.
    """

    def rows_of(a: np.ndarray, b: np.ndarray, shared: int, need: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), shared, np.int64)), pa.array(need), pa.array(first)],
            names=["a", "b", "shared", "need", "first"],
        )

    def counted(n: np.ndarray, reach: np.ndarray, cid: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        ok = (100 * n[i] >= percent * n[j]) & (cid[i] != cid[j])  # n[i] <= n[j]
        i, j = i[ok], j[ok]
        return rows_of(cid[i], cid[j], 1, _bounds(n[i], n[j], percent), (n[j] <= reach[i]) & (n[i] <= reach[j]))

    def all_pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        for c in range(2, FEW + 1):
            at = starts[sizes == c]
            if len(at):
                i, j = np.triu_indices(c, 1)
                left.append((at[:, None] + i).ravel())
                right.append((at[:, None] + j).ravel())
        return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int),) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4  # the column that the last batch ended in
        long = False  # it is a long one, of which only the last row is held, with the largest reach so far
        for batch in batches:
            own, at, ids = (c.to_numpy() for c in batch.columns)
            size = at >> PLACE_BITS
            own_reach = (100 + percent) * (size - (at & ((1 << PLACE_BITS) - 1))) // percent - size
            h, n, cid, reach = (np.concatenate(x) for x in zip(held, (own, size, ids, own_reach), strict=True))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (cid[1:] != cid[:-1])  # copies of one class
            h, n, cid, reach = h[new], n[new], cid[new], reach[new]
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            sizes = np.diff(np.append(starts, len(h)))
            many = sizes > FEW
            many[0] |= long
            whole = ~many
            whole[-1] = False
            chain = np.repeat(many, sizes)
            column = np.repeat(np.arange(len(sizes)), sizes) << SIZE_BITS
            widest = np.maximum.accumulate(column + reach) - column
            at = np.flatnonzero(chain[1:] & (h[1:] == h[:-1]) & (n[1:] <= widest[:-1]))
            yield rows_of(cid[at], cid[at + 1], _ALWAYS, np.ones(len(at), np.int64), np.ones(len(at), bool))
            yield counted(n, reach, cid, *all_pairs(starts[whole], sizes[whole]))
            chain[:1] &= not long  # a row that is held of a long column was told before
            told = cid[chain]
            yield rows_of(told, told, 1, np.ones(len(told), np.int64), np.zeros(len(told), bool))
            long = bool(many[-1])
            first = len(h) - 1 if long else starts[-1]
            held = [h[first:], n[first:], cid[first:], widest[first:] if long else reach[first:]]
        if len(held[0]) > 1:
            yield counted(held[1], held[3], held[2], *all_pairs(np.array([0]), np.array([len(held[0])])))

    return run


def _able(sets: DataFrame, percent: int, base: str) -> DataFrame:
    """``a, b``: pairs of classes that may link, or that hold others together which may.

    Columns that two classes may share without being counted are at most as many as
    the long columns of the one that has fewer.
    """
    at = F.shiftleft(F.col("n"), PLACE_BITS).bitwiseOR(F.col("place").cast("long"))
    postings = sets.select("n", "cid", F.posexplode("lead").alias("place", "h")).select("h", at.alias("at"), "cid")
    dealt = postings.repartition("h").sortWithinPartitions("h", "at", "cid")
    pairs = dealt.mapInArrow(_near(percent), "a long, b long, shared long, need long, first boolean")
    told = [F.sum("shared").alias("shared"), F.max("need").alias("need"), F.bool_or("first").alias("first")]
    counts = written(pairs.groupBy("a", "b").agg(*told).where("first OR a = b"), f"{base}/pairs")
    within = counts.where("a = b").select(F.col("a").alias("cid"), F.col("shared").alias("n_long"))
    met = counts.where("a <> b")
    longs = [within.select(F.col("cid").alias(x), F.col("n_long").alias(f"{x}_long")) for x in ("a", "b")]
    more = met.where("shared < need").join(longs[0], "a").join(longs[1], "b").where("shared + least(a_long, b_long) >= need")
    return met.where("shared >= need").select("a", "b").unionByName(more.select("a", "b"))


def _clusters(sets: DataFrame, percent: int, base: str) -> DataFrame:
    """``cid, cluster`` of all classes that may link with another."""
    edges = written(_able(sets, percent, base), f"{base}/near")
    return written(components(edges, "a", "b").select(F.col("node").alias("cid"), F.col("component").alias("cluster")), f"{base}/clusters")


def _slot(key: str) -> Column:
    return F.shiftrightunsigned(F.col(key), 64 - FILTER_BITS)


def _filter_words(rows: DataFrame) -> np.ndarray:
    """A bit for the key of each row that is in a cluster; others are passed over."""
    bits = rows.select(_slot("doc_key").alias("x")).select(
        F.shiftright("x", 5).cast("int").alias("w"), F.expr("shiftleft(1L, cast(x & 31 AS int))").alias("b")
    )
    got = bits.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(1 << (FILTER_BITS - 5), np.int64)
    words[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return words


def _entries(sets: list[np.ndarray], cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each entry that is in one of ``cols``, by column."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(cols, flat), len(cols) - 1)
    ok = cols[at] == flat
    row, at = row[ok], at[ok]
    order = np.argsort(at, kind="stable")
    return row[order], at[order]


def overlaps(sets: list[np.ndarray], others: list[np.ndarray] | None = None, chunk_cells: int = 1 << 21) -> np.ndarray:
    """Overlap counts of all pairs: the product of one incidence matrix with another (or itself, no set with itself).

    Columns of few pairs are multiplied pair by pair, the others as dense
    chunks; both add up in one table of counts.
    """
    right = sets if others is None else others
    out = np.zeros((len(sets), len(right)), np.float32)
    if others is None:
        cols, n = np.unique(np.concatenate(sets), return_counts=True)
        cols = cols[n > 1]
    else:
        cols = np.intersect1d(np.unique(np.concatenate(sets)), np.unique(np.concatenate(others)), assume_unique=True)
    if not len(cols):
        return out
    row_a, col_a = _entries(sets, cols)
    row_b, col_b = (row_a, col_a) if others is None else _entries(others, cols)
    n_a, n_b = np.bincount(col_a, minlength=len(cols)), np.bincount(col_b, minlength=len(cols))
    few = n_a * n_b * 64 <= out.size
    at = np.flatnonzero(few[col_a])
    if len(at):
        first_b, pairs = np.cumsum(n_b) - n_b, n_b[col_a[at]]
        part = (np.cumsum(pairs) - 1) >> 18
        for lo, hi in zip(*[np.searchsorted(part, np.unique(part), side=x) for x in ("left", "right")], strict=True):
            n, own = pairs[lo:hi], at[lo:hi]
            other = np.arange(n.sum()) + np.repeat(first_b[col_a[own]] - (np.cumsum(n) - n), n)
            out += np.bincount(np.repeat(row_a[own], n) * len(right) + row_b[other], minlength=out.size).reshape(out.shape)
    dense = np.flatnonzero(~few)
    wide = max(1, chunk_cells // (len(sets) + len(right)))
    for lo in range(0, len(dense), wide):
        own = dense[lo : lo + wide]
        place = np.full(own[-1] - own[0] + 1, -1)
        place[own - own[0]] = np.arange(len(own))

        def chunk(m: int, row: np.ndarray, col: np.ndarray) -> np.ndarray:
            a, b = np.searchsorted(col, [own[0], own[-1] + 1])
            x = place[col[a:b] - own[0]]
            part = np.zeros((m, len(own)), np.float32)
            part[row[a:b][x >= 0], x[x >= 0]] = 1
            return part

        left = chunk(len(sets), row_a, col_a)
        out += left @ (left if others is None else chunk(len(others), row_b, col_b)).T
    if others is None:
        np.fill_diagonal(out, 0)
    return out


Sets = list[tuple[bytes, np.ndarray]]


def _tiles(rows: Sets, begin: int, end: int) -> list[tuple[int, int]]:
    """Runs of at most TILE rows with at most TILE_ENTRIES entries, or of one row."""
    out, lo, n = [], begin, 0
    for x in range(begin, end):
        if x > lo and (x - lo == TILE or n + len(rows[x][1]) > TILE_ENTRIES):
            out.append((lo, x))
            lo, n = x, 0
        n += len(rows[x][1])
    return [*out, (lo, end)]


def _links(left: Sets, right: Sets | None, percent: int) -> Iterator[tuple[bytes, bytes, int]]:
    """Of the classes of a block (and another): each with its root and its number of links.

    For two blocks only pairs across them are multiplied, a tile of each at a time; pairs within a block are in the unit of that block alone.
    """
    rows = left + (right or [])
    up, links = list(range(len(rows))), np.zeros(len(rows), np.int64)

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    tiles = _tiles(rows, 0, len(left))
    others = tiles if right is None else _tiles(rows, len(left), len(rows))
    for lo, lo_end in tiles:
        for at, at_end in others:
            if at < lo:
                continue
            a = rows[lo:lo_end]
            b = None if at == lo else rows[at:at_end]
            size_a = np.array([len(s) for _, s in a])
            size_b = size_a if b is None else np.array([len(s) for _, s in b])
            o = overlaps([s for _, s in a], None if b is None else [s for _, s in b]).astype(np.int64)
            linked = (o > 0) & ((100 + percent) * o >= percent * (size_a[:, None] + size_b[None, :]))
            links[lo : lo + len(a)] += linked.sum(1)
            if b is not None:
                links[at : at + len(b)] += linked.sum(0)
            todo = linked.any(1)
            while todo.any():
                seen_a, seen_b = np.zeros(len(size_a), bool), np.zeros(len(size_b), bool)
                seen_a[np.argmax(todo)] = True
                edge = seen_a
                while edge.any():
                    new = linked[edge].any(0) & ~seen_b
                    seen_b |= new
                    edge = linked[:, new].any(1) & ~seen_a
                    seen_a = seen_a | edge
                todo &= ~seen_a
                whole = np.concatenate([lo + np.flatnonzero(seen_a), at + np.flatnonzero(seen_b)]).tolist()
                for x in whole[1:]:
                    up[root(x)] = root(whole[0])
    for x in np.flatnonzero(links).tolist():
        yield rows[x][0], rows[root(x)][0], int(links[x])


def _verified(docs: DataFrame, reps: DataFrame, clusters: DataFrame, k: int, percent: int, limits: Limits, base: str) -> DataFrame:
    """``digest, root, links``: links between classes, as edges to one class of each group."""
    spark = docs.sparkSession
    own = written(reps.select("cid", "doc_key", "n_shingles").join(clusters, "cid"), f"{base}/clustered")
    bits = spark.sparkContext.broadcast(_filter_words(own))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, words, seen = WordHashes(), bits.value, set()
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            got = np.flatnonzero((words[x >> 5] >> (x & 31)) & 1)
            for at in range(0, len(got), 512):
                rows = []
                for text in batch.column(1).take(pa.array(got[at : at + 512])).to_pylist():
                    s = shingle_set(text, k, hashes)
                    d = _digest(s)
                    if d is not None and d not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(d)
                        rows.append((_class_id(d), d, s.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                    names=["cid", "digest", "s"],
                )

    whole = docs.select(_slot("doc_key").alias("slot"), "text").mapInArrow(lambda b: trimmed(again(b)), "cid long, digest binary, s binary")
    blocks = own.groupBy("cluster").agg(F.sum("n_shingles").alias("entries"), F.count(F.lit(1)).alias("n"))
    many = F.greatest(F.ceil(F.col("entries") * 8 / limits.block_bytes), F.ceil(F.col("n") / limits.block_docs)).cast("int")
    blocks = written(blocks.select("cluster", "n", many.alias("blocks")), f"{base}/blocks")
    dealt = spread_join(clusters, blocks.drop("n"), "cluster", blocks.select("cluster", "n"), "cid")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = dealt.select("cid", "cluster", "block", other).select(
        "cid", "cluster", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    rows = whole.join(units, "cid").select("cluster", "i", "j", "block", "digest", "s")
    sorted_rows = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, out = None, {}, []

        def done() -> None:
            if unit is not None and len(held) > 1:
                sides = [[(d, np.frombuffer(s, np.uint64)) for d, (b, s) in held.items() if b == x] for x in unit[1:]]
                if sides[0] and sides[1]:
                    out.extend(_links(sides[0], None if unit[1] == unit[2] else sides[1], percent))

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())],
                names=["digest", "root", "links"],
            )

        parts = (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256))
        for part in parts:
            for cluster, i, j, block, digest, s in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if unit != (cluster, i, j):
                    done()
                    unit, held = (cluster, i, j), {}
                held[digest] = (block, s)
            if out:
                yield batch_of(out)
                out = []
        done()
        yield batch_of(out)

    return written(sorted_rows.mapInArrow(lambda b: trimmed(product(b)), "digest binary, root binary, links long"), f"{base}/links")


def joined(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85, limits: Limits = Limits()) -> DataFrame:
    """One row per input row: ``_row_key, doc_id, n_shingles, component, n_links, component_id``.

    Two rows link when ``100 * overlap >= percent * union`` of their sets of
    distinct k-word shingles. ``n_links`` counts linked classes of other sets;
    rows of one non-empty set are linked without being counted.
    """
    plain = with_row_key(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return _joined(plain, k, percent, limits)


def _joined(keyed: DataFrame, k: int, percent: int, limits: Limits = Limits()) -> DataFrame:
    base = work_dir(keyed.sparkSession, "ngram-join")
    docs = keyed.select(ROW_KEY, "doc_id", "text").withColumn("doc_key", F.xxhash64("doc_id"))
    levels = _frequencies(docs, k)
    sets = _sets(docs.select(ROW_KEY, "doc_id", "doc_key", "text"), k, percent, levels, base)
    one = [F.first("cid").alias("cid"), F.first("n").alias("n_shingles"), F.min("doc_key").alias("doc_key"), F.min("doc_id").alias("first_id")]
    reps = written(sets.where("n > 0").groupBy("digest").agg(*one, F.count(F.lit(1)).alias("n")), f"{base}/reps")
    clusters = _clusters(sets, percent, base)
    links = _verified(docs, reps, clusters, k, percent, limits, base)
    groups = components(links.select(F.col("digest").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("digest").agg(F.sum("links").alias("links"))
    classes = reps.select("digest", "first_id").join(groups.withColumnRenamed("node", "digest"), "digest", "left").join(counts, "digest", "left")
    classes = written(classes.withColumn("component", F.coalesce("component", "digest")), f"{base}/members")
    least = written(classes.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n")), f"{base}/least")
    classes = spread_join(classes, least.drop("n"), "component", least.select("component", "n"), "digest")
    classes = written(classes.select("digest", "component", "component_id", F.coalesce("links", F.lit(0)).alias("n_links")), f"{base}/classes")
    out = sets.select(ROW_KEY, "doc_id", F.col("n").alias("n_shingles"), "digest")
    out = spread_join(out, classes, "digest", reps.select("digest", "n"), ROW_KEY, "left")
    return out.select(
        ROW_KEY, "doc_id", "n_shingles", "component", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """The rows that stay, with all columns: of each component the smallest id, then place.

    Only keys are grouped; the rows that go are looked up by their keys.
    """
    plain, names = numbered(df)
    keyed = with_row_key(plain)
    own = {n: F.col(f"_c{i}") for i, n in enumerate(names)}
    base = work_dir(df.sparkSession, "one-of-each")
    found = written(_joined(keyed.select(ROW_KEY, own[doc_id].alias("doc_id"), own[text].alias("text")), k, percent), f"{base}/found")
    grouped = found.where(F.col("component").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW_KEY)).alias("first")
    stay = written(grouped.groupBy("component").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1"), f"{base}/stay")
    pairs = spread_join(grouped.select(ROW_KEY, "component"), stay.drop("n"), "component", stay.select("component", "n"), ROW_KEY)
    gone = written(pairs.where(F.col(ROW_KEY) != F.col(f"first.{ROW_KEY}")).select(ROW_KEY), f"{base}/gone")
    return named(without(keyed, gone), names)

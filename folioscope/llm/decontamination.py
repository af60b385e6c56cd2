"""Benchmark decontamination by latent semantic retrieval.

Passages (windows of words of every document, and the benchmark's items) are
vectors of hashed words weighted by inverse document frequency. A randomised
SVD gives a space of few dimensions: each task multiplies its passages with a
random test matrix, the products are orthogonalised, and the small projected
matrix is summed over tasks. Windows and items meet in that space by cosine;
what is near enough is checked on the words themselves: the longest common
subsequence with the item, and how much of the item's last sentence (its
answer) stands there.

Words are turned into buckets once, and that is written: frequencies, space and
search read the buckets of all documents. The space is fitted on all items and on
every word of every document, in windows that don't overlap; all windows together
weigh a fixed number of items, so that items aren't lost among them. Every window
of every document is searched, and only what comes near an item is read as words. An item
longer than a window is met by its own windows too, and the cosine that a short
one needs is lower, as it fills a window in part only. Items are searched for in
blocks of bounded size, all in the same space.

Items of under ``least_words`` words, too few for a common subsequence to mean
anything, are found where all their words stand one after the other.

Defined results: null and empty texts are clean; items with a null text or
without words match nothing; an item with a null id is searched for like any
other and reported without id; ties go to the smaller item, null ids last; rows
are judged one by one, so repeated rows and ids are too; a text of any length is
searched whole; a carried column with the name of a result column is replaced
by it; an empty table gives an empty result, an empty benchmark leaves
everything clean.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .rows import carried, named, numbered, trim, trimmed, work_dir, written


@dataclass(frozen=True)
class Settings:
    """Sizes of the space and its sample, and what counts as a copy of an item."""

    buckets: int = 1 << 16
    dimensions: int = 64
    common: int = 4  # leading dimensions that tell languages apart, not passages
    oversample: int = 16
    powers: int = 1
    sample: int = 1024  # what all windows together weigh in the fit, in items
    step: int = 16  # words from one window to the next; a window is two steps
    cosine: float = 0.6  # of items that fill a window; shorter ones need less
    copied: float = 0.6  # share of the item's words in the common subsequence
    copied_with_answer: float = 0.55
    answer: float = 0.9
    least_words: int = 6
    block_items: int = 4096
    seed: int = 11


_EDGES = ".,;:!?\"'()[]«»¡¿"
CACHE_WORDS = 100_000
#: Words of a text, and cells of windows by items, that are worked on at once.
WIDE, CELLS = 1 << 14, 1 << 22
#: Rows of a batch whose texts are Python strings at once.
SLICE = 256


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def bucket(word: str, buckets: int) -> int:
    return zlib.crc32((word.strip(_EDGES) or word).encode("utf-8", "surrogatepass")) % buckets


class Buckets(dict):
    """word -> bucket, kept as it is met."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: str) -> int:
        k = self[word] = zlib.crc32((word.strip(_EDGES) or word).encode("utf-8", "surrogatepass")) % self.buckets  # as ``bucket``, without a call
        return k


def dtype_of(s: Settings) -> type:
    return np.uint16 if s.buckets <= 1 << 16 else np.uint32


class Vectors(dict):
    """word -> row of a table of projected, weighted words; bounded, then it starts anew."""

    def __init__(self, space: np.ndarray):
        super().__init__()
        self.space, self.table, self.new = space, np.zeros((1024, space.shape[1]), np.float32), []

    def __missing__(self, word: str) -> int:
        self.new.append(bucket(word, len(self.space)))
        k = self[word] = len(self)
        return k

    def rows(self, words: list[str]) -> np.ndarray:
        """The words' vectors; new words are looked up together."""
        if len(self) > CACHE_WORDS:
            self.clear()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            if len(self) > len(self.table):
                bigger = np.zeros((2 * len(self), self.table.shape[1]), np.float32)
                bigger[: len(self.table)] = self.table
                self.table = bigger
            self.table[len(self) - len(self.new) : len(self)] = self.space[self.new]
            self.new = []
        return self.table.take(ids, axis=0)


def windows(words: list[str], known: Vectors, step: int) -> np.ndarray:
    """Unit vectors of a document's windows; window k begins at word k * step."""
    wide = max(1, WIDE // step) * step  # words that are looked up at once
    parts = (words[lo : lo + wide] for lo in range(0, len(words), wide))
    sums = np.concatenate([np.add.reduceat(known.rows(p), np.arange(0, len(p), step), axis=0) for p in parts])
    if len(sums) > 1:
        sums = sums[:-1] + sums[1:]
    return sums / np.maximum(np.sqrt(np.einsum("ij,ij->i", sums, sums)), 1e-9)[:, None]


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit of an integer for each word of ``a``."""
    at: dict[str, int] = {}
    for k, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << k
    row, full = 0, (1 << len(a)) - 1
    for w in b:
        if m := at.get(w):
            x = row | m
            row = x & ~(x - (row << 1 | 1)) & full
    return row.bit_count()


def answer_of(words: list[str]) -> list[str]:
    """The words of an item's last sentence (of its last half, if it has only one)."""
    for k in range(len(words) - 2, 0, -1):
        if words[k][-1:] in ".!?":
            return words[k + 1 :]
    return words[len(words) // 2 :]


@dataclass
class Item:
    item_id: object
    words: list[str]
    answer: list[str]

    def __post_init__(self):
        self.distinct = set(self.words)

    def most_in(self, words: set[str] | list[str]) -> float:
        """No common subsequence with these words is a larger share of the item."""
        return (len(self.words) - len(self.distinct.difference(words))) / len(self.words)


def _prepared(docs: DataFrame, s: Settings, base: str) -> DataFrame:
    """``docs``, whose last column is the text, with the buckets of its words in order, written."""
    kind = dtype_of(s)
    schema = T.StructType([*docs.schema.fields, T.StructField(_IDS, T.BinaryType())])

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(s.buckets)
        for part in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            out = []
            for text in part.column(part.num_columns - 1).to_pylist():
                words = words_of(text)
                if len(known) > CACHE_WORDS:
                    known.clear()
                out.append(np.fromiter(map(known.__getitem__, words), kind, len(words)).tobytes())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=schema.names)

    return written(docs.mapInArrow(lambda b: trimmed(bucketed(b)), schema), f"{base}/buckets")


def _frequencies(docs: DataFrame, s: Settings, base: str) -> tuple[np.ndarray, int, int]:
    """In how many of all documents each bucket occurs, how many documents there are, and how many windows side by side."""
    kind = dtype_of(s)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s.buckets, np.int64)
        rows = wide = 0
        for batch in batches:
            rows += batch.num_rows
            for raw in batch.column(0).to_pylist():
                ids = np.frombuffer(raw, kind)
                wide += -(-len(ids) // (2 * s.step))
                total[ids] += 1  # a bucket once, however many of the words it has: repeated places are set once
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, [-1, -2])), pa.array(np.append(total[met], [rows, wide]))], names=["b", "n"])

    counts = docs.select(_IDS).mapInArrow(lambda b: trimmed(count(b)), "b long, n long").groupBy("b").agg(F.sum("n").alias("n"))
    got = written(counts, f"{base}/frequencies").toArrow()  # at most a row a bucket
    b, n = got.column("b").to_numpy(), got.column("n").to_numpy()
    out = np.zeros(s.buckets, np.int64)
    out[b[b >= 0]] = n[b >= 0]
    return out, int(n[b == -1].sum()), int(n[b == -2].sum())


def _weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, n = np.unique([bucket(w, len(idf)) for w in words_of(text)], return_counts=True)
    x = n * idf[ids.astype(np.int64)]
    return ids.astype(np.int64), x / max(np.linalg.norm(x), 1e-9)


def orthonormal(a: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns' space, with one copy of ``a`` in memory besides it; columns beyond its rank are left out."""
    for _ in range(2):  # once more, as the product of columns loses half the digits
        gram = sum(x.T @ x for x in (a[lo : lo + 4096].astype(float) for lo in range(0, len(a), 4096)))
        values, turn = np.linalg.eigh(gram)
        keep = values > 1e-11 * max(values[-1], 1e-300)
        a = a @ (turn[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    return a


def _add_product(out: np.ndarray, ids: np.ndarray, starts: np.ndarray, weight: np.ndarray, idf: np.ndarray, own: np.ndarray) -> None:
    """Adds ``A' A own`` of some passages, each one word or more; ``starts``: where they begin in ``ids``."""
    ends = np.append(starts[1:], len(ids))
    here, rank = np.zeros(len(idf), bool), np.empty(len(idf), np.int64)
    for lo in range(0, len(starts), FIT_PASSAGES):  # a few passages at once have few different buckets
        begin, end, w = starts[lo : lo + FIT_PASSAGES], ends[lo : lo + FIT_PASSAGES], weight[lo : lo + FIT_PASSAGES]
        part = ids[begin[0] : end[-1]]
        here[part] = True
        met = np.flatnonzero(here)
        here[met] = False
        rank[met] = np.arange(len(met))
        at = rank[part]
        place = np.repeat(np.arange(len(begin)), end - begin)
        x = np.bincount(place * len(met) + at, minlength=len(begin) * len(met)).reshape(len(begin), -1).astype(np.float32)
        x *= idf[met]
        x *= (w / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9))[:, None]
        out[met] += x.T @ (x @ own[met])


def _passages(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows ``ids, wide, weight``: passages of ``wide`` words at most, FIT_WORDS words or so at once, as ids, starts and weights."""
    parts, starts, weights, n = [], [], [], 0
    for batch in batches:
        for raw, wide, weight in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            ids = np.frombuffer(raw, kind)
            wide = wide or max(1, len(ids))
            most = max(1, FIT_WORDS // wide) * wide
            for lo in range(0, len(ids), most):
                part = ids[lo : lo + most]
                own = np.arange(n, n + len(part), wide)
                parts.append(part)
                starts.append(own)
                weights.append(np.full(len(own), weight, np.float32))
                n += len(part)
                if n >= FIT_WORDS:
                    yield np.concatenate(parts).astype(np.int64), np.concatenate(starts), np.concatenate(weights)
                    parts, starts, weights, n = [], [], [], 0
    if n:
        yield np.concatenate(parts).astype(np.int64), np.concatenate(starts), np.concatenate(weights)


def randomised_svd(passages: DataFrame, idf: np.ndarray, s: Settings, base: str) -> np.ndarray:
    """Right singular vectors (bucket by dimension) of the weights of ``passages`` (``text``)."""
    rows = _prepared(passages.select("text"), s, f"{base}/texts").select(F.col(_IDS).alias("ids"), F.lit(0).alias("wide"), F.lit(1.0).alias("weight"))
    return _singular(rows, idf, s)


def _singular(rows: DataFrame, idf: np.ndarray, s: Settings) -> np.ndarray:
    """Right singular vectors of the weighted passages of ``rows`` (``ids, wide, weight``; all of a row's words are one passage if ``wide`` is 0).

    They are scaled to equal variance, and of the leading ``common`` those are left
    out that stand well above the next: they hold what all passages of a language
    share. In few passages, where none stands out, all are kept.
    The test matrix is made anew from the seed in every task. A power step multiplies
    with the matrix and its transpose. The last of them gives the values too (Nystrom),
    so all passages are read once a power step. A task gives a row a bucket at
    most, so there are as many tasks as cores, whatever the passages.
    """
    spark = rows.sparkSession
    rows = rows.coalesce(max(4, spark.sparkContext.defaultParallelism))
    width, kind = s.dimensions + s.oversample, dtype_of(s)
    start = lambda: np.random.default_rng(s.seed).normal(size=(s.buckets, width)).astype(np.float32)

    def multiplied(basis: np.ndarray | None) -> np.ndarray:
        """``A' A basis``, summed over tasks in blocks of buckets."""
        shared = spark.sparkContext.broadcast((idf, basis))

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_idf, own = shared.value
            own = start() if own is None else own
            out = np.zeros((s.buckets, own.shape[1]), np.float32)
            for ids, starts, weight in _passages(batches, kind):
                _add_product(out, ids, starts, weight, own_idf, own)
            for lo in range(0, s.buckets, 1024):
                met = np.flatnonzero(out[lo : lo + 1024].any(1))
                if len(met):
                    columns = [pa.array([lo], pa.int32()), pa.array([met.astype(np.int32).tobytes()], pa.binary()), pa.array([out[lo + met].tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lo", "met", "part"])

        def added(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            total = None
            for met, part in zip(table.column("met").to_pylist(), table.column("part").to_pylist(), strict=True):
                met = np.frombuffer(met, np.int32)
                part = np.frombuffer(part, np.float32).reshape(len(met), -1)
                total = np.zeros((1024, part.shape[1]), np.float32) if total is None else total
                total[met] += part
            return pa.table({"lo": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

        summed = rows.mapInArrow(lambda b: trimmed(product(b)), "lo int, met binary, part binary").groupBy("lo").applyInArrow(added, "lo int, part binary").toArrow()
        shared.destroy()
        out = np.zeros((s.buckets, width if basis is None else basis.shape[1]), np.float32)
        for batch in summed.to_batches():
            for k, lo in enumerate(batch.column(0).to_pylist()):
                x = np.frombuffer(batch.column(1)[k].as_buffer(), np.float32).reshape(-1, out.shape[1])
                out[lo : lo + len(x)] = x[: len(out) - lo]
        return out

    basis = None
    for _ in range(s.powers - 1):
        basis = orthonormal(multiplied(basis))
    last = multiplied(basis)
    inner = (start() if basis is None else basis).T @ last
    values, turn = np.linalg.eigh((inner + inner.T).astype(float) / 2)
    keep = values > 1e-6 * max(values[-1], 1e-300)
    if not keep.any():  # no words at all
        return np.zeros((s.buckets, 1), np.float32)
    last = last @ (turn[:, keep] / np.sqrt(values[keep])).astype(np.float32)  # its squared singular values are those of the matrix, squared
    values, turn = np.linalg.eigh(sum(x.T @ x for x in (last[lo : lo + 4096].astype(float) for lo in range(0, len(last), 4096))))
    order = np.argsort(-values)[: s.dimensions]
    order = order[values[order] > 1e-3 * values[order[0]]]  # no noise from beyond the rank of few passages
    large = values[order] >= 2 * values[order[min(s.common, len(order) - 1)]]
    top = np.concatenate([order[: s.common][~large[: s.common]], order[s.common :]])
    return last @ (turn[:, top] / np.maximum(values[top], 1e-9)).astype(np.float32)


def checked(item: Item, words: list[str], begin: int, s: Settings) -> tuple[float, float]:
    """The best of the windows' surroundings: shares of the item and of its answer."""
    reach = len(item.words) + s.step
    near = words[max(0, begin - len(item.words)) : begin + reach + 2 * s.step]
    if item.most_in(near) < s.copied_with_answer:
        return 0.0, 0.0
    share = common_subsequence(item.words, near) / len(item.words)
    if share < s.copied_with_answer:
        return share, 0.0
    return share, common_subsequence(item.answer, near) / len(item.answer)


def vectors_of(item: Item, known: Vectors, s: Settings) -> np.ndarray:
    """The item as a whole and, if it is longer than a window, its own windows."""
    whole = windows(item.words, known, len(item.words))
    return np.concatenate([whole, windows(item.words, known, s.step)]) if len(item.words) > 2 * s.step else whole


def least_cosine(item: Item, s: Settings) -> float:
    """An item shorter than a window is at best so near to it as its share of the window."""
    return s.cosine * min(1.0, len(item.words) / (2 * s.step)) ** 0.5


@dataclass
class Searched:
    """Items with all their vectors, of each the item's place and its least cosine."""

    items: list[Item]
    vectors: np.ndarray
    owner: np.ndarray
    least: np.ndarray
    short: dict[str, list[tuple[Item, list[str], np.ndarray]]]  # by first word
    first: np.ndarray  # buckets of those first words


def cores(words: list[str]) -> list[str]:
    return [w.strip(_EDGES) or w for w in words]


def to_search(items: list[Item], space: np.ndarray, s: Settings) -> Searched:
    known = Vectors(space)
    long = [i for i in items if len(i.words) >= s.least_words]
    vectors = [vectors_of(i, known, s) for i in long]
    owner = np.repeat(np.arange(len(long)), [len(v) for v in vectors]).astype(np.int64)
    least = np.array([least_cosine(i, s) for i in long], np.float32)[owner]
    short: dict[str, list[tuple[Item, list[str], np.ndarray]]] = {}
    for i in items:
        if len(i.words) < s.least_words:
            own = cores(i.words)
            short.setdefault(own[0], []).append((i, own, windows(i.words, known, len(i.words))[0]))
    first = np.zeros(len(space), bool)
    first[[bucket(w, len(space)) for w in short]] = True
    return Searched(long, np.concatenate([np.zeros((0, space.shape[1]), np.float32), *vectors]), owner, least, short, first)


def _short_in(words: list[str], vectors: np.ndarray, to: Searched, s: Settings) -> Iterator[tuple[Item, float, float, float]]:
    """Items that are too short for windows: those that stand there word by word."""
    plain = cores(words)
    first = to.short.keys() & set(plain)
    for at, w in enumerate(plain) if first else ():
        if w in first:
            for item, own, vector in to.short[w]:
                if plain[at : at + len(own)] == own:
                    yield item, 1.0, 1.0, float(vectors[min(at // s.step, len(vectors) - 1)] @ vector)


def _vectors(parts: list[np.ndarray], space: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the windows of some texts (buckets of one word or more each), as ``windows`` has them; and where those of each text begin."""
    ids = np.concatenate(parts)
    ends = np.cumsum([len(p) for p in parts])
    starts = [np.arange(hi - len(p), hi, step) for hi, p in zip(ends, parts, strict=True)]
    cut = np.array([len(x) for x in starts])
    starts = np.append(np.concatenate(starts), len(ids))
    sums = np.empty((len(starts) - 1, space.shape[1]), np.float32)
    for lo in range(0, len(sums), WIDE // step):
        at = starts[lo : lo + WIDE // step + 1]
        hi = min(len(sums), lo + WIDE // step)
        sums[lo:hi] = np.add.reduceat(space.take(ids[at[0] : starts[hi]], axis=0), at[: hi - lo] - at[0], axis=0)
    last = np.cumsum(cut) - 1
    single = last[cut == 1]
    alone = sums[single]
    sums[:-1] += sums[1:]
    sums[single] = alone
    keep = np.ones(len(sums), bool)
    keep[last[cut > 1]] = False
    sums = sums[keep]
    sums /= np.maximum(np.sqrt(np.einsum("ij,ij->i", sums, sums)), 1e-9)[:, None]
    return sums, np.cumsum(np.append(0, np.maximum(cut - 1, 1)))


def _best(text: str, vectors: np.ndarray, near: list[tuple[int, int, float]], short: bool, to: Searched, s: Settings) -> tuple[object, float, float, float] | None:
    """The item that a document has the most of: id, cosine, share, share of the answer; ``near``: window, vector of an item, cosine."""
    words = words_of(text)
    whole = set(words)
    pairs: dict[tuple[int, int], float] = {}
    held: dict[int, bool] = {}
    for w, which, x in near:
        k = int(to.owner[which])
        if k not in held:
            held[k] = to.items[k].most_in(whole) >= s.copied_with_answer
        if held[k]:
            pairs[w, k] = max(x, pairs.get((w, k), x))
    found = []
    for (w, k), x in pairs.items():
        share, answer = checked(to.items[k], words, w * s.step, s)
        if share >= s.copied or (share >= s.copied_with_answer and answer >= s.answer):
            found.append((to.items[k], share, answer, x))
    if short:
        found += _short_in(words, vectors, to, s)
    if not found:
        return None
    best = max(f[1:3] for f in found)
    item, share, answer, x = min((f for f in found if f[1:3] == best), key=lambda f: (f[0].item_id is None, 0 if f[0].item_id is None else f[0].item_id, -f[3]))
    return item.item_id, x, share, answer


def found_in(texts: pa.Array, ids: pa.Array, space: np.ndarray, to: Searched, s: Settings) -> list[tuple[object, float, float, float] | None]:
    """Of each text, given with the buckets of its words, the item that it has the most of; see ``_best``."""
    kind = dtype_of(s)
    out: list[tuple[object, float, float, float] | None] = [None] * len(texts)
    if not (to.items or to.short):
        return out
    parts = [np.frombuffer(raw, kind) for raw in ids.to_pylist()]
    full = [k for k, p in enumerate(parts) if len(p)]
    lo = 0
    while lo < len(full):
        hi, n = lo, 0
        while hi < len(full) and (hi == lo or n + len(parts[full[hi]]) <= 4 * WIDE):
            n += len(parts[full[hi]])
            hi += 1
        chosen = full[lo:hi]
        vectors, begin = _vectors([parts[k] for k in chosen], space, s.step)
        near: dict[int, list[tuple[int, int, float]]] = {}
        tile = max(1, CELLS // max(1, len(to.vectors)))
        for top in range(0, len(vectors), tile):
            cosine = vectors[top : top + tile] @ to.vectors.T
            at, which = np.nonzero(cosine >= to.least)
            of = np.searchsorted(begin, at + top, side="right") - 1
            for d, w, k, x in zip(of.tolist(), (at + top - begin[of]).tolist(), which.tolist(), cosine[at, which].tolist(), strict=True):
                near.setdefault(d, []).append((w, k, x))
        for d, k in enumerate(chosen):
            short = bool(to.short) and bool(to.first[parts[k]].any())
            if short or d in near:
                out[k] = _best(texts[k].as_py(), vectors[begin[d] : begin[d + 1]], near.get(d, []), short, to, s)
        lo = hi
    return out


NAMES = ("contaminated", "item_id", "similarity", "lcs_share", "answer_share")


def hits_of(item_id: T.DataType) -> T.StructType:
    """What is found of a document; the item's id is of the type that it has."""
    kinds = (T.BooleanType(), item_id, *[T.DoubleType()] * 3)
    return T.StructType([T.StructField(n, k) for n, k in zip(NAMES, kinds, strict=True)])


#: Words that are read, and passages that are multiplied, at once.
FIT_WORDS, FIT_PASSAGES = 1 << 15, 64
_TEXT, _IDS = "_searched_text", "_searched_buckets"


def _blocks(benchmark: DataFrame, s: Settings) -> Iterator[list[tuple[int | None, str]]]:
    """The items in order, null ids last, a bounded number at a time."""
    kind = benchmark.schema["item_id"].dataType
    place = F.struct(F.col("item_id").isNull(), "item_id", "text")
    left = benchmark
    while rows := left.orderBy(place).limit(s.block_items).collect():
        yield [(r.item_id, r.text) for r in rows]
        if len(rows) < s.block_items:
            return
        last = rows[-1]
        left = benchmark.where(place > F.struct(F.lit(last.item_id is None), F.lit(last.item_id).cast(kind), F.lit(last.text)))


def _against(docs: DataFrame, carry: list[str], items: list[Item], space: np.ndarray, s: Settings, hits: T.StructType, last: bool) -> DataFrame:
    """``docs`` (``carry``, text, buckets, and perhaps hits so far) with the better of old and new hits; text and buckets only if there is more to search."""
    shared = docs.sparkSession.sparkContext.broadcast((to_search(items, space, s), space))
    again, kept = "contaminated" in docs.columns[len(carry) :], len(carry) + 2 * (not last)
    schema = T.StructType([*docs.schema.fields[:kept], *hits.fields])
    kinds = [to_arrow_type(f.dataType) for f in hits.fields]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, space = shared.value
        for part in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            old = list(zip(*[c.to_pylist() for c in part.columns[len(carry) + 2 :]], strict=True)) if again else None
            out = []
            for k, got in enumerate(found_in(part.column(len(carry)), part.column(len(carry) + 1), space, to, s)):
                own = (False, None, None, None, None) if got is None else (True, *got)
                if old and old[k][0] and (not own[0] or old[k][3:] >= own[3:]):
                    own = old[k]
                out.append(own)
            found = [pa.array([o[j] for o in out], kinds[j]) for j in range(5)]
            yield pa.RecordBatch.from_arrays([*part.columns[:kept], *found], names=schema.names)

    return docs.mapInArrow(lambda b: trimmed(search(b)), schema)


def _fitted(plain: DataFrame, benchmark: DataFrame, s: Settings, item_id: str, item_text: str) -> tuple[DataFrame, np.ndarray, Iterator[list[Item]]]:
    """``plain``, whose last column is the text, with buckets; the space for documents and items; and the items in blocks."""
    base = work_dir(plain.sparkSession, "decontamination")
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    items = written(items.dropna(subset=["text"]), f"{base}/items")
    docs = _prepared(plain, s, base)
    counts, n, n_windows = _frequencies(docs, s, base)
    idf = (np.log((1 + n) / (1 + counts)) + 0.1).astype(np.float32)
    own = _prepared(items.select("text").distinct(), s, f"{base}/own")  # a repeated item must not seem common
    weight = min(1.0, (s.sample / max(1, n_windows)) ** 0.5)
    rows = lambda df, wide, weight: df.select(F.col(_IDS).alias("ids"), F.lit(wide).alias("wide"), F.lit(weight).alias("weight"))
    space = _singular(rows(docs, 2 * s.step, weight).unionByName(rows(own, 0, 1.0)), idf, s)
    space *= idf[:, None]
    trim()
    return docs, space, ([Item(i, w, answer_of(w)) for i, t in block if (w := words_of(t))] for block in _blocks(items, s))


def searched(df: DataFrame, benchmark: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of ``carry`` (the id by default) with the hits of every row."""
    carry = carried(df, [doc_id] if carry is None else carry, (_TEXT, _IDS, *NAMES))
    hits = hits_of(benchmark.schema[item_id].dataType)
    docs, space, blocks = _fitted(df.select(*carry, F.col(text).alias(_TEXT)), benchmark, s, item_id, item_text)
    block = next(blocks, [])
    while block is not None:
        after = next(blocks, None)
        docs = _against(docs, carry, block, space, s, hits, after is None)
        block = after
    return docs.select(*carry, *NAMES)


def clean(df: DataFrame, benchmark: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows without a copy of a benchmark item, with all their columns."""
    plain, names = numbered(df)
    column = f"_c{names.index(text)}"
    order = [*[c for c in plain.columns if c != column], column]
    docs, space, blocks = _fitted(plain.select(*order), benchmark, s, "item_id", "text")
    for items in blocks:
        shared = df.sparkSession.sparkContext.broadcast((to_search(items, space, s), space))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            to, space = shared.value
            for part in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
                hits = found_in(part.column(part.num_columns - 2), part.column(part.num_columns - 1), space, to, s)
                yield part.filter(pa.array([h is None for h in hits], pa.bool_()))

        docs = docs.mapInArrow(lambda b, keep=keep: trimmed(keep(b)), docs.schema)
    return named(docs, names)

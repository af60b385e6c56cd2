"""Quality by perplexity under an interpolated modified Kneser-Ney model of words.

Words are hashed into a fixed number of buckets. Tasks count the pairs of words
of trusted texts; the counts are summed by pair, whose number grows with the
text. What concerns a single word (its probability after any other, and the
weight that a word leaves to the lower order) has one cell a bucket and can be
broadcast. Pairs stay a table that is dealt by pair: documents send the distinct
pairs of blocks of rows there, packed with the rows that have them, and sums of
logarithms come back. No task holds more than a share of the pairs.

A document's perplexity is compared with a quantile, for its language, of the
perplexities of trusted documents that the model has not seen.

Defined results: null and empty texts have no perplexity and aren't kept; a text
of any length is scored whole, equal texts alike; a null language is one of its
own; languages with few held-out trusted documents use the quantile over all;
without any, every text is kept; repeated rows are scored once each; repeated
labels of an id count once, as trusted if any is, null ones don't count; other
columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngram_join import WordHashes
from .rows import ROW_KEY, trimmed, with_row_key, work_dir, written


@dataclass(frozen=True)
class Settings:
    bits: int = 18  #: words have 2 ** bits buckets; the first stands before each text
    quantile: float = 0.98
    least_documents: int = 100
    #: Up to so many trusted ids are broadcast; beyond, both sides are shuffled.
    broadcast_ids: int = 1_000_000
    #: Rows whose pairs travel together (at most 256), and the pairs of the model that a task holds.
    block: int = 256
    share: int = 1 << 22


#: Perplexities are counted in bins of this many to a doubling.
BINS = 200
#: Pairs of a block that travel in one row, so that no batch of rows is large.
SENT = 1024


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def words_of(text: str | None, hashes: WordHashes, bits: int) -> np.ndarray:
    """The buckets of a text's words."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return (h % np.uint64((1 << bits) - 1)).astype(np.int64) + 1


def pairs_of(words: np.ndarray, bits: int) -> np.ndarray:
    """Each word with the one before it; the first of a text with bucket 0."""
    return np.concatenate([[0], words[:-1]]).astype(np.int64) << bits | words if len(words) else words


def packed(keys: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte by byte: the high bytes are mostly zeros, which compress."""
    return zlib.compress(np.ascontiguousarray(np.diff(keys, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T).view("<i8").ravel())


def _part(g: np.ndarray, s: Settings, parts: int) -> np.ndarray:
    return ((g >> s.bits) + 7 * (g & ((1 << s.bits) - 1))) % parts


def _runs(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Of ascending numbers: each with where it begins and ends."""
    cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    for lo, hi in zip(cuts, [*cuts[1:], len(part)], strict=True):
        yield int(part[lo]), lo, hi


def _columns(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


_COUNTS = (["part", "keys", "n"], [pa.int32(), pa.binary(), pa.binary()])


def _counts(trusted: DataFrame, s: Settings, parts: int) -> DataFrame:
    """``part, keys, n``: all pairs of the trusted texts, one packed row a part (and more only for an empty one)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            own = [pairs_of(words_of(t, hashes, s.bits), s.bits) for t in part.column(0).to_pylist()]
            g, n = np.unique(np.concatenate(own).astype(np.int64), return_counts=True)
            of = _part(g, s, parts)
            order = np.argsort(of, kind="stable")
            g, n, of = g[order], n[order], of[order]
            yield _columns([(k, packed(g[lo:hi]), n[lo:hi].astype("<u4").tobytes()) for k, lo, hi in _runs(of)], *_COUNTS)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, g, n = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> None:
            nonlocal g, n
            both = np.concatenate([g, *[x for x, _ in waiting]])
            g, at = np.unique(both, return_inverse=True)
            n = np.bincount(at, np.concatenate([n, *[y for _, y in waiting]]), len(g)).astype(np.int64)
            waiting.clear()

        def row() -> pa.RecordBatch:
            merge()
            return _columns([(held, packed(g), n.astype("<u4").tobytes())], *_COUNTS)

        for k, keys, often in (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True)):
            if k != held:
                if held is not None:
                    yield row()
                held, g, n = k, np.zeros(0, np.int64), np.zeros(0, np.int64)
            waiting.append((unpacked(keys), np.frombuffer(often, "<u4").astype(np.int64)))
            if sum(len(x) for x, _ in waiting) > s.share // 4:
                merge()
        if held is not None:
            yield row()

    each = trusted.select("text").mapInArrow(lambda b: trimmed(count(b)), "part int, keys binary, n binary")
    return each.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lambda b: trimmed(merged(b)), each.schema)


def _summed(counts: DataFrame, of, s: Settings) -> dict[str, np.ndarray]:
    """Sums over all pairs: ``of(g, n)`` gives by name cells and what is added there; at most a row a cell comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for name, (cell, x) in of(unpacked(keys), np.frombuffer(n, "<u4").astype(np.int64)).items():
                    total = np.bincount(cell, x, 1 << s.bits).astype(np.float64)
                    met = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(met), pa.string()), pa.array(met, pa.int64()), pa.array(total[met])], names=["name", "cell", "x"])

    found = counts.mapInArrow(lambda b: trimmed(run(b)), "name string, cell long, x double").groupBy("name", "cell").agg(F.sum("x").alias("x")).toArrow()
    out: dict[str, np.ndarray] = {}
    names, cells, x = found.column("name").to_numpy(), found.column("cell").to_numpy(), found.column("x").to_numpy()
    for name in set(names.tolist()):
        out[name] = np.zeros(1 << s.bits)
        out[name][cells[names == name]] = x[names == name]
    return out


def _discounts(times: np.ndarray) -> np.ndarray:
    """Discounts of rows by their count (3 for all larger ones), from the numbers of rows with counts 1 to 4."""
    n = times.tolist()
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return np.array([0, *[min(j, max(0.05, j - (j + 1) * y * n[j] / n[j - 1])) if n[j - 1] else 0.5 * j for j in (1, 2, 3)]])


@dataclass
class Model:
    """By bucket: a word's probability after an unknown one; how often a word comes before another, and the weight it leaves to the lower order.

    ``counts`` has the pairs, packed by part; ``discounts`` are theirs.
    """

    word: np.ndarray
    total: np.ndarray
    rest: np.ndarray
    discounts: np.ndarray
    counts: DataFrame
    parts: int

    def gains(self, g: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
        """What seen pairs' log2 probabilities are above those of their words after unknown ones, with the weight left to them."""
        v = g >> bits
        lower = self.rest[v] * self.word[g & ((1 << bits) - 1)]
        return np.log2((n - self.discounts[np.minimum(n, 3)]) / self.total[v] / lower + 1)


def modelled(counts: DataFrame, s: Settings, parts: int) -> Model:
    """Interpolated probabilities from the written counts of pairs.

    A single word counts as often as there are different words before it.
    """
    mask = (1 << s.bits) - 1
    first = _summed(counts, lambda g, n: {"single": (g & mask, None), "times": (np.minimum(n, 5), None)}, s)
    single, times = (first.get(k, np.zeros(mask + 1)) for k in ("single", "times"))
    d1 = _discounts(np.bincount(np.minimum(single, 5).astype(int), minlength=6)[1:5])
    d2 = _discounts(times[1:5])
    off = d1[np.minimum(single, 3).astype(int)]
    seen = single.sum()
    word = (single - off) / seen + off.sum() / seen / (mask + 1) if seen else np.full(mask + 1, 1 / (mask + 1))
    second = _summed(counts, lambda g, n: {"total": (g >> s.bits, n), "left": (g >> s.bits, d2[np.minimum(n, 3)])}, s)
    total, left = (second.get(k, np.zeros(mask + 1)) for k in ("total", "left"))
    rest = np.where(total > 0, left / np.maximum(total, 1), 1.0)
    return Model(word, total, rest, d2, counts, parts)


def trained(df: DataFrame, labels: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """The model from the trusted rows outside the held-out fold."""
    base = work_dir(df.sparkSession, "quality")
    ids = labels.where(F.col(label) == 1).where(~held_out(doc_id)).where(F.col(doc_id).isNotNull()).select(doc_id).distinct()
    ids = written(ids, f"{base}/trusted")
    small = ids.limit(s.broadcast_ids + 1).count() <= s.broadcast_ids
    own = df.select(doc_id, F.col(text).alias("text")).join(F.broadcast(ids) if small else ids, doc_id, "left_semi").select("text")
    words = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(16, -(-words // (6 * s.share)))  # a word has six bytes or more, with its space
    return modelled(written(_counts(own, s, parts), f"{base}/counts"), s, parts)


def _blocks(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[tuple[int, int, list[int], list[str | None]]]:
    """Rows (file, row, text) in blocks of the same ``row // block``: file, first row, places in the block, texts."""
    held: tuple[int, int, list[int], list[str | None]] | None = None
    for part in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
        for file, row, text in zip(*[c.to_pylist() for c in part.columns], strict=True):
            first = row - row % s.block
            if held is None or held[:2] != (file, first):
                if held:
                    yield held
                held = (file, first, [], [])
            held[2].append(row - first)
            held[3].append(text)
    if held:
        yield held


def perplexities(keyed: DataFrame, model: Model, s: Settings, base: str) -> DataFrame:
    """``keyed`` (a row key, the text, others) without its text, with ``n_words`` and ``perplexity``."""
    spark, parts = keyed.sparkSession, model.parts
    shared = spark.sparkContext.broadcast((np.log2(model.word), np.log2(model.rest)))
    whole = spark.sparkContext.broadcast(Model(model.word, model.total, model.rest, model.discounts, None, parts))
    rows = keyed.select(F.col(f"{ROW_KEY}.file").alias("file"), F.col(f"{ROW_KEY}.row").alias("row"), "text")

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's number of words and the sum of its words' logarithms after unknown ones."""
        hashes, (word, rest) = WordHashes(), shared.value
        for part in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            n, found = [], []
            for text in part.column(2).to_pylist():
                x = words_of(text, hashes, s.bits)
                n.append(len(x))
                found.append(float(word[x].sum() + rest[x[:-1]].sum() + rest[0]) if len(x) else 0.0)
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(n, pa.int64()), pa.array(found, pa.float64())], names=["file", "row", "n_words", "base"])

    asking = ["part", "file", "first", "keys", "rows", "at", "more", "often"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct pairs of a block by part, ascending; for each the number of rows that have it, those rows, and how often."""
        hashes = WordHashes()
        for file, first, places, texts in _blocks(batches, s):
            own = [np.unique(pairs_of(words_of(t, hashes, s.bits), s.bits), return_counts=True) for t in texts]
            g = np.concatenate([x for x, _ in own]).astype(np.int64)
            n = np.concatenate([c for _, c in own]).astype("<u4")
            at = np.repeat(np.array(places, np.uint8), [len(x) for x, _ in own])
            part = _part(g, s, parts)
            order = np.lexsort((g, part))
            g, n, at, part = g[order], n[order], at[order], part[order]
            out = []
            for k, begin, end in _runs(part):
                for lo in range(begin, end, SENT):  # a key may go on in the next row
                    hi = min(lo + SENT, end)
                    keys, times = np.unique(g[lo:hi], return_counts=True)
                    more = np.flatnonzero(n[lo:hi] > 1).astype("<u4")
                    out.append((k, file, first, packed(keys), zlib.compress(times.astype("<u2").tobytes(), 1), at[lo:hi].tobytes(), more.tobytes(), n[lo:hi][more].tobytes()))
            yield _columns(out, asking, [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by part, pairs of the model first: of each block the sums by row over the part's pairs."""
        nothing = np.zeros(1, np.int64) - 1, np.zeros(1)
        part, (known, gain) = None, nothing
        block, sums, out = None, np.zeros(s.block), []

        def done() -> None:
            nonlocal sums
            if block is not None and len(hit := np.flatnonzero(sums)):
                out.append((*block, hit.astype(np.uint8).tobytes(), sums[hit].astype("<f4").tobytes()))
                sums = np.zeros(s.block)

        def found() -> pa.RecordBatch:
            return _columns(out, ["file", "first", "at", "gain"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            for k, kind, file, first, keys, rows, at, more, often in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (file, first) != block or k != part:
                    done()
                    block = None if kind == 0 else (file, first)
                keys = unpacked(keys)
                if k != part:
                    part, (known, gain) = k, nothing
                if kind == 0:
                    if len(keys):
                        known, gain = keys, whole.value.gains(keys, np.frombuffer(often, "<u4").astype(np.int64), s.bits)
                    continue
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                each = np.repeat(np.where(known[place] == keys, gain[place], 0), np.frombuffer(zlib.decompress(rows), "<u2"))
                more = np.frombuffer(more, "<u4")
                each[more] *= np.frombuffer(often, "<u4")
                sums += np.bincount(np.frombuffer(at, np.uint8), each, s.block)
            yield found()
            out = []
        done()
        yield found()

    def added(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sums = np.zeros(s.block)
        for at, gain in zip(table.column("at").to_pylist(), table.column("gain").to_pylist(), strict=True):
            sums[np.frombuffer(at, np.uint8)] += np.frombuffer(gain, "<f4")
        hit = np.flatnonzero(sums)
        return pa.table({"file": pa.array(np.full(len(hit), key[0].as_py()), pa.int64()), "row": pa.array(key[1].as_py() + hit, pa.int64()), "gain": pa.array(sums[hit])})

    asked = rows.mapInArrow(lambda b: trimmed(ask(b)), "part int, file long, first long, keys binary, rows binary, at binary, more binary, often binary")
    none = F.lit(None)
    empty = [none.cast("binary").alias(c) for c in ("rows", "at", "more")]
    known = model.counts.select("part", F.lit(0).alias("kind"), none.cast("long").alias("file"), none.cast("long").alias("first"), "keys", *empty, F.col("n").alias("often"))
    both = known.unionByName(asked.select("part", F.lit(1).alias("kind"), *asking[1:]))
    dealt = both.repartition(parts, "part").sortWithinPartitions("part", "kind", "file", "first")
    sums = dealt.mapInArrow(lambda b: trimmed(answer(b)), "file long, first long, at binary, gain binary")
    gains = sums.groupBy("file", "first").applyInArrow(added, "file long, row long, gain double")
    scored = written(rows.mapInArrow(lambda b: trimmed(lower(b)), "file long, row long, n_words long, base double"), f"{base}/lower")
    total = scored.join(gains, ["file", "row"], "left")
    logs = F.when(F.col("n_words") > 0, F.pow(F.lit(2.0), -(F.col("base") + F.coalesce("gain", F.lit(0.0))) / F.col("n_words")))
    found = total.select(F.struct("file", "row").alias(ROW_KEY), "n_words", logs.alias("perplexity"))
    return keyed.drop("text").join(found, ROW_KEY)


def thresholds(scored: DataFrame, labels: DataFrame, s: Settings, doc_id: str = "doc_id", lang: str = "lang", label: str = "quality") -> tuple[dict[str | None, float], float | None]:
    """The quantile of held-out trusted documents, by language and over all.

    Counted in bins, so it doesn't depend on the order of rows.
    """
    trusted = labels.where((F.col(label) == 1) & held_out(doc_id)).select(doc_id).distinct()
    bins = F.ceil(F.log2("perplexity") * BINS).cast("long").alias("bin")
    counts = scored.where(F.col("perplexity").isNotNull()).join(trusted, doc_id, "left_semi").groupBy(lang, bins).count().toArrow().to_pylist()

    def cut(rows: list[dict]) -> float:
        need, so_far = s.quantile * sum(r["count"] for r in rows), 0
        for r in sorted(rows, key=lambda r: r["bin"]):
            so_far += r["count"]
            if so_far >= need:
                return 2 ** (r["bin"] / BINS)
        raise AssertionError

    by: dict[str | None, list[dict]] = {}
    for r in counts:
        by.setdefault(r[lang], []).append(r)
    own = {k: cut(v) for k, v in by.items() if sum(r["count"] for r in v) >= s.least_documents}
    return own, cut(counts) if counts else None


def judged(df: DataFrame, labels: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, lang, n_words, perplexity, threshold, keep`` of every row."""
    spark = df.sparkSession
    base = work_dir(spark, "quality-scores")
    model = trained(df, labels, s, doc_id, text)
    keyed = with_row_key(df.select(F.col(doc_id).alias(doc_id), F.col(lang).alias(lang), F.col(text).alias("text")))
    scored = written(perplexities(keyed, model, s, base).drop(ROW_KEY), f"{base}/scored")
    own, whole = thresholds(scored, labels, s, doc_id, lang)
    table = spark.createDataFrame([(k, float(v)) for k, v in own.items()], "own_lang string, own double")
    out = scored.join(table, F.col(lang).eqNullSafe(F.col("own_lang")), "left")
    threshold = F.coalesce("own", F.lit(whole).cast("double"))
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return out.select(doc_id, lang, "n_words", "perplexity", threshold.alias("threshold"), keep.alias("keep"))

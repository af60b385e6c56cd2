"""Convolutional text classifier over hashed word embeddings, in numpy.

A word's vector is the sum of the embeddings of its hashed features: the word
without edge punctuation, its first letters and its last. Filters of several
widths run over the words, the largest value of each filter over the whole text
is kept, and a linear layer gives a logit. Because a filter is linear before its
maximum, each distinct word is multiplied with the filters once and texts are
sums of looked-up rows.

The logit is shifted by a threshold for the language that the words of the text
itself suggest, so that one cut (``CUT``) on the score holds for all of them.

Defined results: a null text is empty; an empty text gets a score like any
other; a text of any length is scored whole; equal texts get equal scores;
without labelled rows of both classes all scores are 0; all labelled rows outside
the held-out fold are learnt from, in one task while they are few and dealt over all
tasks beyond that, see ``trained``; with few toxic ones
(``Settings.few``) the model is made otherwise, see ``fit``; null labels don't count,
repeated labels of one id count once, as toxic if any is; a carried column with
the name of the score is replaced by it; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import BROADCAST_ROWS, apart, carried, named, numbered, trimmed, work_dir, written

CUT = 0.7
WIDTHS = (1, 2, 3)
#: Frequent function words of each language, for the guess.
FUNCTION_WORDS = {
    "de": "der die das und in von den mit zu ist ein eine im auf für nicht sich".split(),
    "en": "the of and to in a is that it for was on are as with by at from this".split(),
    "es": "el la de que y en los se las del por un para con una su al es lo como".split(),
    "fr": "le la les de des et en un une du que qui est pour dans par sur au avec".split(),
}
LANGUAGES = sorted(FUNCTION_WORDS)
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»¡¿"


@dataclass(frozen=True)
class Settings:
    """Sizes of the model, and of what one task fits alone: with more labelled rows or characters the work is dealt."""

    buckets: int = 1 << 16
    width: int = 16
    filters: int = 16
    positives: int = 2500
    negatives: int = 5000
    sample_chars: int = 40_000_000
    epochs: int = 6
    rate: float = 0.01
    seed: int = 7
    #: With fewer toxic rows than ``few``, the model is the mean of ``members`` small ones.
    few: int = 150
    members: int = 5
    few_buckets: int = 1 << 14
    few_width: int = 8
    few_filters: int = 8
    few_epochs: int = 40


def features(word: str, buckets: int) -> tuple[int, ...]:
    core = word.strip(_EDGES) or word
    parts = ("=" + core, "3" + core[:3], "4" + core[:4], "5" + core[:5], "6" + core[:6], "-" + core[-4:])
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) % buckets for p in parts)


#: One step of a CRC-32, by the byte; code points of a word that are hashed beside those of others.
_STEP, LONGEST = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32), 32
_STEP = (_STEP ^ _STEP[0]).astype(np.uint32)


def _crc_step(crc: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _STEP[(crc ^ byte) & 255] ^ (crc >> 8)


def _crc_of(first: str, points: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC-32 of ``first`` and the first ``n`` code points of each row, all below 0x800, in UTF-8."""
    crc = np.full(len(points), zlib.crc32(first.encode()) ^ 0xFFFFFFFF, np.uint32)
    for k in range(points.shape[1]):
        at = np.flatnonzero(n > k)
        if not len(at):
            break
        c, own = points[at, k], crc[at]
        wide = c > 127
        own = _crc_step(own, np.where(wide, 0xC0 | c >> 6, c))
        crc[at] = np.where(wide, _crc_step(own, 0x80 | c & 63), own)
    return crc ^ np.uint32(0xFFFFFFFF)


def features_of(words: list[str], buckets: int) -> np.ndarray:
    """``features`` of many words, a row each; those of usual letters and length are hashed side by side."""
    out = np.empty((len(words), N_FEATURES), np.int64)
    for lo in range(0, len(words), 8192):
        part = [w.strip(_EDGES) or w for w in words[lo : lo + 8192]]
        n = np.fromiter(map(len, part), np.int64, len(part))
        points = np.array([w[:LONGEST] for w in part], f"U{LONGEST}").view(np.uint32).reshape(-1, LONGEST)
        plain = (n <= LONGEST) & (points.max(1) < 0x800)
        own, rows = out[lo : lo + 8192], np.flatnonzero(plain)
        points, n = points[rows], n[rows]
        begin = np.maximum(n - 4, 0)
        last = points[np.arange(len(rows))[:, None], np.minimum(begin[:, None] + np.arange(4), LONGEST - 1)]
        found = [_crc_of("=", points, n), *[_crc_of(str(k), points[:, :k], np.minimum(n, k)) for k in (3, 4, 5, 6)], _crc_of("-", last, n - begin)]
        own[rows] = np.stack(found, 1) % np.uint32(buckets)
        for k in np.flatnonzero(~plain):
            own[k] = features(part[k], buckets)
    return out


N_FEATURES = len(features("x", 2))


def split_words(text: str | None) -> list[str]:
    return (text or "").lower().split()


@dataclass
class Model:
    embedding: np.ndarray
    kernels: np.ndarray  # (taps, width, filters): of each width one tap after the other
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray  # by LANGUAGES, then any other
    scale: float = 1.0


#: (which width, which place in it) of each tap.
TAPS = [(k, j) for k, w in enumerate(WIDTHS) for j in range(w)]
PAD = max(WIDTHS)


def _pooled(table: np.ndarray, ids: np.ndarray, starts: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Largest filter values of each text; ``table``: word, tap, filter.

    A text's ids end with PAD pads. Windows begin at its words, or at the first
    pad if it has none, so they never reach the next text.
    """
    ends = np.maximum(np.append(starts[1:], len(ids)) - PAD, starts + 1)
    spans = np.stack([starts, ends], 1).ravel()
    tail = np.concatenate([ids, np.zeros(PAD, ids.dtype)])
    out = []
    for k in range(len(WIDTHS)):
        z = None
        for t, (kk, j) in enumerate(TAPS):
            if kk == k:
                part = table[tail[j : j + len(ids)], t]
                z = part if z is None else z + part
        out.append(np.maximum.reduceat(z, spans, axis=0)[::2])
    return np.maximum(np.concatenate(out, axis=1) + bias, 0)


class Words(dict):
    """word -> row of the table of filter products; bounded, then it starts anew."""

    def __init__(self, model: Model, most: int = 60_000):
        super().__init__()
        self.model, self.most = model, most
        self.flat = model.kernels.transpose(1, 0, 2).reshape(model.kernels.shape[1], -1)
        self.table = np.zeros((1024, len(TAPS), model.kernels.shape[2]), np.float32)  # row 0 is padding
        self.lang = np.zeros((1024, len(LANGUAGES)), np.int32)  # whose function word it is
        self.used = 1

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self))
        if len(self) + len(new) > self.most:  # those that are met now are kept, frequent ones are met again
            kept = list(words.difference(new))
            rows = np.fromiter(map(self.__getitem__, kept), np.int64, len(kept))
            self.table[1 : len(kept) + 1] = self.table[rows]
            self.lang[1 : len(kept) + 1] = self.lang[rows]
            self.clear()
            self.used = len(kept) + 1
            self.update(zip(kept, range(1, self.used), strict=True))
        if not new:
            return
        if (need := self.used + len(new)) > len(self.table):
            more = max(need, 2 * len(self.table))
            self.table, self.lang = (np.concatenate([x[: self.used], np.zeros((more - self.used, *x.shape[1:]), x.dtype)]) for x in (self.table, self.lang))
        rows = features_of(new, len(self.model.embedding))
        vectors = self.model.embedding[rows].sum(1)
        self.table[self.used : need] = (vectors @ self.flat).reshape(len(new), *self.table.shape[1:])
        self.lang[self.used : need] = 0
        for k, w in enumerate(new):
            if w in _ANY:
                self.lang[self.used + k] = [w in of for of in _SETS]
        self.update(zip(new, range(self.used, need), strict=True))
        self.used = need


def guessed_languages(lang: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each text the place in LANGUAGES of the most frequent function words, or after them; ``lang``: word, language."""
    counts = np.add.reduceat(lang, starts, axis=0)
    return np.where(counts.any(1), counts.argmax(1), len(LANGUAGES))


_SETS = [frozenset(FUNCTION_WORDS[lang]) for lang in LANGUAGES]
_ANY = frozenset().union(*_SETS)


def _flat(split: list[list[str]], of: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    pads = [0] * PAD
    ids: list[int] = []
    starts = []
    for words in split:
        starts.append(len(ids))
        ids.extend(map(of.__getitem__, words))
        ids.extend(pads)
    return np.array(ids, np.int64), np.array(starts, np.int64)


def logits(texts: list[str | None], model: Model, known: Words) -> tuple[np.ndarray, np.ndarray]:
    """Logits and language guesses of whole texts."""
    split = [split_words(t) for t in texts]
    out, langs, lo = [], [], 0
    while lo < len(split):  # some tens of thousands of words at once
        hi, n = lo, 0
        while hi < len(split) and (hi == lo or n + len(split[hi]) < 60_000):
            n += len(split[hi])
            hi += 1
        part = split[lo:hi]
        known.learn(set().union(*part))
        ids, starts = _flat(part, known)
        out.append(_pooled(known.table, ids, starts, model.bias) @ model.out + model.out_bias)
        langs.append(guessed_languages(known.lang[ids], starts))
        lo = hi
    return (np.concatenate(out), np.concatenate(langs)) if out else (np.zeros(0), np.zeros(0, np.int64))


#: Texts of a step, and words of theirs unless it is one text.
STEP, STEP_WORDS = 32, 50_000


def _steps(order: np.ndarray, docs: list[np.ndarray]) -> Iterator[np.ndarray]:
    lo, n = 0, 0
    for hi, i in enumerate(order):
        if hi > lo and (hi - lo == STEP or n + len(docs[i]) > STEP_WORDS):
            yield order[lo:hi]
            lo, n = hi, 0
        n += len(docs[i])
    if lo < len(order):
        yield order[lo:]


def fit(texts: list[str | None], toxic: np.ndarray, s: Settings) -> Model:
    """The model with its thresholds, which are cut on rows that it wasn't fitted on.

    Empty texts are added as harmless ones, so that the absence of words is no
    evidence. Few toxic rows say too little for one large model and for a fifth of
    them to cut on: there each of several small ones leaves out a part, the cuts come
    from all parts, and the mean of the models is written as one.
    """
    texts = [*texts, *[""] * (len(texts) // 50 + 1)]
    toxic = np.concatenate([toxic, np.zeros(len(texts) - len(toxic), np.int64)])
    if toxic.sum() >= s.few:
        r = np.random.default_rng(s.seed)
        parts = [r.random(len(texts)) < 0.2]
        members = [_fitted(texts, toxic, parts[0], s)]
    else:
        order = np.random.default_rng(s.seed).permutation(len(texts))
        place = np.empty(len(texts), np.int64)
        place[order[np.argsort(toxic[order], kind="stable")]] = np.arange(len(texts)) % s.members
        small = replace(s, buckets=s.few_buckets, width=s.few_width, filters=s.few_filters, epochs=s.few_epochs)
        parts = [place == k for k in range(s.members)]
        members = [_fitted(texts, toxic, part, replace(small, seed=s.seed + k)) for k, part in enumerate(parts)]
    found = [(*logits([texts[i] for i in np.flatnonzero(part)], m, Words(m)), toxic[part]) for m, part in zip(members, parts, strict=True)]
    model = merged(members)
    model.thresholds = calibrated(*(np.concatenate(x) for x in zip(*found, strict=True)))
    return model


def merged(members: list[Model]) -> Model:
    """The model whose logit is the mean of those of ``members``: widths and filters side by side."""
    if len(members) == 1:
        return members[0]
    taps, width, filters = members[0].kernels.shape
    n = len(members)
    kernels = np.zeros((taps, n * width, n * filters), np.float32)
    for k, m in enumerate(members):
        kernels[:, k * width : (k + 1) * width, k * filters : (k + 1) * filters] = m.kernels
    beside = lambda name: np.concatenate([getattr(m, name).reshape(len(WIDTHS), filters) for m in members], 1).ravel()
    embedding = np.concatenate([m.embedding for m in members], 1)
    return Model(embedding, kernels, beside("bias"), beside("out") / n, sum(m.out_bias for m in members) / n, np.zeros(len(LANGUAGES) + 1))


def _started(s: Settings, r: np.random.Generator) -> dict[str, np.ndarray]:
    """The parameters before any row was met."""
    return {
        "embedding": r.normal(0, 0.1, (s.buckets, s.width)).astype(np.float32),
        "kernels": r.normal(0, 0.3, (len(TAPS), s.width, s.filters)).astype(np.float32),
        "bias": np.zeros(len(WIDTHS) * s.filters, np.float32),
        "out": r.normal(0, 0.1, len(WIDTHS) * s.filters).astype(np.float32),
        "out_bias": np.zeros(1, np.float32),
    }


def _model(p: dict[str, np.ndarray]) -> Model:
    return Model(p["embedding"], p["kernels"], p["bias"], p["out"], float(p["out_bias"][0]), np.zeros(len(LANGUAGES) + 1))


def _ratio(toxic: int, rows: int) -> float:
    """What a toxic row weighs."""
    return min(4.0, max(1.0, (rows - toxic) / max(1, toxic)))


def _fitted(texts: list[str | None], toxic: np.ndarray, check: np.ndarray, s: Settings) -> Model:
    """Adam on the log loss over the rows not in ``check``."""
    r = np.random.default_rng(s.seed)
    adam = Adam(_started(s, r), s, r)
    adam.learn(texts, toxic, np.flatnonzero(~check), s.epochs, _ratio(int(toxic.sum()), len(toxic)))
    return _model(adam.p)


class Adam:
    """Parameters that learn from portions of rows, gradients flowing through the largest windows only."""

    def __init__(self, p: dict[str, np.ndarray], s: Settings, r: np.random.Generator):
        self.p, self.s, self.r, self.step = p, s, r, 0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
        self.met = np.zeros(len(p["embedding"]), np.float32)  # steps that moved each row

    def learn(self, texts: list[str | None], toxic: np.ndarray, train: np.ndarray, epochs: int, ratio: float) -> None:
        p, s, r, moments, step = self.p, self.s, self.r, self.moments, self.step
        vocabulary: dict[str, int] = {}
        docs = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in split_words(t)], np.int32) for t in texts]
        feats = np.zeros((len(vocabulary) + 1, N_FEATURES), np.int32)
        feats[1:] = features_of(list(vocabulary), s.buckets)
        weight = np.where(toxic == 1, ratio, 1.0)
        for _ in range(epochs):
            r.shuffle(train)
            for chosen in _steps(train, docs):
                pads = np.zeros(PAD, np.int64)
                parts = [np.concatenate([docs[i], pads]) for i in chosen]
                starts = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
                words, ids = np.unique(np.concatenate([[0], *parts]), return_inverse=True)
                ids = ids[1:]
                vectors = p["embedding"][feats[words]].sum(1)
                vectors[0] = 0
                table = np.einsum("nd,tdf->ntf", vectors, p["kernels"])
                tail = np.concatenate([ids, np.zeros(PAD, np.int64)])
                pooled, where = [], []
                for k in range(len(WIDTHS)):
                    z = sum(table[tail[j : j + len(ids)], t] for t, (kk, j) in enumerate(TAPS) if kk == k)
                    at = np.stack([z[a : max(a + 1, b - PAD)].argmax(0) + a for a, b in zip(starts[:-1], starts[1:], strict=True)])
                    where.append(at)
                    pooled.append(np.take_along_axis(z, at, 0))
                h = np.concatenate(pooled, 1) + p["bias"]
                drop = (r.random(h.shape) < 0.8) / 0.8
                a = np.maximum(h, 0) * drop
                y = a @ p["out"] + p["out_bias"]
                g = ((1 / (1 + np.exp(-y))) - toxic[chosen]) * weight[chosen] / len(chosen)
                ga = np.outer(g, p["out"]) * drop * (h > 0)
                grads = {"out": a.T @ g, "out_bias": np.array([g.sum()]), "bias": ga.sum(0)}
                gk, gv = np.zeros_like(p["kernels"]), np.zeros_like(vectors)
                for t, (k, j) in enumerate(TAPS):
                    for f in range(s.filters):
                        row = tail[where[k][:, f] + j]
                        gg = ga[:, k * s.filters + f]
                        gk[t, :, f] = vectors[row].T @ gg
                        np.add.at(gv, row, np.outer(gg, p["kernels"][t, :, f]))
                gv[0] = 0
                grads["kernels"] = gk
                step += 1
                fix = s.rate * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for name, grad in grads.items():
                    m, v = moments[name]
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    p[name] -= fix * m / (np.sqrt(v) + 1e-7)
                hit = np.flatnonzero(np.abs(gv).sum(1))  # only rows that were met move
                rows = feats[words[hit]].ravel()
                uniq, back = np.unique(rows, return_inverse=True)
                self.met[uniq] += 1
                grad = np.zeros((len(uniq), s.width), np.float32)
                np.add.at(grad, back, np.repeat(gv[hit], N_FEATURES, axis=0))
                m, v = moments["embedding"]
                m[uniq] += 0.1 * (grad - m[uniq])
                v[uniq] += 0.001 * (grad * grad - v[uniq])
                p["embedding"][uniq] -= fix * m[uniq] / (np.sqrt(v[uniq]) + 1e-7)
        self.step = step


def calibrated(y: np.ndarray, lang: np.ndarray, toxic: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """The cut with the best F1 in each language; over all where a class is rare there. ``n``: how many rows each value stands for."""
    n = np.ones(len(y), np.int64) if n is None else n

    def best(y: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> float:
        order = np.argsort(-y, kind="stable")
        y, hits = y[order], np.cumsum((toxic * n)[order])
        f1 = 2 * hits / (np.cumsum(n[order]) + (toxic * n).sum())
        k = int(np.argmax(f1))
        return float((y[k] + y[min(k + 1, len(y) - 1)]) / 2)

    whole = best(y, toxic, n) if toxic.any() else 0.0
    out = np.full(len(LANGUAGES) + 1, whole)
    for k in range(len(out)):
        own = lang == k
        if n[own & (toxic == 1)].sum() >= 10 and n[own & (toxic == 0)].sum() >= 10:
            out[k] = best(y[own], toxic[own], n[own])
    return out


def training_sample(df: DataFrame, labels: DataFrame, s: Settings, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """All labelled rows ``o, text, y`` outside the held-out fold, each id once, written; ``o`` is a hash of the id."""
    base = work_dir(df.sparkSession, "toxicity")
    marked = labels.where(~held_out(doc_id)).where(F.col(label).isin(0, 1)).groupBy(doc_id).agg(F.max(label).cast("int").alias("y"))
    marked = written(marked.withColumn("o", F.xxhash64(F.lit("toxicity"), doc_id)), f"{base}/marked")
    few = marked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = df.select(doc_id, text).join(F.broadcast(marked) if few else marked, doc_id)
    found = found.groupBy("o", "y", doc_id).agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias("text"))  # of rows with one id the least text
    return written(found.select("o", "y", "text"), f"{base}/sample")


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def trained(df: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model | None:
    """The model, fitted on all labelled rows; None without labelled rows of both classes.

    As many rows as ``Settings`` bounds are fitted by one task; more of them are dealt, see ``_dealt``.
    """
    rows = training_sample(df, labels, s)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic"), F.sum(F.length("text")).alias("chars")).first()
    if not size.toxic or size.toxic == size.n:
        return None
    if size.n > s.positives + s.negatives or size.chars > s.sample_chars:
        return _dealt(rows, size.n, size.toxic, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sorted(((k, t, y) for b in batches for k, t, y in zip(*[c.to_pylist() for c in b.columns], strict=True)))
        model = apart(fit, [t for _, t, _ in parts], np.array([y for _, _, y in parts], np.int64), s)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = rows.select("o", "text", "y").coalesce(1).mapInArrow(lambda b: trimmed(run(b)), "model binary").collect()
    return pickle.loads(found[0].model)


#: Rounds of a dealt fit at least; rows and characters that a task learns from at once; steps of a logit in the counts that cuts are made on; rows of the embedding that are summed together.
ROUNDS, PORTION, PORTION_CHARS, FINE, BLOCK = 6, 2048, 16_000_000, 256, 4096


def _dealt(rows: DataFrame, n: int, n_toxic: int, s: Settings) -> Model:
    """The model fitted by all tasks in rounds, on a fifth of the rows fewer than all, on which cuts are made.

    In a round each task learns from its rows, beginning with the same parameters,
    portion by portion; then parameters are averaged, rows of the embedding over the
    tasks that met them. The more rows there are the fewer passes are made over them,
    one at least, so that the work grows with the rows.
    """
    spark = rows.sparkSession
    tasks = max(1, min(spark.sparkContext.defaultParallelism, n // PORTION))
    passes = max(1, min(s.epochs, round(s.epochs * (s.positives + s.negatives) / n)))
    parts = -(-ROUNDS // passes)  # of a pass
    ratio = _ratio(n_toxic, n)
    draw = lambda salt, k: F.pmod(F.xxhash64(F.lit(salt), "o"), F.lit(k))
    dealt = rows.select("o", "text", "y", (draw("check", 5) == 0).alias("check"), draw("part", parts).alias("part"))
    dealt = written(dealt.repartition(tasks, F.xxhash64(F.lit("task"), "o")).sortWithinPartitions("o"), work_dir(spark, "toxicity-dealt"))
    p = _started(s, np.random.default_rng(s.seed))
    for k in range(passes * parts):
        p = _round(dealt.where(~F.col("check") & (F.col("part") == k % parts)).select("o", "text", "y"), p, ratio, k, tasks, s)
    model = _model(p)
    shared = spark.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(shared.value)
        for part in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            y, lang = logits(part.column(0).to_pylist(), shared.value, known)
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(y * FINE).astype(np.int64)), pa.array(lang), part.column(1)], names=["at", "lang", "y"])

    found = dealt.where("check").select("text", "y").mapInArrow(lambda b: trimmed(judged(b)), "at long, lang long, y int")
    got = found.groupBy("at", "lang", "y").agg(F.count(F.lit(1)).alias("n")).toArrow()  # bounded by the steps of a logit
    at, lang, y, count = (got.column(c).to_numpy() for c in ("at", "lang", "y", "n"))
    model.thresholds = calibrated(at / FINE, lang, y.astype(np.int64), count)
    return model


def _round(rows: DataFrame, p: dict[str, np.ndarray], ratio: float, number: int, tasks: int, s: Settings) -> dict[str, np.ndarray]:
    """The mean of what tasks learn from their rows, each beginning with ``p``."""
    shared = rows.sparkSession.sparkContext.broadcast(p)
    dense = [name for name in p if name != "embedding"]

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adam, done = None, 0
        texts, toxic, chars = [], [], 0

        def portion() -> None:
            nonlocal adam
            adam = adam or Adam({k: v.copy() for k, v in shared.value.items()}, s, np.random.default_rng([s.seed, number]))
            y = np.array([*toxic, *[0] * (len(texts) // 50 + 1)], np.int64)  # empty texts, as in ``fit``
            adam.learn([*texts, *[""] * (len(y) - len(texts))], y, np.arange(len(y)), 1, ratio)

        for part in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            texts += part.column(1).to_pylist()
            toxic += part.column(2).to_pylist()
            chars += part.column(1).nbytes
            if len(texts) >= PORTION or chars >= PORTION_CHARS:
                portion()
                done += len(texts)
                texts, toxic, chars = [], [], 0
        if texts:
            portion()
            done += len(texts)
        if adam is None:
            return
        found = [(-1, np.array([done], np.float32), np.concatenate([adam.p[k].ravel() for k in dense]) * done)]
        found += [(lo, adam.met[lo : lo + BLOCK], adam.p["embedding"][lo : lo + BLOCK] * adam.met[lo : lo + BLOCK, None]) for lo in range(0, s.buckets, BLOCK)]
        for lo, weight, value in found:
            columns = [pa.array([lo], pa.int32()), pa.array([weight.tobytes()], pa.binary()), pa.array([value.astype(np.float32).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["lo", "weight", "value"])

    def added(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        weight, value = (sum(np.frombuffer(x, np.float32) for x in table.column(c).to_pylist()) for c in ("weight", "value"))
        return pa.table({"lo": pa.array([key[0].as_py()], pa.int32()), "weight": pa.array([weight.tobytes()], pa.binary()), "value": pa.array([value.tobytes()], pa.binary())})

    kind = "lo int, weight binary, value binary"
    summed = rows.coalesce(tasks).mapInArrow(lambda b: trimmed(learnt(b)), kind).groupBy("lo").applyInArrow(added, kind).collect()
    shared.destroy()
    out = {k: v.copy() for k, v in p.items()}
    for row in summed:
        weight, value = np.frombuffer(row.weight, np.float32), np.frombuffer(row.value, np.float32)
        if row.lo >= 0:
            met = np.flatnonzero(weight)
            out["embedding"][row.lo + met] = value.reshape(len(weight), -1)[met] / weight[met, None]
        else:
            at = 0
            for name in dense:
                out[name] = (value[at : at + p[name].size] / weight[0]).reshape(p[name].shape)
                at += p[name].size
    return out


def scores(texts: list[str | None], model: Model | None, known: Words | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    y, lang = logits(texts, model, known)
    return 1 / (1 + np.exp(-np.clip(y - model.thresholds[lang], -30, 30) - math.log(CUT / (1 - CUT))))


def clean(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows with a score below CUT, with all their columns."""
    plain, names = numbered(df)
    shared, column = df.sparkSession.sparkContext.broadcast(model), names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = Words(model) if model else None
        for part in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            yield part.filter(pa.array(scores(part.column(column).to_pylist(), model, known) < CUT))

    return named(plain.mapInArrow(lambda b: trimmed(run(b)), plain.schema), names)


def scored(df: DataFrame, model: Model | None, text: str = "text", carry: list[str] | None = None, score: str = "score") -> DataFrame:
    """The columns of ``carry`` (all by default) of each row with its score, which replaces a column of that name."""
    carry = carried(df, carry, (score,))
    shared = df.sparkSession.sparkContext.broadcast(model)
    columns = [F.col(c) for c in carry] + [F.col(text).alias("_scored_text")]
    source = df.select(*columns)
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = Words(model) if model else None
        for part in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            value = scores(part.column(part.num_columns - 1).to_pylist(), model, known)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(value, pa.float64())], names=[*carry, score])

    return source.mapInArrow(lambda b: trimmed(run(b)), schema)

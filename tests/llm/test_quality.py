import math
import random

from folioscope.llm import quality

S = quality.Settings(bits=6, least_documents=20, block=64, share=50)


def made(seed=4, n=400):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        words = ["ab", "abe", "dab", "bead", "ad"] if good else ["%&", "ZZ", "!!b", "##"]
        rows.append((i, " ".join(r.choice(words) for _ in range(r.randint(5, 60))), r.choice(["x", "y"])))
        labels.append((i, int(good), 0))
    return rows, labels


def brute(texts, s):
    """Interpolated modified Kneser-Ney from its definition, by dictionaries: perplexity of a text."""
    hashes = quality.WordHashes()
    words = lambda t: [0, *quality.words_of(t, hashes, s.bits).tolist()]
    two, one = {}, {}
    for t in texts:
        x = words(t)
        for g in zip(x, x[1:]):
            two[g] = two.get(g, 0) + 1
    for _, w in two:
        one[w] = one.get(w, 0) + 1

    def discounts(c):
        n = [sum(v == j for v in c.values()) for j in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        return [min(j, max(0.05, j - (j + 1) * y * n[j] / n[j - 1])) if n[j - 1] else 0.5 * j for j in (1, 2, 3)]

    d1, d2 = discounts(one), discounts(two)

    def p(v, w):
        mass = sum(d1[min(n, 3) - 1] for n in one.values()) / sum(one.values())
        low = (one[w] - d1[min(one[w], 3) - 1]) / sum(one.values()) if w in one else 0
        low += mass / 2**s.bits
        follow = {b: n for (a, b), n in two.items() if a == v}
        if not follow:
            return low
        own = (follow[w] - d2[min(follow[w], 3) - 1]) / sum(follow.values()) if w in follow else 0
        return own + sum(d2[min(n, 3) - 1] for n in follow.values()) / sum(follow.values()) * low

    def perplexity(text):
        x = words(text)
        logs = [math.log2(p(v, w)) for v, w in zip(x, x[1:])]
        return 2 ** (-sum(logs) / len(logs)) if logs else None

    return perplexity, p


def test_perplexities_match_the_definition(spark):
    rows, labels = made(n=150)
    rows += [(500, "never seen words ab", "x"), (501, "", "x"), (502, None, "y"), (503, "ab " * 3000, "y"), (503, "ab", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.doc_id, r.n_words): r.perplexity for r in quality.judged(docs, marks, S).collect()}
    held = {r.doc_id for r in docs.where(quality.held_out("doc_id")).collect()}
    perplexity, p = brute([t for (i, t, _), (_, q, _) in zip(rows, labels) if q and i not in held], S)
    assert len(got) == len(rows)
    for i, t, _ in rows:
        want = perplexity(t)
        own = got[i, len((t or "").split())]
        assert own is None if want is None else abs(own / want - 1) < 1e-4
    assert abs(sum(p(5, w) for w in range(64)) - 1) < 1e-9


def test_keeps_clean_and_drops_junk(spark):
    rows, labels = made()
    odd = [(1000, None, "x"), (1001, "", "y"), (None, " ".join(random.Random(2).choices(["ab", "abe", "dab", "bead", "ad"], k=400)), None), (1002, " ".join(random.Random(1).choices(["ab", "abe", "dab", "bead", "ad"], k=60_000)), "z")]
    docs = spark.createDataFrame([(*r, 0.5) for r in [*rows, *odd]], "doc_id long, text string, lang string, threshold double")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judged(docs, marks, S).collect()}
    assert len(got) == len(rows) + 4
    right = sum(got[i].keep == bool(q) for i, q, _ in labels) / len(labels)
    assert right > 0.95
    assert not got[1000].keep and got[1001].perplexity is None and got[1002].keep and got[None].keep
    assert got[0].threshold is not None and got[1002].threshold is not None


def test_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "abc", "x")], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    row = quality.judged(docs, marks, S).first()
    assert row.keep and row.threshold is None and abs(row.perplexity - 64) < 1e-3
    assert quality.judged(docs.where("doc_id > 3"), marks, S).count() == 0

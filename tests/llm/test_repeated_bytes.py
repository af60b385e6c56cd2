"""Repeated stretches of bytes against a count of every window."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import repeated_bytes

KIND = "doc_id long, text string, Kept string"


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(t[s : s + length] for _, t in texts for s in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for s in range(len(t) - length + 1):
            if n[t[s : s + length]] > 1:
                gone[s + 1 : s + 1 + length] = True
        kept = bytes(b for b, g in zip(t, gone[1:-1]) if not g)
        out.append((i, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, length=200, **kw):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], KIND).repartition(3)
    return sorted((tuple(r) for r in repeated_bytes.summarised(repeated_bytes.without_repeats(df, length=length, **kw)).collect()), key=repr)


def planted(rng, n):
    """Copies, near copies, shared passages in other surroundings, long lines of one byte, and texts of their own."""
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(2, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    passage, base = text(70), text(150)
    rows = [(i, text(rng.integers(0, 120))) for i in range(n)]
    rows += [(1000 + i, text(rng.integers(0, 20)) + passage + text(rng.integers(0, 20))) for i in range(n)]
    for i in range(n):
        words = base.split()
        words[rng.integers(len(words))] = word()
        rows.append((2000 + i, " ".join(words)))
    rows += [(3000 + i, base) for i in range(4)] + [(3000, base)]
    rows += [(4000, "x" * 700), (4001, "ab" * 300), (4002, "x" * 200), (4003, "x" * 199), (4004, base + base), (4005, text(40) * 2)]
    return [*rows, (5000, None), (5001, ""), (None, passage), (None, None)]


@pytest.mark.parametrize("hot", [2000, 3])
def test_planted_texts(spark, hot):
    rows = planted(np.random.default_rng(7), 25)
    assert got(spark, rows, hot=hot) == brute(rows, 200)
    assert got(spark, rows, length=37, hot=hot) == brute(rows, 37)


def test_lists_that_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(repeated_bytes, "SENT", 0)
    rows = planted(np.random.default_rng(8), 8)
    assert got(spark, rows) == brute(rows, 200)


def test_long_text_in_pieces():
    """Each window of a text longer than a piece belongs to one span, with the same anchor as without the cut."""
    rng = np.random.default_rng(1)
    long = rng.integers(0, 256, repeated_bytes.PIECE + 5000, dtype=np.uint8).tobytes()
    found, anchors = [], repeated_bytes.Anchors(200, 40)
    for pieces in repeated_bytes._pieces([b"short", None, long, long[:300]], 200):
        assert sum(len(p) for _, _, p in pieces) <= repeated_bytes.PIECE
        for document, h, d, place in anchors.spans(pieces):
            found += zip(document.tolist(), (place >> 32).tolist(), (place >> 16 & 0xFFFF).tolist())
    for k, n in ((2, len(long)), (3, 300)):
        own = sorted(s for doc, first, count in found if doc == k for s in range(first, first + count))
        assert own == list(range(n - 199))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=8, max_size=40), min_size=1, max_size=6), st.integers(8, 20))
def test_radix_sort(texts, length):
    data = "".join(texts).encode()
    if len(data) < length:
        return
    starts = np.arange(len(data) - length + 1)
    group = starts % 2
    n = Counter((s % 2, data[s : s + length]) for s in starts.tolist())
    want = [s for s in starts.tolist() if n[s % 2, data[s : s + length]] > 1]
    assert sorted(repeated_bytes.equal_windows(data, starts, group, length).tolist()) == want


def test_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a" * 300, "x")], "id long, Text string, removed string")
    out = repeated_bytes.without_repeats(df, text="Text")
    assert out.columns == ["id", "n_bytes", "removed", "kept"]
    assert repeated_bytes.without_repeats(df.limit(0), text="Text").count() == 0
    with pytest.raises(ValueError):
        repeated_bytes.without_repeats(df, text="Text", length=7)

"""Token ids of whole texts by a public tokenizer file, piece by piece.

The tokenizer drops white space and cuts texts into runs of letters, digits,
runs of marks and a few endings, and encodes each of these pieces by itself.
A text of Latin letters, digits and marks is cut the same way here; of any other
text the words are looked at one by one, and odd ones are encoded whole. Each task
remembers the ids of pieces and asks the tokenizer only for new ones, many at a time.
"""

from __future__ import annotations

import os
import re
from collections.abc import Set

import numpy as np

from .rows import KEPT

#: Pieces remembered by a worker; then it keeps those of the texts at hand alone.
CACHE_PIECES = 250_000
_ODD = re.compile("[\x1c-\x1f]")
#: Latin letters that are one code point in any normal form, and whose lower case is one of them.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ƀ"
_MARKS = r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"
_PLAIN = re.compile(rf"[{_LETTERS}0-9{_MARKS} \t-\r]*")
#: What the tokenizer cuts off from letters, in lower-cased plain texts: an ending, a digit or a run of marks (by its first sign, as that is found fast).
_APART = re.compile(rf"[0-9{_MARKS}](?:(?<=')(?:s|t|re|ve|m|ll|d)|(?<=[{_MARKS}])[{_MARKS}]+)?")
_PLAIN_SPACE = re.compile("[ \t\r\n]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def words_of(text: str) -> list[str]:
    """Split at white space that the tokenizer drops as well."""
    if _ODD.search(text):  # str.split takes these for white space, the tokenizer doesn't
        return [w for w in _PLAIN_SPACE.split(text) if w]
    return text.split()


def pieces_of(text: str, odd: set[str]) -> list[str]:
    """The pieces of a text; words that are not plain, or may hold special tokens, are a piece each and go to ``odd`` as well."""
    if "<|" not in text and _PLAIN.fullmatch(text):
        return _APART.sub(r" \g<0> ", text.lower()).split()
    out = []
    for w in words_of(text):
        if "<|" not in w and _PLAIN.fullmatch(w):
            out += _APART.sub(r" \g<0> ", w.lower()).split()
        else:
            odd.add(w)
            out.append(w)
    return out


class WordTokens(dict):
    """piece -> its ids as little-endian unsigned 32-bit bytes.

    Plain pieces are in the form that the tokenizer's normalizers give, so its
    model is asked for them without these, with bytes spelt as its byte level has them.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.model = self.of.model
        plain = filter(_PLAIN.fullmatch, map(chr, range(0x80, 0x250)))
        self.spelt = {ord(c): "".join(p for p, _ in self.of.pre_tokenizer.pre_tokenize_str(c)) for c in plain}

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = np.array(self.of.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        return ids

    def learn(self, met: Set[str], odd: Set[str] = frozenset()) -> None:
        """Look up new pieces, but for ``odd`` ones, which are looked up when they are met."""
        new = met.difference(self)
        if len(self) + len(new) > CACHE_PIECES:
            kept = {p: self[p] for p in met.difference(new)}  # frequent ones are met again
            self.clear()
            self.update(kept)
        ids: list[int] = []
        plain, ends, tokenize = list(new.difference(odd) if odd else new), [0], self.model.tokenize
        for p in plain:
            ids += [t.id for t in tokenize(p if p.isascii() else p.translate(self.spelt))]
            ends.append(4 * len(ids))
        whole = np.array(ids, "<u4").tobytes()
        self.update(zip(plain, [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        odd: set[str] = set()
        split = [pieces_of(t, odd) for t in texts]
        self.learn(set().union(*split), odd)
        return [b"".join(map(self.__getitem__, p)) for p in split]


_KNOWN: dict[str, WordTokens] = KEPT.setdefault("tokens", {})


def tokens(path: str) -> WordTokens:
    """The worker's own table for a tokenizer file; it stays between tasks, until another operator uses the worker."""
    if path not in _KNOWN:
        _KNOWN[path] = WordTokens(path)
    return _KNOWN[path]

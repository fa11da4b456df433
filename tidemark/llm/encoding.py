"""Ids of whole texts by a tokenizers model, a distinct stretch of text at a time.

Both models cut a text before they merge anything, and no cut-out part reaches over the borders
used here, so the ids of a text are those of its stretches one after another:

* words: a model that drops white space. Stretches lie between ASCII white space.
* spaced: a byte-level model. A stretch is a run of white space and the run of other characters
  after it; white space at the end of the text is a stretch of its own. Python and the model differ
  on the characters 1C to 1F, so a text that holds one is encoded whole.

A stretch of plain letters is one part for either model, and so is the punctuation after it: they go
to the model's merges at once, without the general cutting. Any other stretch is encoded in full."""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np

#: Distinct stretches whose ids a worker keeps at a time.
KEPT = 500_000

# Letters that are one code point in any form, and punctuation but for the apostrophe, which may belong to letters.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PUNCTUATION = "!-&(-/:-@[-`{-~"
simple = {
    "words": re.compile(f"()([{LETTERS}]+)([{PUNCTUATION}]*)").fullmatch,
    "spaced": re.compile(f"(\n?)( ?[{LETTERS}]+)([{PUNCTUATION}]*)").fullmatch,
}
spaced = re.compile(r"\s*\S+|\s+").findall
unsure = re.compile("[\x1c-\x1f]").search
# What Python takes for white space besides space and line end, or the first bytes of it in UTF-8, and gaps of more than one.
ODD_SPACE = (
    *(bytes([c]) for c in (*range(0x09, 0x0A), *range(0x0B, 0x0E), *range(0x1C, 0x20))),
    b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80",
)
WIDE_GAPS = b"  ", b"\n\n", b" \n", b"\n "


def single_gaps(text: bytes) -> bool:
    """Whether only single spaces and single line ends stand between its words, and none around them;
    False also where that would take a closer look."""
    return bool(text) and text[0] not in b" \n" and text[-1] not in b" \n" and not any(map(text.__contains__, WIDE_GAPS)) and not any(map(text.__contains__, ODD_SPACE))


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    return found


def byte_letters() -> dict[int, str]:
    """The letter of each byte in a byte-level vocabulary: printable ones stand for themselves, the
    others, in order, for what follows the 256th code point."""
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class Kept(dict):
    """The ids of stretches, as bytes. What is missing is made when it is asked for; at half of
    KEPT the older half goes, but for what is asked for again."""

    def __init__(self, made):
        self.made, self.older = made, {}

    def __missing__(self, key) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.made(key)
        if len(self) >= KEPT // 2:
            self.older = dict(self)
            self.clear()
        self[key] = ids
        return ids


class Encoder:
    """Ids as little-endian unsigned numbers, of 16 bits if the vocabulary allows it."""

    def __init__(self, path: str, kind: str):
        self.kind, self.tokenizer = kind, tokenizer(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.letters, self.fits = byte_letters(), simple[kind]
        if kind == "words":
            self.kept = Kept(lambda word: self.word(word.decode()))
            self.of = self.of_words
        else:
            self.kept = Kept(self.stretch)
            self.after_space = Kept(lambda word: self.stretch(" " + word))
            self.of = self.of_spaced

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.dtype).tobytes()

    def full(self, stretch: str) -> bytes:
        return self.packed(self.tokenizer.encode(stretch, add_special_tokens=False).ids)

    def merged(self, part: str) -> bytes:
        """Of one part that nothing cuts."""
        if not part.isascii() or part[0] == " ":
            part = part.encode().decode("latin-1").translate(self.letters)
        return self.packed([t.id for t in self.tokenizer.model.tokenize(part)])

    def word(self, word: str) -> bytes:
        if not (word.isascii() and word.isalpha()):
            m = self.fits(word)
            if not m:
                return self.full(word)
            if m[3]:
                return self.kept[m[2].encode()] + self.kept[m[3].encode()]
        low = word.lower()
        return self.merged(word) if low == word else self.kept[low.encode()]

    def stretch(self, stretch: str) -> bytes:
        m = self.fits(stretch)
        if not m:
            return self.full(stretch)
        if not (m[1] or m[3]):
            return self.merged(stretch)
        letters = self.after_space[m[2][1:]] if m[2][0] == " " else self.kept[m[2]]
        return (self.kept[m[1]] if m[1] else b"") + letters + (self.kept[m[3]] if m[3] else b"")

    def of_words(self, text: bytes) -> bytes:
        return b"".join(map(self.kept.__getitem__, text.split()))

    def of_spaced(self, text: bytes) -> bytes:
        whole, kept = text.decode(), self.kept.__getitem__
        if not single_gaps(text):
            return b"".join(map(kept, [whole] if whole and unsure(whole) else spaced(whole)))
        out, after_space = [], self.after_space.__getitem__
        for words in (line.split(" ") for line in whole.split("\n")):
            out.append(kept("\n"))
            out.append(kept(words[0]))
            out.extend(map(after_space, words[1:]))
        return b"".join(out[1:])

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        return [self.of(t) for t in texts]


_encoders: dict = {}


def encoder(path: str, kind: str) -> Encoder:
    """This worker's encoder, which keeps what it has encoded from task to task."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]

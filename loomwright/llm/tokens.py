"""Token ids of whole texts, encoded with the tokenizers library, word by word with a cache of words.

Both vocabularies treat an ASCII space as the end of what stands before it, so a text without double, leading or trailing
spaces encodes as its space-separated words do. Any other text is encoded whole. Words repeat, so most are looked up.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np

from .common import held

#: Letters whose words are one pre-token each (Latin, all unchanged by NFC), and marks that are one when they follow each other.
LETTERS, MARKS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+"), ".,!%#$&*"
#: Words that a worker keeps: some at once, more when they come again, and marked words beside them. The rest are put together
#: whenever they come. What has come is remembered by so many hash slots.
KEPT_AT_ONCE, KEPT_WORDS, KEPT_MARKED, SLOTS = 200_000, 400_000, 100_000, 1 << 22


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in own)
    moved = {b: chr(256 + i) for i, b in enumerate(rest)}
    return [moved.get(b, chr(b)) for b in range(256)]


class Words(dict):
    """Word -> its ids where it stands after ``space``, as little-endian 32-bit bytes. A word of letters with marks behind it is put
    together from both, one with a line's end in it from its lines; any other is encoded whole."""

    def __init__(self, encoder: Encoder, space: str):
        self.encoder, self.space, self.marked, self.came = encoder, space, 0, bytearray(SLOTS)

    def __missing__(self, word: str) -> bytes:
        letters = word.rstrip(MARKS)
        if len(letters) < len(word) and LETTERS.fullmatch(letters):
            ids = self[letters] + self.encoder.marks[word[len(letters) :]]
            if self.marked < KEPT_MARKED:
                self.marked += 1
                self[word] = ids
            return ids
        if LETTERS.fullmatch(word):
            ids = self.encoder.of_letters(self.space, word)
        else:
            head, line, tail = word.partition("\n")
            if line and LETTERS.fullmatch(head.rstrip(MARKS)) and LETTERS.fullmatch(tail.rstrip(MARKS)):
                return self[head] + self.encoder.newline + self.encoder.first[tail]
            ids = self.encoder.ids_of_whole(self.space + word)
        slot = hash(word) & SLOTS - 1
        if len(self) - self.marked < (KEPT_WORDS if self.came[slot] else KEPT_AT_ONCE):
            self[word] = ids
        self.came[slot] = 1
        return ids


class Marks(dict):
    """Marks in a row, one pre-token -> their ids."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, marks: str) -> bytes:
        ids = self.encoder.pre_token(marks)
        if len(self) < KEPT_MARKED:
            self[marks] = ids
        return ids


class Encoder:
    """encode(text) -> ids as little-endian unsigned 32-bit bytes, equal to tokenizers' encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # words are kept here instead
        self.letters = byte_letters()
        self.spaced = self.ids_of_whole(" a") != self.ids_of_whole("a")
        self.lower = self.ids_of_whole("A") == self.ids_of_whole("a")
        self.newline = self.ids_of_whole("\n")
        self.marks, self.first = Marks(self), Words(self, "")
        self.later = Words(self, " ") if self.spaced else self.first

    def ids_of_whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def pre_token(self, piece: str) -> bytes:
        """The ids of one pre-token; the letters and marks of ASCII stand for themselves."""
        spelled = piece if piece.isascii() and piece[0] != " " else "\u0120" + piece[1:] if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def of_letters(self, space: str, letters: str) -> bytes:
        return self.pre_token(space + (letters.lower() if self.lower else letters))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or text[0] == " " or text[-1] == " ":
            return self.ids_of_whole(text)
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))


def encode_column(texts, path: str) -> Iterator[bytes]:
    """The ids of each text of an Arrow column; null counts as empty."""
    of = held(("encoder", path), lambda: Encoder(path))
    for x in texts:
        yield of.encode(x.as_py() or "")

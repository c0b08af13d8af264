"""Token ids of a public tokenizer, a piece of text at a time.

Both vocabularies cut a text before they merge: no token reaches over a blank that stands between two other
characters. So a text is cut there, each distinct piece is encoded once per worker, and the ids of a text are the
joined ids of its pieces. ``tests/llm`` holds this against encoding the whole text in one call.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

SEPARATORS = "\x1c\x1d\x1e\x1f"  # blanks to Python's split, not to the tokenizer
INNER = re.compile(r"(?<=\S) (?=\S)")
MARKS = ".,!?;:*%$&#|"  # cut off a word's end; a run of them is one piece of its own


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free character from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Pieces(dict):
    """Ids (little-endian 32-bit) by piece, filled on first use and emptied when ``bound`` pieces are held.

    ``lead`` is what stands before every piece: a blank for byte-level pieces inside a line, where the blank
    belongs to the word after it.
    """

    def __init__(self, tokenizer, lead: str = "", bound: int = 600_000):
        super().__init__()
        self.tokenizer, self.model, self.lead, self.bound = tokenizer, tokenizer.model, lead, bound
        self.folds = tokenizer.normalizer is not None
        self.symbols = byte_symbols()
        self.head = self.symbols[ord(lead)] if lead else ""
        self.bare = Pieces(tokenizer) if lead else self

    def __missing__(self, piece: str) -> bytes:
        if self.lead and piece[:1] == "\n":  # the first word of a further line
            rest = piece[1:]
            ids = self._whole(piece) if not rest or rest[0].isspace() else self.bare["\n"] + self.bare[rest]
            return self.setdefault(piece, ids)
        core = piece.rstrip(MARKS)
        word = self._folded(core) if self.folds and not (core.isascii() and core.islower()) else core
        if not word.isalpha():
            ids = self._whole(self.lead + piece)
        elif len(core) < len(piece):
            ids = self[core] + self.bare[piece[len(core) :]]
        elif word != core:
            ids = self[word]
        else:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.symbols)
            ids = array("I", [t.id for t in self.model.tokenize(self.head + shown)]).tobytes()
        self[piece] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    @staticmethod
    def _folded(word: str) -> str:
        """The normalised word, or nothing where lower case depends on the neighbours."""
        return "" if "Σ" in word else unicodedata.normalize("NFC", word).lower()

    def joined(self, parts: list[str]) -> bytes:
        if len(self) > self.bound:
            self.clear()
        return b"".join(map(self.__getitem__, parts))


class Encoder:
    """Whole texts to ids with one vocabulary file; the worker keeps it between batches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self.tokenizer = tokenizer
        self.drops_blanks = tokenizer.normalizer is not None
        # a piece takes about 250 bytes; without blanks before words one dictionary holds them all
        self.first = Pieces(tokenizer, bound=200_000) if self.drops_blanks else Pieces(tokenizer)
        self.inner = self.first if self.drops_blanks else Pieces(tokenizer, " ")

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        if self.drops_blanks:
            careful = any(mark in text for mark in SEPARATORS)
            return self.first.joined(INNER.split(text) if careful else text.split())
        parts = text.replace("\n", " \n").split(" ")
        if "\n\n" in text or len(parts) != len(text.split()):  # blanks side by side, at an end, or other than these two
            parts = INNER.split(text)
        return self.first.joined(parts[:1]) + self.inner.joined(parts[1:])


_held: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder of a vocabulary file."""
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]

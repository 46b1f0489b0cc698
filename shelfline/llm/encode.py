"""Whole texts to token ids with a public tokenizer file, each distinct word encoded once.

Both files split a text at its blanks before any merge is looked up, so the ids
of a text are the ids of its words in a row. A worker keeps the words it has
met lately; a text for which the cut at blanks could differ is encoded whole.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from shelfline.llm.common import LEFT

#: Words a worker keeps at most, in two generations, where nothing else is said; about 50 MB.
CACHED_WORDS = 200_000

#: A word of Latin letters and the marks after it: two units for both files' patterns, which
#: can go straight to the merges. An apostrophe may open a unit of its own, so it is no such mark.
_SIMPLE = re.compile(r"([\n\0]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch

#: Byte-level files write bytes as characters: printable ones as themselves, the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: b for b in _PRINTABLE} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

_BLANK, _NEWLINE = " ".translate(_BYTE_CHARS), "\n".translate(_BYTE_CHARS)


def _chars(text: str) -> str:
    return text if text.isascii() else text.encode().decode("latin-1").translate(_BYTE_CHARS)


class _Words(dict):
    """Ids of words; a word that is not there is taken from ``older`` ones or learnt at once, else noted as ``unknown``."""

    def __init__(self, learn: Callable[[str], bytes | None], older: dict):
        super().__init__()
        self.learn, self.older = learn, older
        self.unknown: set[str] = set()

    def __missing__(self, word: str) -> bytes | int | None:
        found = self.older.get(word)
        if found is None:
            found = self.learn(word)
            if found is None:
                self.unknown.add(word)
                return None
        self[word] = found
        return found


class Encoder:
    """Ids as 2-byte little-endian numbers."""

    def __init__(self, path: str, cached_words: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        # A byte-level pattern takes the blank before a word as the word's own; the other one drops white space.
        self.glued = self.tokenizer.normalizer is None
        # Bytes of ids, or 0 for a word that must not be cut off.
        self.words, self.cached_words = _Words(self._simple, {}), cached_words
        self.units: dict[str, bytes] = {}
        # Many words go in one call, a special token between them.
        self.between, self.between_id = max(
            ((t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items()), key=lambda x: x[1]
        )

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _merged(self, unit: str) -> bytes:
        ids = [t.id for t in self.tokenizer.model.tokenize(unit)]
        return struct.pack(f"<{len(ids)}H", *ids)

    def _unit(self, marks: str) -> bytes:
        if marks not in self.units:
            if len(self.units) > 10_000:
                self.units.clear()
            self.units[marks] = self._merged(marks)
        return self.units[marks]

    def _simple(self, word: str) -> bytes | None:
        """Ids of a word of letters and marks; other words are learnt many at a time."""
        parts = _SIMPLE(word)
        if not parts or parts[1] and not self.glued:
            return None
        edge, letters, marks = parts.groups()
        if edge:
            found = (self._unit(_NEWLINE) if edge == "\n" else b"") + self._merged(_chars(letters))
        else:  # the bare word may be known, or be asked for later
            letters = letters if self.glued else letters.lower()
            found = (self.words.get(letters) or self.words.older.get(letters)) if letters != word else None
            if not found:
                found = self._merged((_BLANK if self.glued else "") + _chars(letters))
            self.words[letters] = found
        return found + self._unit(marks) if marks else found

    def _learn(self, words: list[str]) -> None:
        """Words that ``_simple`` does not take."""
        asked, plain = [], []
        for word in words:
            text = word
            if self.glued:
                bare = word[1:] if word[:1] in ("\n", "\0") else word
                if not bare or bare != bare.strip():  # white space at an edge joins a run across the cut
                    self.words[word] = 0
                    continue
                text = bare if word[:1] == "\0" else word if word[:1] == "\n" else f" {word}"
            if "<" in word:
                self.words[word] = self.whole(text)
            else:
                asked.append(word)
                plain.append(text)
        if not asked:
            return
        self.tokenizer.encode_special_tokens = False
        found = self.tokenizer.encode_batch_fast([self.between.join(plain)], add_special_tokens=False)[0].ids
        self.tokenizer.encode_special_tokens = True
        ids = np.array(found, "<u2")
        cuts = np.flatnonzero(ids == self.between_id)
        data = ids.tobytes()
        ends = [*(2 * cuts).tolist(), len(data)]
        start = 0
        for word, end in zip(asked, ends, strict=True):
            self.words[word] = data[start:end]
            start = end + 2

    def _pieces(self, text: str) -> list[str]:
        """Pieces that are encoded alone, each with a blank before it unless "\\n" or, for no text at all, "\\0" leads."""
        if not text:
            return []
        if self.glued:
            if "\0" in text:
                return ["\0"]  # has no safe edges: the text is encoded whole
            return f"\0{text}".replace("\n", " \n").split(" ")
        if "Σ" not in text and "İ" not in text:  # of these Python has lower forms of its own
            text = text.lower()
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for first in range(0, len(texts), 256):
            if 2 * len(self.words) > (self.cached_words or CACHED_WORDS):
                self.words.older = {}
                self.words = _Words(self._simple, self.words)
            get, unknown, waiting = self.words.__getitem__, self.words.unknown, []
            for text in texts[first : first + 256]:
                pieces = self._pieces(text)
                found = list(map(get, pieces))
                if unknown and None in found:
                    waiting.append((len(out), text, pieces, found))
                    out.append(b"")
                else:
                    out.append(self._joined(text, found))
            self._learn(list(unknown))
            unknown.clear()
            for place, text, pieces, found in waiting:
                for at in [i for i, ids in enumerate(found) if ids is None]:
                    found[at] = get(pieces[at])
                out[place] = self._joined(text, found)
        return out

    def _joined(self, text: str, found: list) -> bytes:
        try:
            return b"".join(found)
        except TypeError:  # a word without safe edges
            return self.whole(text)


@lru_cache(maxsize=1)
def encoder(path: str, cached_words: int | None = None) -> Encoder:
    return Encoder(path, cached_words)


#: Encoding tasks keep the encoder and its words from task to task.
ENCODING = "encoder"
LEFT[ENCODING] = encoder.cache_clear

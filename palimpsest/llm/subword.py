"""Ids of whole texts as the tokenizers library gives them, with each distinct chunk of text encoded once.

A text is cut where the library's pre-tokenizer surely cuts it too, so that the ids of a text are those of
its chunks one after another; a cache maps chunks to ids, and the library encodes the chunks it lacks.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import unicodedata

import numpy as np

from palimpsest.llm import common

#: Marks that end a word without being part of its pre-token.
MARKS = b".,;:!?"
ENDS = frozenset(MARKS[i : i + 1] for i in range(len(MARKS)))
#: What a text lacks whose white space is single spaces and line breaks between words.
ODD = ["\0", "  ", "\n\n", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]
#: A space that a word follows begins a pre-token, whatever comes before it.
BEFORE_WORD = re.compile(r"(?= \S)")


def _library(path: str, specials: bool = True):
    """The tokenizer of a file, as loaded; with specials=False the strings of its special tokens are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not specials
    return tokenizer


@functools.cache
def byte_letters() -> dict[int, str]:
    """The printable characters by which byte-level vocabularies write bytes: themselves, or 256 and up in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


class _Tokenizer:
    """Chunks through a cache. A word of letters alone is one pre-token, so the library's model takes it directly;
    marks after such a word are a pre-token of their own; all else takes the library's whole way. Which way a chunk
    takes depends on the chunk alone, never on what the cache holds.

    The library looks for special tokens in a text before all else, so texts are cut around them first.
    """

    def __init__(self, path: str, specials: bool = True, most: int = 700_000):
        self.library = _library(path, specials)
        self.model = self.library.model
        self.cache = common.PieceCache(self._encode, most)
        self.marks: dict[bytes, list[int]] = {}
        added = [t.content for t in self.library.get_added_tokens_decoder().values()] if specials else []
        self.added = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None

    def _whole(self, pieces: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

    def _letters(self, stem: bytes) -> str | None:
        """A word of letters as the model takes it; None if it isn't one."""
        raise NotImplementedError

    def _word(self, stem: bytes, letters: str) -> list[int]:
        return [t.id for t in self.model.tokenize(letters)]

    def _encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        slow: list[int] = []
        letters, word, known = self._letters, self._word, self.cache.known
        for k, piece in enumerate(pieces):
            if piece[-1:] in ENDS:
                stem = piece.rstrip(MARKS)
                if (spelled := letters(stem)) is None:
                    slow.append(k)
                    continue
                out[k] = [*(known(stem) or word(stem, spelled)), *self._marks(piece[len(stem) :])]
            elif (spelled := letters(piece)) is None:
                slow.append(k)
            else:
                out[k] = word(piece, spelled)
        for k, ids in zip(slow, self._whole([pieces[k] for k in slow])):
            out[k] = ids
        return out

    def _marks(self, marks: bytes) -> list[int]:
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[marks] = self._whole([marks])[0]
        return self.marks[marks]

    def _chunks(self, text: str) -> list[bytes]:
        """Of a text without special tokens."""
        raise NotImplementedError

    def chunks(self, text: str) -> list[bytes]:
        if self.added is None or not self.added.search(text):
            return self._chunks(text)
        return [c for i, part in enumerate(self.added.split(text)) for c in ([part.encode()] if i % 2 else self._chunks(part))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        chunks = [self.chunks(t) for t in texts]
        ids, lens = self.cache(list(itertools.chain.from_iterable(chunks)))
        return ids, common.sums(lens, np.fromiter(map(len, chunks), np.int64, len(chunks)))


class WordTokenizer(_Tokenizer):
    """For tokenizers that compose and lower-case text and drop white space: chunks are what ASCII white space separates."""

    def _letters(self, stem: bytes) -> str | None:
        if stem.isalpha():  # of ASCII letters
            return stem.decode().lower()
        text = stem.decode()
        # A sigma's lower case depends on its place.
        if stem.isascii() or not text.isalpha() or "\u03a3" in text or not unicodedata.is_normalized("NFC", text):
            return None
        text = text.lower()
        if not (text.isalpha() and unicodedata.is_normalized("NFC", text)):
            return None
        return text.encode().decode("latin-1").translate(byte_letters())

    def _chunks(self, text: str) -> list[bytes]:
        # Lower case first saves cache entries; beside other signs it could change what composes, and in
        # capitals the string of a special token is none.
        if text.isascii():
            low = text.lower()
            text = text if self.added is not None and self.added.search(low) else low
        return text.encode().split()


class ByteTokenizer(_Tokenizer):
    """For byte-level tokenizers: a space goes with the word after it, so texts are cut before single spaces and single line breaks."""

    def __init__(self, path: str, specials: bool = True, most: int = 700_000):
        super().__init__(path, specials, most)
        self.line = self._whole([b"\n"])[0]

    def _letters(self, stem: bytes) -> str | None:
        word, space = (stem[1:], "\u0120" if stem[:1] == b" " else "") if stem[:1] in (b" ", b"\n") else (stem, "")
        if word.isalpha():  # of ASCII letters
            return space + word.decode()
        if word.isascii() or not word.decode().isalpha():
            return None
        return space + word.decode("latin-1").translate(byte_letters())

    def _word(self, stem: bytes, letters: str) -> list[int]:
        ids = super()._word(stem, letters)
        return [*self.line, *ids] if stem[:1] == b"\n" else ids

    def _chunks(self, text: str) -> list[bytes]:
        if not text:
            return []
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ODD):
            return [c.encode() for c in BEFORE_WORD.split(text)]
        return text.encode().replace(b" ", b"\0 ").replace(b"\n", b"\0\n").split(b"\0")


@functools.lru_cache(maxsize=4)
def tokenizer(kind: str, path: str, specials: bool = True) -> WordTokenizer | ByteTokenizer:
    return {"word": WordTokenizer, "byte": ByteTokenizer}[kind](path, specials)


def with_end(ids: np.ndarray, each: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with `end` after those of each text."""
    return np.insert(ids, np.cumsum(each), end), each + 1

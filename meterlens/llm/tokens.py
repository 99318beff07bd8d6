"""Exact, cached encoding of texts with the public word tokenizer.

The tokenizer lower-cases, composes characters (NFC) and cuts at white space and
between letters, digits and other signs before it looks at words, so the ids of a
text are those of its pieces between ASCII white space in order, and a piece seen
before need not be encoded again. A piece of ASCII signs, digits and letters of
the Latin and Cyrillic blocks that have one composed and one lower-case form, without
apostrophe (which may take letters with it) and without a special token, is made of its
words, digits and signs, which are remembered too; all others are encoded as they stand.
Pieces over ``PIECE_BYTES`` are not remembered. A memory of half of ``CACHE_BYTES`` becomes
the old one, and what is asked for again moves from the old one to the new, so frequent
pieces stay and rare ones go.

Defined cases: a null or empty text has no ids; white space alone has none; any other
text has the ids that the tokenizers library gives for it, without special tokens.
"""

from __future__ import annotations

import os
import re

import numpy as np

PIECE_BYTES = 48
# Bytes of pieces, and of words in them, that a worker remembers.
CACHE_BYTES = 128 << 20
ENTRY = 190  # of two short byte strings and their place in a dictionary
LETTERS = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e\u0430-\u045f"
PARTS = re.compile(f"[{LETTERS}]+|[0-9]|[^0-9{LETTERS}]+")
ASCII_PARTS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
PLAIN = re.compile(f"[\x00-\x26\x28-\x7f\u00c0-\u00d6\u00d8-\u00de\u0410-\u042f\u0400-\u040f{LETTERS}]+")


def _byte_names() -> list[str]:
    """Signs that byte-level vocabularies write for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


_ENCODERS: dict[str, "Encoder"] = {}


class Encoder(dict):
    """Maps a piece of text without white space to the bytes of its ids."""

    def __init__(self, path: str):
        super().__init__()
        self.old: dict[bytes, bytes] = {}
        self.held = 0
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.size = size
        self.bytes_of = [np.array(k, self.dtype).tobytes() for k in range(size)]
        self.named = dict(enumerate(_byte_names()))
        self.tokenize = self.tokenizer.model.tokenize

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self._made(piece)
            if len(piece) > PIECE_BYTES:
                return ids
        self.held += ENTRY + len(piece) + len(ids)
        if self.held > CACHE_BYTES // 2:
            self.old, self.held = dict(self), 0
            self.clear()
        self[piece] = ids
        return ids

    def _made(self, piece: bytes) -> bytes:
        if piece.isalpha():  # ASCII letters alone
            lower = piece.lower()
            return self[lower] if lower != piece else self._word(piece.decode())
        if len(piece) > PIECE_BYTES or b"<|" in piece:
            return self._whole(piece)
        if piece.isascii():
            if b"'" in piece:
                return self._whole(piece)
            parts = ASCII_PARTS.findall(piece.lower())
        else:
            text = piece.decode()
            if not PLAIN.fullmatch(text):
                return self._whole(piece)
            parts = [part.encode() for part in PARTS.findall(text.lower())]
        if parts == [piece]:  # one word or some signs
            text = piece.decode()
            return self._word(text) if text[0].isalpha() else self._whole(piece)
        return b"".join([self[part] for part in parts])

    def _word(self, word: str) -> bytes:
        """Ids of letters alone, in lower case."""
        named = word if word.isascii() else word.encode().decode("latin-1").translate(self.named)
        bytes_of = self.bytes_of
        return b"".join([bytes_of[t.id] for t in self.tokenize(named)])

    def _whole(self, piece: bytes) -> bytes:
        encoded = self.tokenizer.encode(piece.decode(), add_special_tokens=False)
        return np.array(encoded.ids, self.dtype).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text (null: none), in ``dtype``."""
        pieces = text.encode().split() if text else []
        return np.frombuffer(b"".join(map(self.__getitem__, pieces)), self.dtype)


def encoder(path: str) -> Encoder:
    """The encoder of this process for the vocabulary file at ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

"""Token ids of whole texts with a public tokenizer file, with a bounded cache of word pieces in each Python worker."""

from __future__ import annotations

import re
from array import array

#: Entries that the cache of one worker holds at most, some 22 MB; words beyond are encoded without it.
CACHE = 1 << 17

#: Lower-case words, digits and punctuation on which normalisation has no effect.
_PLAIN = re.compile("[!-@\\[-~ß-öø-ÿ]*")
#: How the tokenizer splits such text.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Texts with one of these are lower-cased by the tokenizer alone, or have white space or markers it sees differently.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "Σ", "İ", "<|")

_encoders: dict[str, "Encoder"] = {}


def _visible_bytes() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """``ids(text)``: little-endian unsigned 32-bit ids of the whole text, without special tokens of the tokenizer's own.

    Normalisation never crosses white space and no token does, so a text's ids are those of its words in a row; a word's
    ids are remembered. The tests hold the ids against the library's own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.visible = _visible_bytes()
        self.chunks: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        if any(x in text for x in _ODD):
            return self._library(text)
        chunks = text.lower().split()
        parts = list(map(self.chunks.get, chunks))
        at = -1
        for _ in range(parts.count(None)):
            at = parts.index(None, at + 1)
            parts[at] = self._chunk(chunks[at])
        return b"".join(parts)

    def _library(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk):
            pieces = _PIECES.findall(chunk)
            found = b"".join([self.chunks.get(w) or self._word(w, len(pieces) > 1) for w in pieces])
        else:
            found = self._library(chunk)
        if len(self.chunks) < CACHE:
            self.chunks[chunk] = found
        return found

    def _word(self, word: str, keep: bool) -> bytes:
        shown = word if word.isascii() else "".join(map(self.visible.__getitem__, word.encode()))
        found = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if keep and len(self.chunks) < CACHE:
            self.chunks[word] = found
        return found


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

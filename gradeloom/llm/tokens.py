"""Token ids of whole texts by a tokenizers file, with the ids of recurring words remembered."""

from __future__ import annotations

import functools
import re
import string
import unicodedata

import numpy as np


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one above 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, above = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(above))
            above += 1
    return out


class Encoder:
    """ids(text): little-endian 32-bit ids of a whole text as bytes, equal to those of the library's encode().

    style says where a text may be cut without changing its ids:
    "space" - before each blank (byte-level pre-tokenizers that keep the blank with its word);
    "bare" - at white space, which is dropped (word vocabularies);
    "whole" - nowhere, each text is encoded in one go.
    A text that holds the string of an added token (in any case) is encoded in one go too, by the library's own rules.
    At most `most` pieces are remembered, so that memory stays bounded."""

    def __init__(self, path: str, style: str = "whole", most: int = 700_000):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        contents = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, contents)), re.IGNORECASE) if contents else None
        # A character without case that all of them hold tells most texts apart at once.
        self.mark = next((c for c in contents[0] if c.lower() == c.upper() and all(c in x for x in contents)), "") if contents else ""
        self.style, self.most = style, most
        self.first, self.later = _Pieces(self, ""), _Pieces(self, " " if style == "space" else "")
        self.letters = dict(enumerate(_byte_letters()))

    def plain(self, text: str) -> bytes:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def model(self, piece: str) -> bytes:
        """Ids of one pre-token, straight from the model."""
        coded = piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([x.id.to_bytes(4, "little") for x in self.t.model.tokenize(coded)])

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.added and self.mark in text and self.added.search(text):
            return self.plain(text)
        if self.style == "space" and "  " not in text:
            head, *rest = text.split(" ")
            return self.first[head] + b"".join(map(self.later.__getitem__, rest))
        if self.style == "bare" and not any(c in text for c in "\x1c\x1d\x1e\x1f\x85"):
            return b"".join(map(self.later.__getitem__, text.split()))
        return self.plain(text)


@functools.lru_cache(maxsize=2)
def encoder(path: str, style: str) -> Encoder:
    """A worker process keeps its encoder, and what it remembers, from task to task."""
    return Encoder(path, style)


class _Pieces(dict):
    def __init__(self, own: Encoder, before: str):
        super().__init__()
        self.own, self.before = own, before

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.own.most:
            self.clear()
        ids = self[piece] = self.found(piece)
        return ids

    def found(self, piece: str) -> bytes:
        own = self.own
        letters = piece.rstrip(string.punctuation)
        if letters.isalpha():
            if own.style == "bare":
                small = letters if letters.isascii() else unicodedata.normalize("NFC", letters)
                if small == letters and len(small.lower()) == len(small) and "Σ" not in small:
                    return own.model(small.lower()) + (own.model(piece[len(letters) :]) if len(letters) < len(piece) else b"")
            else:
                return own.model(self.before + letters) + (own.model(piece[len(letters) :]) if len(letters) < len(piece) else b"")
        if own.style == "space":
            head, cut, tail = piece.partition("\n")
            if cut and head and tail and not head[-1].isspace() and not tail[0].isspace():
                return self.found(head) + own.model("\n") + own.first[tail]
        return own.plain(self.before + piece)

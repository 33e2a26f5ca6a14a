"""Byte-level BPE ids of whole texts, with a bounded memo of words."""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import lru_cache

import regex
import tiktoken

from matrel.llm.common import Memo

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise RuntimeError("ids are stored as the machine's unsigned 32-bit little-endian integers")

#: Below it, the libraries in use agree on what a letter is.
LATIN_END = "\u0250"

_SPACES = re.compile(r" \s").search


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible in Latin-1, else from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in visible}
    hidden = [b for b in range(256) if b not in out]
    return out | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Chunks(Memo):
    """Ids of " chunk"; a word with one mark behind it is not kept, its word is."""

    def __missing__(self, chunk: str) -> bytes:
        if chunk[-1:] in self.marks and chunk[:-1].isalpha() and max(chunk) < LATIN_END:
            return self[chunk[:-1]] + self.marks[chunk[-1]]
        return super().__missing__(chunk)


class ByteLevelEncoder:
    """Ids as little-endian unsigned 32-bit bytes. One instance serves one task."""

    #: The word pattern that belongs to the vocabulary (fixed value).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        back = {c: b for b, c in byte_alphabet().items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.piece = tiktoken.Encoding("words", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.words = regex.compile(self.PATTERN).findall
        self.special = {s: array("I", [i]).tobytes() for s, i in special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split
        self.memo = _Chunks(self._chunk)
        self.memo.marks = {c: self._slow(c) for c in ".,;:!?|"}

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha() and max(chunk) < LATIN_END:      # one word of letters
            return array("I", self.piece((" " + chunk).encode())).tobytes()
        return self._slow(" " + chunk)

    def _slow(self, text: str) -> bytes:
        out = array("I")
        for word in self.words(text):
            out.extend(self.piece(word.encode()))
        return out.tobytes()

    def _plain(self, text: str) -> bytes:
        if _SPACES(text):
            return self._slow(text)
        # every space stands before a visible character (or ends the text), where the pattern
        # always begins a word: the chunks between spaces can be encoded one by one
        first, *rest = text.split(" ")
        return self._slow(first) + b"".join(map(self.memo.__getitem__, rest))

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            out = b"".join(self.special.get(part) or self._plain(part) for part in self.cut(text))
        else:
            out = self._plain(text)
        self.memo.trim()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteLevelEncoder:
    """The encoder of a file, kept with its memo for the later tasks of the same worker."""
    return ByteLevelEncoder(path)

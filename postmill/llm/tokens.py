"""Byte-level BPE ids of whole texts, by the public 50k vocabulary.

Ids equal those of the `tokenizers` file of the same vocabulary without special tokens
(strings that look like special tokens are ordinary text). Words that follow a single
blank are encoded once per worker and kept, up to KEPT words, because the vocabulary's
split pattern always breaks before such a blank.
"""

from __future__ import annotations

import base64
import functools
import re
import struct

import public_tokenizers
import tiktoken

KEPT = 300_000
STRETCH = 1 << 20
#: Blank runs and rare white space: these texts are encoded without the word memory.
ODD = re.compile("  | $|[\x1c-\x1f\x85\xa0  -     　]")
CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")


class _Words(dict):
    """Blank + word -> its ids as little-endian bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        out = self.encode(" " + word)
        if len(self) < KEPT:
            self[word] = out
        return out


class Encoder:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = _Words(self.plain)

    def plain(self, text: str) -> bytes:
        ids = self.bpe.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str | None) -> bytes:
        """The ids of a whole text, four bytes each; null counts as empty. Long texts go stretch by stretch."""
        out, at = [], 0
        text = text or ""
        while len(text) - at > STRETCH and (cut := CUT.search(text, at + STRETCH)):
            out.append(self._stretch(text[at : cut.start()]))
            at = cut.start()
        out.append(self._stretch(text[at:] if at else text))
        return b"".join(out)

    def _stretch(self, text: str) -> bytes:
        if ODD.search(text):
            return self.plain(text)
        first, blank, rest = text.partition(" ")
        head = self.plain(first) if first else b""
        return head + b"".join(map(self.words.__getitem__, rest.split(" "))) if blank else head


@functools.cache
def encoder(path: str | None = None) -> Encoder:
    """One per worker. path: a rank file; by default the public 50k vocabulary."""
    return Encoder(path or str(public_tokenizers.path("byte_bpe_50k.tiktoken")))

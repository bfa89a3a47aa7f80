"""Words of whole texts as 64-bit hashes, computed for a batch of texts at once.

A word is a run of characters other than blank and \\x09-\\x0D. Texts come as an Arrow
string column; null texts have no words. The work arrays are bounded by SEGMENT bytes
of text, however long a single text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
GRAM_BASE = np.uint64(0xD1342543DE82EF95)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTES = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
BYTES[SPACE] = 0
FOLDED = BYTES.copy()
FOLDED[65:91] = BYTES[97:123]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS = powers(BASE, 4096)


def _hash_segment(data: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashes of the words that begin at starts; what lies between them is blank or theirs."""
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    longest = int(place.max()) + 1
    table = POWERS if longest <= len(POWERS) else powers(BASE, longest)
    return np.add.reduceat(values[data] * table[place], starts)


def word_hashes(texts: pa.Array, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in order, first word of each text and the end).

    fold_case: A-Z count as a-z.
    """
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    blank = SPACE[data]
    before = np.ones(len(data), bool)
    before[1:] = blank[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(~blank & before)
    out = np.zeros(len(starts), np.uint64)
    values = FOLDED if fold_case else BYTES
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + SEGMENT)))
        end = starts[to] if to < len(starts) else len(data)
        out[at:to] = _hash_segment(data[starts[at] : end], starts[at:to] - starts[at], values)
        at = to
    return mix(out), np.searchsorted(starts, offsets)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by doubling; shorter input gives none. Not yet mixed."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    doubled, width = {1: h}, 1
    while 2 * width <= k:
        g = doubled[width]
        doubled[2 * width] = g[: len(g) - width] * powers(GRAM_BASE, width + 1)[width] + g[width:]
        width *= 2
    out, have = doubled[width][: len(h) - k + 1], width
    while have < k:
        width = max(w for w in doubled if w <= k - have)
        out = out * powers(GRAM_BASE, width + 1)[width] + doubled[width][have : have + len(h) - k + 1]
        have += width
    return out


def documents(batch: pa.RecordBatch, text: str, fold_case: bool = False) -> Iterator[np.ndarray]:
    """The word hashes of each row of a batch, a few MB of text at a time."""
    column = batch.column(text)
    sizes = np.cumsum(np.asarray(pc.binary_length(column.cast(pa.large_string())).fill_null(0), dtype=np.int64))
    at = 0
    while at < len(column):
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + 2 * SEGMENT, side="right")))
        h, first = word_hashes(column.slice(at, to - at), fold_case)
        for i in range(to - at):
            yield h[first[i] : first[i + 1]]
        at = to

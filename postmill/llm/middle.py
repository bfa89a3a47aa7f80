"""Fill-in-the-middle texts over seekable compressed frames.

A text is stored as independent zstandard frames of about FRAME bytes with an index: the
cumulative numbers of compressed bytes, bytes, units (lines) and code points up to the end of
each frame. A cut after k units is found in the index; only the frame that holds it is
decompressed. Whole texts are never rebuilt: outputs are written, and digests of outputs and
of restored texts taken, by streaming frames in order. Everything is narrow (one pass over
the documents, no shuffle) and holds one frame of a text besides its compressed form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = 1 << 15
LEVEL = 1
SEED = 7
RATE = 100
SPM = 50
PREFIX, SUFFIX, MIDDLE = MARKERS = (b"<P>", b"<S>", b"<M>")

#: How frames lie in a column.
FRAMES = "struct<data:binary,ends:array<long>,bytes:array<long>,units:array<long>,chars:array<long>>"
FRAMES_ARROW = pa.struct([("data", pa.binary()), *((n, pa.list_(pa.int64())) for n in ("ends", "bytes", "units", "chars"))])


def code_points(data: bytes) -> int:
    """Code points of UTF-8 bytes: those bytes that continue none."""
    return len(data) if data.isascii() else int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def whole_characters(data: memoryview, at: int) -> int:
    """The last place up to `at` where a character begins."""
    while at and at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


@dataclass
class Frames:
    """Independent zstandard frames of one text; counts run up to the end of each frame."""

    data: bytes
    ends: list[int]
    bytes: list[int]
    units: list[int]
    chars: list[int]

    @classmethod
    def of(cls, parts: Iterable[bytes | memoryview], size: int = FRAME) -> "Frames":
        """The concatenation of parts as frames of `size` bytes, cut between characters."""
        press, held, out = zstandard.ZstdCompressor(level=LEVEL), bytearray(), cls(b"", [], [], [], [])
        data = bytearray()

        def close(n: int) -> None:
            piece = bytes(held[:n])
            del held[:n]
            data.extend(press.compress(piece))
            for sums, more in ((out.bytes, n), (out.units, piece.count(b"\n")), (out.chars, code_points(piece))):
                sums.append((sums[-1] if sums else 0) + more)
            out.ends.append(len(data))

        last = b""
        for part in parts:
            view = memoryview(part)
            for at in range(0, len(view), size):
                held += view[at : at + size]
                while len(held) >= 2 * size:
                    close(whole_characters(memoryview(held), size))
            last = bytes(view[-1:]) or last
        while held:
            close(whole_characters(memoryview(held), size) if len(held) > size else len(held))
        if out.ends and last != b"\n":
            out.units[-1] += 1
        out.data = bytes(data)
        return out

    def frame(self, i: int) -> bytes:
        start = self.ends[i - 1] if i else 0
        return zstandard.ZstdDecompressor().decompress(self.data[start : self.ends[i]])

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) of the first k units; one frame is decompressed at most."""
        if not k:
            return 0, 0
        if k >= self.units[-1]:
            return self.bytes[-1], self.chars[-1]
        i = int(np.searchsorted(self.units, k))
        before = (self.bytes[i - 1], self.units[i - 1], self.chars[i - 1]) if i else (0, 0, 0)
        piece = self.frame(i)
        end = int(np.flatnonzero(np.frombuffer(piece, np.uint8) == 10)[k - before[1] - 1]) + 1
        return before[0] + end, before[2] + code_points(piece[:end])

    def stream(self, start: int = 0, end: int | None = None) -> Iterator[bytes]:
        """The bytes from start to end, in order, a frame at a time."""
        end = (self.bytes[-1] if self.bytes else 0) if end is None else end
        i = int(np.searchsorted(self.bytes, start, side="right"))
        while start < end:
            base = self.bytes[i - 1] if i else 0
            yield self.frame(i)[start - base : end - base]
            start, i = self.bytes[i], i + 1

    def find(self, marker: bytes) -> int:
        """Where the bytes of a marker first begin."""
        at, tail = 0, b""
        for piece in self.stream():
            found = (tail + piece).find(marker)
            if found >= 0:
                return at - len(tail) + found
            at += len(piece)
            tail = (tail + piece)[1 - len(marker) :]
        raise ValueError(f"no {marker!r}")


def digest(parts: Iterable[bytes]) -> str:
    sha = hashlib.sha256()
    for part in parts:
        sha.update(part)
    return sha.hexdigest()


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The original text, from output and form alone.

    The text holds no marker and parts meet markers only, so each marker is found once.
    """
    if form == "plain":
        yield from output.stream()
        return
    p, s, m = (output.find(x) for x in MARKERS)
    yield from output.stream(p + 3, s if form == "psm" else m)
    yield from output.stream(m + 3)
    yield from output.stream(s + 3, m if form == "psm" else p)


def column_of(frames: list[Frames]) -> pa.Array:
    def lists(name):
        values = [getattr(f, name) for f in frames]
        return pa.array(values, pa.list_(pa.int64()))

    return pa.StructArray.from_arrays([pa.array([f.data for f in frames], pa.binary()), *map(lists, ("ends", "bytes", "units", "chars"))], fields=list(FRAMES_ARROW))


def groups(batch: pa.RecordBatch, size: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def frame_documents(docs: DataFrame, size: int = FRAME) -> DataFrame:
    """doc_id, marked, framed: every whole text as seekable frames; null texts are empty.

    marked: the text holds a marker and can't be rearranged. Empty texts have no frames.
    Repeated rows and rows without an id stay rows of their own; other columns are not read;
    an empty table gives no rows.
    """

    def store(batches):
        for whole in batches:
            for batch in groups(whole):
                texts = [t.as_buffer() or b"" if t.is_valid else b"" for t in batch.column("text")]
                found = [any(m in t for m in MARKERS) for t in map(bytes, texts)]
                yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.bool_()), column_of([Frames.of([t], size) for t in texts])], ["doc_id", "marked", "framed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(store, f"doc_id long, marked boolean, framed {FRAMES}")


def fill_in_middle(framed: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (frames) of every stored text.

    The four hash numbers of a document come from its id alone (`seed:doc_id`; without an id,
    `seed:`), so its cuts and form are the same in every run. Texts that are empty or hold a
    marker, and all but `rate` of a hundred others, stay plain; of the rest `spm` of a hundred
    have the suffix first.
    """

    def move(batches):
        for whole in batches:
            for batch in groups(whole):
                rows = []
                for doc, marked, stored in zip(batch.column("doc_id").to_pylist(), batch.column("marked").to_pylist(), batch.column("framed").to_pylist()):
                    text = Frames(**stored)
                    n = text.units[-1] if text.units else 0
                    key = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
                    h = [int(key[i : i + 8], 16) for i in range(0, 32, 8)]
                    if not n or marked or h[2] % 100 >= rate:
                        rows.append((n, "plain", None, None, text))
                        continue
                    (low, low_chars), (high, high_chars) = map(text.cut, sorted((h[0] % (n + 1), h[1] % (n + 1))))
                    prefix, middle, suffix = ((text, 0, low), (text, low, high), (text, high, text.bytes[-1]))
                    form = "spm" if h[3] % 100 < spm else "psm"
                    order = ((SUFFIX, suffix), (PREFIX, prefix)) if form == "spm" else ((PREFIX, prefix), (SUFFIX, suffix))
                    parts = (x for marker, span in (*order, (MIDDLE, middle)) for x in (marker, *Frames.stream(*span)))
                    rows.append((n, form, low_chars, high_chars - low_chars, Frames.of(parts)))
                n, form, before, between, output = zip(*rows)
                yield pa.record_batch(
                    [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(between, pa.int64()), column_of(output)],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return framed.mapInArrow(move, f"doc_id long, n long, form string, prefix_chars long, middle_chars long, output {FRAMES}")


def digests(moved: DataFrame) -> DataFrame:
    """The columns of fill_in_middle with the sha256 of output and restored text in place of the frames."""
    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]

    def sign(batches):
        for whole in batches:
            for batch in groups(whole):
                outputs = [Frames(**x) for x in batch.column("output").to_pylist()]
                after = [digest(f.stream()) for f in outputs]
                before = [digest(restored(f, form)) for f, form in zip(outputs, batch.column("form").to_pylist())]
                yield pa.record_batch([*map(batch.column, kept), pa.array(after, pa.string()), pa.array(before, pa.string())], [*kept, "output_sha256", "restored_sha256"])

    return moved.mapInArrow(sign, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fill-in-the-middle form, with digests of its output and of the text rebuilt from it."""
    return digests(fill_in_middle(frame_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


FILL_IN_MIDDLE_SQL = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
        sha256('7:' || CAST(doc_id AS VARCHAR)) AS h
    FROM documents),
numbered AS (
    SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4
    FROM cut),
placed AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
            WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM numbered),
parts AS (
    SELECT *, array_to_string(units[1:lo], '') AS p, array_to_string(units[lo + 1:hi], '') AS m, array_to_string(units[hi + 1:], '') AS s
    FROM placed)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""

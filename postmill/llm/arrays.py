"""Number arrays inside tasks: compact bytes for a shuffle, and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def squeeze(a: np.ndarray, delta: bool = False) -> bytes:
    """Bytes of an array, plane by plane, compressed."""
    if delta:
        a = np.diff(a, prepend=a.dtype.type(0))
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T)
    return len(a).to_bytes(8, "little") + bytes(pa.compress(planes.tobytes(), codec="zstd", asbytes=True))


def squeezed_length(raw: bytes) -> int:
    return int.from_bytes(raw[:8], "little")


def unsqueeze(raw: bytes, kind, delta: bool = False) -> np.ndarray:
    n, width = squeezed_length(raw), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw[8:], n * width, codec="zstd", asbytes=True), np.uint8)
    a = np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()
    return np.cumsum(a, dtype=kind) if delta else a


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is connected with by the edges (a, b)."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (jumped := label[label]).tobytes() != label.tobytes():
            label = jumped

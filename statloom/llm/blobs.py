"""Many integers as few bytes: sorted 64-bit integers as compressed byte planes of their differences."""

from __future__ import annotations

import numpy as np
import zstandard

_WORK: list = []


def _zstd() -> tuple:
    if not _WORK:
        _WORK.extend((zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()))
    return _WORK[0], _WORK[1]


def planes(a: np.ndarray) -> bytes:
    width = a.dtype.itemsize
    return _zstd()[0].compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, width).T.tobytes())


def unplanes(b: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(_zstd()[1].decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def squeeze(a: np.ndarray) -> bytes:
    """Bytes of a sorted array of unsigned 64-bit integers."""
    return planes(np.diff(a, prepend=np.zeros(1, np.uint64)))


def unsqueeze(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, np.uint64), dtype=np.uint64)

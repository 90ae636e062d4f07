"""Many numbers in one cell: what a task sends to a shuffle as a few rows."""

from __future__ import annotations

import numpy as np
import zstandard

_pack = zstandard.ZstdCompressor(level=1)
_open = zstandard.ZstdDecompressor()


def pack(x: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, from the lowest up to the highest in use, compressed."""
    x = np.ascontiguousarray(x, dtype=np.uint64)
    planes = 0
    if len(x):
        planes = (int(x.max()).bit_length() + 7) // 8
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :planes].T)
    return bytes([planes]) + len(x).to_bytes(8, "little") + _pack.compress(raw.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes, n = blob[0], int.from_bytes(blob[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    if planes and n:
        out[:, :planes] = np.frombuffer(_open.decompress(blob[9:], max_output_size=planes * n), np.uint8).reshape(planes, n).T
    return out.reshape(-1).view(np.uint64)


def pack_rising(x: np.ndarray) -> bytes:
    """pack() of ascending numbers, by their differences."""
    x = np.asarray(x, dtype=np.uint64)
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_rising(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)

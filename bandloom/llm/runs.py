"""Sorted runs of numpy columns as compact binary values.

A run keeps its first column sorted and stores it as differences; each column is laid
out by byte planes, so that the zero bytes of small numbers compress away.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def pack(columns: list[np.ndarray], level: int = 1) -> bytes:
    n = len(columns[0])
    parts = [struct.pack("<BQ", len(columns), n)]
    for k, c in enumerate(columns):
        if k == 0 and n:
            c = np.diff(c, prepend=c.dtype.type(0))
        c = np.ascontiguousarray(c)
        parts += [c.dtype.str.encode().ljust(4), c.view(np.uint8).reshape(n, c.dtype.itemsize).T.tobytes() if n else b""]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    count, n = struct.unpack_from("<BQ", data)
    at, out = 9, []
    for k in range(count):
        dtype = np.dtype(data[at : at + 4].strip().decode())
        at += 4
        size = n * dtype.itemsize
        planes = np.frombuffer(data, np.uint8, size, at).reshape(dtype.itemsize, n) if n else np.zeros((dtype.itemsize, 0), np.uint8)
        c = np.ascontiguousarray(planes.T).view(dtype).reshape(n)
        out.append(np.cumsum(c, dtype=dtype) if k == 0 else c)
        at += size
    return out

"""Number arrays as one compressed value, for exchanges between tasks."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", compression_level=1)


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays' bytes, equal places of all elements side by side, compressed."""
    heads, bodies = [struct.pack("<i", len(arrays))], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        bodies.append(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.size else b"")
        heads.append(struct.pack("<4si", a.dtype.str.encode(), a.size))
    raw = b"".join(bodies)
    return b"".join(heads) + struct.pack("<q", len(raw)) + (_CODEC.compress(raw, asbytes=True) if raw else b"")


def unpack(value: bytes) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<i", value)
    heads = [struct.unpack_from("<4si", value, 4 + 8 * k) for k in range(n)]
    at = 4 + 8 * n
    (size,) = struct.unpack_from("<q", value, at)
    raw = np.frombuffer(_CODEC.decompress(value[at + 8 :], size, asbytes=True) if size else b"", np.uint8)
    out, at = [], 0
    for code, length in heads:
        dtype = np.dtype(code.rstrip(b"\x00").decode())
        part = raw[at : at + length * dtype.itemsize]
        out.append(np.ascontiguousarray(part.reshape(dtype.itemsize, length).T).view(dtype).reshape(-1))
        at += length * dtype.itemsize
    return out

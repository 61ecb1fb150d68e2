"""Packed arrays: many rows of one partition as one compressed binary value.

A shuffle of packed rows moves a few large values instead of millions of small ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard


def pack(*fields: tuple[str, np.ndarray]) -> bytes:
    """Arrays as (kind, values): kind is a numpy type, or 'p' and a number for that many low bytes of each value, by byte planes."""
    out = [np.array([len(v) for _, v in fields], "<i8").tobytes()]
    for kind, v in fields:
        if kind[0] == "p":
            out.append(np.ascontiguousarray(v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : int(kind[1])].T).tobytes())
        else:
            out.append(np.ascontiguousarray(v.astype(kind)).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    """What pack() was given, by the same kinds."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, "<i8", len(kinds)).tolist()
    at, out = 8 * len(kinds), []
    for kind, n in zip(kinds, sizes, strict=True):
        if kind[0] == "p":
            width = int(kind[1])
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
            out.append(wide.view("<u8").ravel())
        else:
            width = np.dtype(kind).itemsize
            out.append(np.frombuffer(raw, kind, n, at))
        at += n * width
    return out


def by_part(to: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """Each of the parts (their number, at most) that occurs in to (sorted), with its slice; only those that occur are looked at."""
    cuts = np.flatnonzero(np.diff(to)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(to)], strict=True) if len(to) else ():
        assert 0 <= to[a] < parts
        yield int(to[a]), slice(a, b)


ROWS = "part int, kind int, blob binary"
SCHEMA = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], SCHEMA.field(k).type) for k in range(3)], schema=SCHEMA)

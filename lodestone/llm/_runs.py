"""Runs of 64-bit keys as tasks send them to each other: a row for each range of keys, with its columns packed, in place of a row a key.

Keys that a task has gathered and sorted differ little from one to the next, so their differences take some six bytes, and a
row's own overhead is paid once a run. Which range a key is in depends on its high bits; hashes are even there, frequent ones too,
as a run has a key once or, for look-ups, as often as its texts ask for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Keys that a range may hold on average.
PART = 1 << 20


def part_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The range, of ``n``, of each key: it ascends with the key read as unsigned."""
    return ((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def spans(parts: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each number in an ascending array, and where it stands."""
    at = np.flatnonzero(np.diff(parts, prepend=-1))
    for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(parts)], strict=True):
        yield int(parts[lo]), slice(lo, hi)


def gaps(x: np.ndarray) -> np.ndarray:
    """Differences modulo 2**64, small where ``x`` ascends."""
    x = x.view(np.uint64)
    out = x.copy()
    out[1:] -= x[:-1]
    return out


def from_gaps(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.uint64).view(np.int64)


def pack(*columns: np.ndarray) -> bytes:
    """The columns' bytes, all first ones, all second ones and so on, so that those which are mostly zero go in compression."""
    body = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T).tobytes() for c in columns)
    return np.array([len(body), *map(len, columns)], "<i8").tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    n = len(kinds) + 1
    size, *lengths = np.frombuffer(data, "<i8", n).tolist()
    body = np.frombuffer(pa.decompress(memoryview(data)[8 * n :], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for kind, length in zip(map(np.dtype, kinds), lengths, strict=True):
        end = at + kind.itemsize * length
        out.append(np.ascontiguousarray(body[at:end].reshape(kind.itemsize, length).T).view(kind).reshape(length))
        at = end
    return out

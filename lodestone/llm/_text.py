"""Array arithmetic over the bytes of whole Arrow batches of texts: words, their hashes and shingles.

A batch is cut into slices of some MB, whole texts only, so that memory stays bounded. Word hashes are
differences of one running polynomial sum modulo 2**64, so their cost is a few passes over the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_power: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

#: Powers that a worker keeps: enough for a slice of ``SLICE`` bytes.
SLICE = 1 << 20
KEEP = SLICE + 1

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_power[0]) >= n:
        return _power[0][:n], _power[1][:n]
    made = []
    for base in (_P, _P_INV):
        x = np.full(max(n, KEEP), base, U64)
        x[0] = 1
        made.append(np.cumprod(x))
    if len(made[0]) <= KEEP:  # those of one long text are made anew
        _power[:] = made
    return made[0][:n], made[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each bit depends on all others."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Slice:
    """Texts lo..hi of a batch: their bytes, one after another, and where each starts."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets
        self.n = hi - lo

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def lower(self) -> Slice:
        """A-Z as a-z, other characters as they are."""
        return Slice(self.lo, self.hi, LOWER[self.data], self.offsets)

    def sums(self) -> np.ndarray:
        p, _ = powers(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * p[: len(self.data)], out=out[1:])
        return out

    def starts_here(self) -> np.ndarray:
        """For each byte, and one beyond: whether a text starts there."""
        out = np.zeros(len(self.data) + 1, bool)
        out[self.offsets] = True
        return out

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes marked ``inside`` that don't cross texts."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = self.starts_here()
        before = np.concatenate(([False], inside[:-1]))
        after = np.concatenate((inside[1:], [False]))
        starts = np.flatnonzero(inside & (~before | new[:-1]))
        ends = np.flatnonzero(inside & (~after | new[1:])) + 1
        return starts, ends

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(~WHITE[self.data])

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The text that holds each byte position."""
        return np.searchsorted(self.offsets, at, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
        sums = self.sums() if sums is None else sums
        _, inverse = powers(len(self.data) + 1)
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[Slice]:
    """Slices of at most ``most`` bytes, or of one longer text. Null texts count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    n = len(texts)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and n else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield Slice(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def shingles(part: Slice, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text, lower-cased: (text, hash), with the number of words of each text.

    A text of fewer than ``width`` words has one shingle, its whole sequence; a text without words has none.
    """
    part = part.lower()
    starts, ends = part.words()
    h, doc = part.hashes(starts, ends), part.owner(starts)
    words = np.bincount(doc, minlength=part.n)
    k = mix(np.arange(1, width + 1, dtype=U64) * U64(0xA0761D6478BD642F))
    total = np.zeros(max(len(h) - width + 1, 0), U64)
    for t in range(width):
        total += h[t : t + len(total)] * k[t]
    whole = doc[: len(total)] == doc[width - 1 :] if len(total) else np.zeros(0, bool)
    out_doc, out = doc[: len(total)][whole], mix(total[whole])
    if len(short := np.flatnonzero((words > 0) & (words < width))):
        first = np.searchsorted(doc, short)
        total = np.zeros(len(short), U64)
        for t in range(width - 1):
            has = words[short] > t
            total[has] += h[first[has] + t] * k[t]
        out_doc = np.concatenate((out_doc, short))
        out = np.concatenate((out, mix(total ^ (words[short].astype(U64) * U64(0xC2B2AE3D27D4EB4F)))))
    return out_doc, out, words


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0]..+lengths[0], starts[1]..+lengths[1], ... in one array."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    at = np.cumsum(lengths)
    return np.arange(at[-1]) + np.repeat(starts - (at - lengths), lengths)

"""PartEnum signatures of sets of 64-bit feature hashes, for joins with Jaccard similarity of at least num/den.

Sets of sizes a and b that link differ in at most k = (a+b)(den-num)/(den+num) features. Bands of sizes double, and each has
its own cut of the feature domain, the range of the hash: into first-level parts, and each of these into ``SUBPARTS``. A
signature is the content of ``SUBPARTS - TOUCHED`` subparts of one part; a set enumerates all such subsets. A set gives
those of its band, and those of the band below if a partner can be there.

Two sets agree on a part if they have a signature there in common. If they don't, but one of them isn't empty there, each
subpart in which they are equal is empty, or more than ``TOUCHED`` differ. Either way at least as many features differ there
as a set's weight, its number of filled subparts and ``TOUCHED + 1`` at most. So linked sets agree on one of the first parts
up to where a set's weights come to more than k, and it enumerates only those. Empty contents are never signatures.

A set whose features crowd in so few parts that its weights don't exceed k is short: it has no signatures, and the join
must find its partners otherwise. The number of parts makes short sets rare.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

from ._text import U64, mix, ragged

SUBPARTS, TOUCHED = 3, 1


def unique_sets(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each of n documents, ascending and distinct: (features, where each document starts, sizes)."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        doc, h = doc[new], h[new]
    size = np.bincount(doc, minlength=n).astype(np.int64)
    return h, np.cumsum(size) - size, size


def fingerprints(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set, from the sum of its features' mixed hashes and its size."""
    total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(h ^ U64(0x5851F42D4C957F2D)), dtype=U64)))
    return mix(total[start + size] - total[start] + size.astype(U64) * U64(0x9FB21C651E98DF25)).view(np.int64)


def part_bits(band: int) -> int:
    """Parts of a band, as a power of two: half as many as its smallest set has features, more for small sets."""
    return max(band - 1, 4 if band >= 4 else 6)


def _band(h: np.ndarray, start: np.ndarray, size: np.ndarray, band: int, bits: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets in a band, (set, signature), and which sets are short for their bounds."""
    own = np.repeat(np.arange(len(size)), size)
    x = h[ragged(start, size)]
    part = (x >> U64(63 - bits) >> U64(1)).astype(np.int64)
    sub = (((x << U64(bits)) >> U64(48)) * U64(SUBPARTS) >> U64(16)).astype(np.int64)
    cell = ((own << bits) + part) * SUBPARTS + sub  # ascending, as features are
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    content = np.add.reduceat(mix(x ^ U64(0x2545F4914F6CDD1D)), first)
    cell = cell[first]
    at = np.flatnonzero(np.diff(cell // SUBPARTS, prepend=-1))  # where parts begin
    filled = np.diff(np.append(at, len(cell)))
    table = np.zeros((len(at), SUBPARTS), U64)
    table[np.repeat(np.arange(len(at)), filled), cell % SUBPARTS] = content
    owner, weight = own[first][at], np.minimum(filled, TOUCHED + 1)
    total = np.bincount(owner, weights=weight, minlength=len(size)).astype(np.int64)
    before = np.cumsum(weight) - weight - np.repeat(np.cumsum(total) - total, np.bincount(owner, minlength=len(size)))
    short = total <= bound
    keep = (before <= bound[owner]) & ~short[owner]
    owner, table = owner[keep], table[keep]
    subsets = [list(s) for s in combinations(range(SUBPARTS), SUBPARTS - TOUCHED)]
    sig = np.stack([table[:, s].sum(1, dtype=U64) for s in subsets], 1)
    new = sig != 0
    for i in range(1, len(subsets)):  # subsets that differ in empty subparts alone have one content
        new[:, i] &= (sig[:, i, None] != sig[:, :i]).all(1)
    return np.repeat(owner, new.sum(1)), mix(sig[new] ^ U64((band + 1) * 0xD1B54A32D192ED03 % (1 << 64))), short


def signatures(h: np.ndarray, start: np.ndarray, size: np.ndarray, num: int = 75, den: int = 100, coarse: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, signature) of all sets, and which sets are short; empty sets have none and aren't short.

    ``coarse`` halves the number of parts so many times.
    """
    sets, sigs, short = [np.zeros(0, np.int64)], [np.zeros(0, U64)], np.zeros(len(size), bool)
    of = np.frexp(size)[1] - 1  # the band 2**t <= size < 2**(t+1)
    gap, both = den - num, den + num
    for band in np.unique(of[size > 0]).tolist():
        own = np.flatnonzero((of == band) & (size > 0))
        for level in range(band, max(band - 2, -1), -1):
            most = (2 << level) - 1  # the largest partner in the level
            which = own if level == band else own[size[own] * num <= most * den]
            if not len(which):
                continue
            a = size[which]
            # partners of another band meet the set in the lower of the two
            bound = (a + (a * den // num if level == band else most)) * gap // both
            k, sig, few = _band(h, start[which], a, level, max(part_bits(level) - coarse, 0), bound)
            short[which] |= few
            sets.append(which[k])
            sigs.append(sig)
    own, sig = np.concatenate(sets), np.concatenate(sigs)
    keep = ~short[own]
    return own[keep], sig[keep], short

"""Texts in Arrow batches: what stays within a document is computed there by array arithmetic, without a shuffle."""

from __future__ import annotations

import ctypes
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of the patterns in ``functions.text``, whatever the library; Arrow's ASCII white space is the same six.
_END = re.compile(r"([.!?])[ \t\n\x0b\f\r]+")
_STRIP = " \t\n\x0b\f\r"
#: Bytes of a slice of a batch, about.
SLICE = 4 << 20


def parts(batch: pa.RecordBatch, rows: int = 1024, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of few rows, and of ``most`` bytes or so by the mean of its rows, so that what they expand to stays bounded by the texts in them."""
    rows = max(1, min(rows, most * batch.num_rows // max(batch.nbytes, 1)))
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def tidy() -> None:
    """Gives the memory that a worker no longer uses back to the system: workers stay, and others start beside them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def split_sentences(text: str) -> list[str]:
    """As ``functions.text.sentences``."""
    return [s for s in (x.strip(_STRIP) for x in _END.sub("\\1\x01", text).split("\x01")) if s]


class Tokens:
    """Words of texts: the text of each, a code, and the distinct words by code."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        words = lists.flatten()
        owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
        full = pc.not_equal(words, "")
        codes = words.filter(full).dictionary_encode()
        self.n = len(texts)
        self.owner, self.code = owner[full.to_numpy(zero_copy_only=False)], codes.indices.to_numpy().astype(np.int64)
        self.words = codes.dictionary

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, code and times of each distinct word of each text."""
        key, times = np.unique(self.owner * max(len(self.words), 1) + self.code, return_counts=True)
        return key // max(len(self.words), 1), key % max(len(self.words), 1), times

    def vectors(self, dims: int) -> np.ndarray:
        """Hashed embeddings of the texts, as rows of integers; see ``functions.vectors.hash_cells``."""
        md5 = hashlib.md5
        digests = b"".join([md5(w, usedforsecurity=False).digest() for w in self.words.cast(pa.large_binary()).to_pylist()])
        bucket = np.frombuffer(digests, ">u4")[::4].astype(np.int64) % dims
        sign = 1 - 2 * (np.frombuffer(digests, np.uint8)[4::16].astype(np.int64) >> 4 & 1)  # the 9th hex digit is the high half of the 5th byte
        cells = np.bincount(self.owner * dims + bucket[self.code], weights=sign[self.code], minlength=self.n * dims) if len(self.code) else np.zeros(self.n * dims)
        return cells.astype(np.int64).reshape(self.n, dims)


def each(run: Callable[[pa.RecordBatch], pa.RecordBatch | None], rows: int = 1024, most: int = SLICE) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that takes slices of batches one by one; a task gives its memory back at its end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                for part in parts(b, rows, most):
                    out = run(part)
                    if out is not None:
                        yield out
        finally:
            tidy()

    return whole


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Halves go away from zero, as in SQL."""
    scale = 10.0**digits
    return np.sign(x) * np.floor(np.abs(x) * scale + 0.5) / scale

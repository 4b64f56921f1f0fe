"""Best-fit packing (operator 4): pieces of documents into sequences of at most 1024 tokens, by exact-complement hashing.

Only the counts of the 1024 lengths matter to the plan. The driver gets those, at most 1024 rows at any size of input.
An index has the pairs of lengths by their sum. For each length, longest first, its gap is looked up: as a single length, as
a pair, and as a triple, which is a length and the pair that the index has for what is then left. Combinations that fill the
gap exactly are taken as often as the counts allow; ones with a length that has run out leave the index for good. Lengths
without a combination are packed best-fit. The plan says which
ranks within each length go to which sequences; a piece's rank is the count of its length in the partitions before
(a prefix sum) plus its number in its own, so no task sees more than its own pieces, whatever lengths are frequent.

A document has its ids, then the end id. One of more than ``most`` is cut into pieces of ``most``; the first may be
shorter. Null texts are empty and have the end id alone. An empty table gives no rows. Repeated rows are packed each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import in_arrow, stage
from ._text import slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(docs: DataFrame, tokenizer: str, most: int = 1024, end_id: int = 2) -> DataFrame:
    """The pieces of each document, numbered within their length in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._tokens import codec

        encode, k = codec(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(most + 1, np.int64)
        for b in batches:
            doc_ids = b.column("doc_id")
            for part in slices(b.column("text")):
                flat, n = encode(part)
                total = n + 1
                ids = np.full(int(total.sum()), end_id, "<u4")
                ids[np.arange(len(flat)) + np.repeat(np.arange(part.n), n)] = flat
                pieces = -(-total // most)
                doc = np.repeat(np.arange(part.n), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = (total - 1) % most + 1
                start = np.where(number == 0, 0, head[doc] + (number - 1) * most)
                length = np.where(number == 0, head[doc], most)
                at = (np.cumsum(total) - total)[doc] + start
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(at.tolist(), (at + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                count = np.bincount(length, minlength=most + 1)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(seen, count)
                seen += count
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(doc + part.lo)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), k), pa.int32()), pa.array(nth)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").transform(in_arrow, run, PIECES, True)


class Sums:
    """Combinations of one, two and three lengths by their sum, under counts that only fall."""

    def __init__(self, left: np.ndarray):
        self.left, self.lookups = left, 0
        has = np.flatnonzero(left > 0)
        i, j = np.triu_indices(len(has))
        total, small = has[i] + has[j], has[i]
        fits = total < len(left) - 1
        total, small = total[fits], small[fits]
        order = np.lexsort((small, total))
        sums, first = np.unique(total[order], return_index=True)
        #: The smaller length of each pair, by the pair's sum, ascending: pairs with a longer member come first.
        self.pairs = dict(zip(sums.tolist(), np.split(small[order], first[1:]), strict=False))

    def _pair(self, total: int) -> list[int]:
        self.lookups += 1
        small = self.pairs.get(total)
        if small is None:
            return []
        alive = (self.left[small] > 0) & (self.left[total - small] > 0)
        if not alive.all():
            small = self.pairs[total] = small[alive]
        return small.tolist()

    def of(self, gap: int) -> Iterator[list[int]]:
        """Combinations that fill a gap, singles first, then pairs, then triples, each with longer members first."""
        if self.left[gap] > 0:
            yield [gap]
        for b in self._pair(gap):
            yield [gap - b, b]
        for a in range(gap - 2, (gap - 1) // 3, -1):
            if self.left[a] > 0:
                for b in self._pair(gap - a):
                    if gap - a - b <= a:
                        yield [a, gap - a - b, b]


class Plan:
    """Patterns of lengths: each is used by ``times`` sequences and holds its lengths in this order."""

    def __init__(self, counts: dict[int, int], most: int = 1024):
        self.most = most
        self.patterns: list[tuple[list[int], int]] = []
        left = np.zeros(most + 1, np.int64)
        for length, n in counts.items():
            left[length] = n
        if left[most]:
            self.patterns.append(([most], int(left[most])))
            left[most] = 0
        self.sums = Sums(left)
        for long in range(most - 1, 0, -1):
            if not left[long]:
                continue
            for found in self.sums.of(most - long):
                members, need = np.unique([long, *found], return_counts=True)
                times = int((left[members] // need).min())
                if times:
                    left[members] -= need * times
                    self.patterns.append(([long, *found], times))
                    if not left[long]:
                        break
        self._best_fit(left)

    def _best_fit(self, left: np.ndarray) -> None:
        """Lengths in descending order, each to the smallest gap that holds it, many sequences of one kind at a time."""
        open_: dict[int, list[tuple[list[int], int]]] = {}
        for length in range(self.most - 1, 0, -1):
            n = int(left[length])
            while n:
                gap = min((g for g in open_ if g >= length), default=None)
                members, times = open_[gap].pop() if gap is not None else ([], n)
                if gap is None:
                    gap = self.most
                elif not open_[gap]:
                    del open_[gap]
                each = min(gap // length, max(1, n // times))
                use = min(times, n // each)
                if use < times and members:
                    open_.setdefault(gap, []).append((members, times - use))
                if gap == self.most and not members:
                    each = min(self.most // length, n)
                    use = max(1, n // each)
                n -= each * use
                open_.setdefault(gap - each * length, []).append((members + [length] * each, use))
        self.patterns += [x for group in open_.values() for x in group]

    def intervals(self) -> dict[str, np.ndarray]:
        """For each length, runs of ranks: where each begins, and the sequences and offsets that its pieces get."""
        taken: dict[int, int] = {}
        rows, base = [], 0
        for members, times in self.patterns:
            offset = 0
            for length in members:
                lo = taken.get(length, 0)
                rows.append((length, lo, base, offset))
                taken[length] = lo + times
                offset += length
            base += times
        rows.sort()
        cols = np.array(rows, np.int64).reshape(-1, 4)
        return {"length": cols[:, 0], "lo": cols[:, 1], "base": cols[:, 2], "offset": cols[:, 3]}


def pack(pieces: DataFrame, most: int = 1024) -> DataFrame:
    """Sequences and offsets for staged pieces, as ``cut`` gives them."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).select("part", "length", "before")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `most` rows
    plan = Plan(total, most).intervals()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.searchsorted(plan["length"], np.arange(most + 2))
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("nth").to_numpy() + b.column("before").to_numpy()
            at = np.empty(len(rank), np.int64)
            for x in np.unique(length):
                own = length == x
                at[own] = first[x] + np.searchsorted(plan["lo"][first[x] : first[x + 1]], rank[own], "right") - 1
            sequence = plan["base"][at] + rank - plan["lo"][at]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(plan["offset"][at])], [*names, "sequence_id", "offset"])

    return pieces.join(before, ["part", "length"]).transform(in_arrow, place, PACKED)


def best_fit_packing(docs: DataFrame, tokenizer: str, most: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with the sequence and the offset that each gets."""
    return pack(stage(cut(docs, tokenizer, most, end_id), "pieces"), most)

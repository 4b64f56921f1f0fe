"""The suffix tree in the memory of one machine: what the table of ``lodestone.llm.suffix_tree`` is held against."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._shared import in_arrow
from lodestone.llm._text import Slice, slices
from lodestone.llm.suffix_tree import GATHERED, Counter, _find, _words

SHIFT = 22


@dataclass
class Tree:
    """n-grams by length, ascending by key: the place of all but the last word among shorter ones, then the last word.

    words: hashes of eligible words; the end and the start of a text come after them. root: log10 probabilities.
    """

    words: np.ndarray
    root: np.ndarray
    count: np.ndarray
    grams: list[np.ndarray] = field(default_factory=list)
    n: list[np.ndarray] = field(default_factory=list)
    suffix: list[np.ndarray] = field(default_factory=list)
    gain: list[np.ndarray] = field(default_factory=list)
    kept: list[np.ndarray] = field(default_factory=list)
    rest: list[np.ndarray] = field(default_factory=list)

    def places(self, part: Slice, levels: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The text of each symbol, start and end included, and the place of the n-gram that ends there, for each length."""
        h, doc = _words(part)
        n = np.bincount(doc, minlength=part.n)
        first = np.cumsum(n + 2) - (n + 2)
        owner = np.repeat(np.arange(part.n), n + 2)
        symbol = np.full(len(owner), -1, np.int64)
        symbol[np.arange(len(h)) + 2 * doc + 1] = _find(self.words, h)
        symbol[first], symbol[first + n + 1] = len(self.words) + 1, len(self.words)
        at = [symbol]
        for d in range(levels):
            before = np.concatenate(([-1], at[d][:-1]))
            ok = (before >= 0) & (symbol >= 0) & (symbol <= len(self.words))  # the start has nothing before it
            at.append(_find(self.grams[d], (before << SHIFT) | symbol, ok))
        return owner, at

    def gains(self, part: Slice) -> np.ndarray:
        """What the states add to the root's log10 probability of each text."""
        owner, at = self.places(part, len(self.grams))
        out = np.zeros(len(owner))
        live = np.ones(len(owner), bool)
        live[0] = False
        for d in range(len(self.grams)):
            context = np.concatenate(([-1], at[d][:-1]))
            live &= (context >= 0) & (at[0] != len(self.words) + 1)
            live[live] = self.kept[d][context[live]]
            hit = live & (at[d + 1] >= 0)
            out[hit] = self.gain[d][at[d + 1][hit]]
            miss = live & ~hit
            out[miss] += self.rest[d][context[miss]]
        return np.bincount(owner, weights=out, minlength=part.n)

    def learn(self, keys: np.ndarray, n: np.ndarray, strength: float) -> None:
        """Add the n-grams of the next length: their counts give contexts their successors."""
        d = len(self.grams)
        order = np.argsort(keys)
        keys, n = keys[order], n[order].astype(float)
        context, word = keys >> SHIFT, keys & ((1 << SHIFT) - 1)
        total = self.count if d == 0 else self.n[d - 1]
        if d == 0:
            above, suffix = 10 ** self.root[word], word
        else:
            suffix = _find(self.grams[d - 1], (self.suffix[d - 1][context] << SHIFT) | word)
            above = 10 ** (self.gain[d - 1][suffix] + self.root[word])
        c = total[context]
        p = (n + strength * above) / (c + strength)
        of = lambda w: np.bincount(context, weights=w, minlength=len(total))
        left, left_above = np.maximum(1 - of(p), 1e-12), np.maximum(1 - of(above), 1e-12)
        other = np.maximum(total - of(n), 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (of(n * np.log(n / c / above)) + np.where(other > 0, other * np.log(other / total / left_above), 0))
        kinds = np.bincount(context, minlength=len(total))
        self.grams.append(keys)
        self.n.append(n)
        self.suffix.append(suffix)
        self.gain.append(np.log10(p) - self.root[word])
        self.kept.append((kinds > 0) & (ratio >= kinds + 4 * np.sqrt(2 * kinds) + 10))
        self.rest.append(np.log10(left / left_above))

    def close(self) -> None:
        """Keep the parents of what is kept."""
        for d in range(len(self.grams) - 1, 0, -1):
            self.kept[d - 1][self.suffix[d - 1][np.flatnonzero(self.kept[d])]] = True


def _gram_counts(texts: DataFrame, tree: Broadcast, levels: int) -> DataFrame:
    """key and n of the n-grams one longer than the tree's ``levels``, of which both the context and the suffix are eligible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, found = tree.value, Counter()
        for b in batches:
            for part in slices(b.column("text")):
                _, at = t.places(part, levels)
                before, word = np.concatenate(([-1], at[levels][:-1])), at[0]
                ok = (before >= 0) & (at[levels] >= 0) & (word <= len(t.words))
                found.add(*np.unique((before[ok] << SHIFT) | word[ok], return_counts=True))
                if len(found.keys) > GATHERED:
                    yield found.out()
        yield found.out()

    return texts.select("text").transform(in_arrow, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def grow(texts: DataFrame, counts: DataFrame, ends: int, total: int, scale: float, depth: int = 3, least_n: int = 4, strength: float = 4.0) -> Tree:
    """The tree of ``texts`` in memory, for tables that fit there; counts: key and n of their words."""
    spark = texts.sparkSession
    words = counts.where(F.col("n") >= least_n).toPandas().sort_values("key")
    count = np.concatenate((words["n"].to_numpy(np.int64), [ends, ends])).astype(float)
    tree = Tree(words["key"].to_numpy(np.int64), np.log10((count + 0.5) / scale), count)
    for d in range(depth):
        sent = spark.sparkContext.broadcast(tree)
        grams = _gram_counts(texts, sent, d).where(F.col("n") >= least_n).toPandas()
        sent.unpersist()
        if not len(grams):
            break
        tree.learn(grams["key"].to_numpy(np.int64), grams["n"].to_numpy(np.int64), strength)
    tree.close()
    return tree

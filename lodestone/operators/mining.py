"""Entities and relations found in a corpus: words that stand together more often than chance allows, and what links two such phrases.

Two words that follow each other in a sentence are a collocation if they do so at least ``least`` times, more often than by
chance, with a log-likelihood ratio of ``ratio`` or more. An entity is a maximal run of words in which each two neighbours are a
collocation. A relation is two entities of a sentence, one after the other, with one to ``between`` words between them.

Words are lower-cased and without punctuation at their ends; what is only punctuation is no word. Words that are frequent enough
to be in a collocation get numbers, a pair of them is one number, and tasks send each other sorted runs of these with their counts,
packed, a row for each range. Sentences are cut into runs, entities and relations by the task that has them, without a shuffle, if the
collocations can be sent there.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, Config
from lodestone.functions import sentences, tokens
from lodestone.functions.batches import parts, tidy
from lodestone.sources.tables import cut

#: Collocations up to which executors get them, 8 bytes each in a file that their tasks map, and in memory some 40 for each word in them.
PAIRS = 100_000_000
#: Words that get numbers at most, some 60 bytes each; pairs with others are counted as texts.
VOCABULARY = 4_000_000
#: Pairs that a range has on average, a pair as often as it stands in the texts.
RANGE = 1 << 21
#: Pairs that a task sorts at a time, and distinct ones that it holds before it sends them.
BLOCK, HELD = 1 << 21, 6_000_000


def plain_words(text: Column) -> Column:
    """The words of a text, lower-cased, without punctuation at their ends."""
    # one pass over the text, not one a word; runs of punctuation are taken whole, so a long one costs its length
    return tokens(F.regexp_replace(F.lower(text), r"(?<!\S)\p{Punct}++|(?<!\p{Punct})\p{Punct}++(?!\S)", ""))


def sentence_words(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos from 0, and w, the words, of each sentence of ``docs`` (key, text)."""
    rows = docs.select(key, F.posexplode(sentences(F.col("text"))).alias("pos", "s"))
    return rows.select(key, "pos", plain_words(F.col("s")).alias("w"))


class Words:
    """Distinct words by number. A word is found by a hash and then compared, so no two are taken for one."""

    def __init__(self, words: pa.Array):
        self.words, self.seed = words.cast(pa.large_binary()), 0
        while True:
            h = self._hashes(self.words)
            order = np.argsort(h)
            self.h, self.number = h[order], order.astype(np.int32)
            if not (self.h[1:] == self.h[:-1]).any():
                break
            self.seed += 1

    def __len__(self) -> int:
        return len(self.words)

    def _hashes(self, words: pa.Array) -> np.ndarray:
        out = np.empty(len(words), np.uint64)
        for lo in range(0, len(words), BLOCK):
            some = words.slice(lo, BLOCK)
            texts = np.empty(len(some), object)
            texts[:] = some.to_pylist()
            out[lo : lo + BLOCK] = pd.util.hash_array(texts, hash_key=f"{self.seed:016d}", categorize=False)
        return out

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each word, -1 for others."""
        if not len(words) or not len(self):
            return np.full(len(words), -1, np.int64)
        coded = words.cast(pa.large_binary()).dictionary_encode()
        h = self._hashes(coded.dictionary)
        at = np.minimum(np.searchsorted(self.h, h), len(self) - 1)
        number = self.number[at].astype(np.int64)
        same = (self.h[at] == h) & pc.equal(self.words.take(pa.array(number)), coded.dictionary).to_numpy(zero_copy_only=False)
        return np.where(same, number, -1)[coded.indices.to_numpy()]

    def texts(self, numbers: np.ndarray) -> pa.Array:
        return self.words.take(pa.array(numbers)).cast(pa.string())


class Frequent(Words):
    """Words with how often they are the first and the second of a pair; the most frequent have the lowest numbers."""

    def __init__(self, words: pa.Array, first: np.ndarray, second: np.ndarray):
        order = np.argsort(-(first + second), kind="stable")
        super().__init__(words.take(pa.array(order)))
        self.first, self.second = (np.append(0.0, np.cumsum(x[order], dtype=np.float64)) for x in (first, second))
        self.ranges = int(self.first[-1]) // RANGE + 1

    def range_of(self, pairs: np.ndarray) -> np.ndarray:
        """The range that a pair is in, ascending: as many pairs are before it as if words stood together by chance."""
        a, b = pairs // len(self), pairs % len(self)
        before = self.first[a] + (self.first[a + 1] - self.first[a]) * (self.second[b] / max(self.second[-1], 1.0))
        return np.minimum(before / max(self.first[-1], 1.0) * self.ranges, self.ranges - 1).astype(np.int64)


def _neighbours(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of lists, where each list begins, and whether a word has one before it in its list."""
    words, size = lists.flatten(), pc.list_value_length(lists).fill_null(0).to_numpy()
    begin = np.cumsum(size) - size
    second = np.ones(len(words), bool)
    second[begin[size > 0]] = False
    return words, begin, second


def _pairs(words: Words, lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words of lists, where lists begin, the places of second words of pairs, and the pairs' numbers, -1 if a word has none."""
    texts, begin, second = _neighbours(lists)
    number, at = words.numbers(texts), np.flatnonzero(second)
    a, b = number[at - 1], number[at]
    return texts, begin, at, np.where((a >= 0) & (b >= 0), a * len(words) + b, -1)


def _summed(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(pairs):
        return pairs, n
    order = np.argsort(pairs)
    pairs, n = pairs[order], n[order]
    at = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[at], np.add.reduceat(n, at)


def _packed(pairs: np.ndarray, n: np.ndarray) -> bytes:
    """Differences and counts, all their first bytes, all second ones and so on: most of these are zero."""
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8).T).tobytes() for x in (np.diff(pairs, prepend=0), n)]
    return np.array([len(pairs)], "<i8").tobytes() + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    (n,) = np.frombuffer(data, "<i8", 1).tolist()
    planes = np.frombuffer(pa.decompress(memoryview(data)[8:], decompressed_size=16 * n, codec="zstd", asbytes=True), np.uint8).reshape(2, 8, n)
    gaps, count = (np.ascontiguousarray(x.T).view(np.int64).reshape(n) for x in planes)
    return np.cumsum(gaps), count


def _counted(words: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of lists of words: range, and a packed run of its pairs with their counts in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        held, new, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            pairs, n = np.unique(np.concatenate(new) if new else np.zeros(0, np.int64), return_counts=True)
            return _summed(np.concatenate((held[0], pairs)), np.concatenate((held[1], n)))

        def sent() -> Iterator[pa.RecordBatch]:
            place = known.range_of(held[0])
            order = np.argsort(place, kind="stable")  # rounding may put neighbours in another order
            place, pairs, n = place[order], held[0][order], held[1][order]
            at = np.flatnonzero(np.diff(place, prepend=-1))
            for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(place)], strict=True):
                yield pa.RecordBatch.from_pydict({"part": pa.array([place[lo]], pa.int64()), "data": pa.array([_packed(pairs[lo:hi], n[lo:hi])], pa.binary())})

        try:
            for whole in batches:
                for b in parts(whole, whole.num_rows):
                    pairs = _pairs(known, b.column("w"))[3]
                    new.append(pairs[pairs >= 0])
                    size += len(new[-1])
                    if size >= BLOCK:
                        held, new, size = added(), [], 0
                        if len(held[0]) >= HELD:
                            yield from sent()
                            held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            held = added()
            if len(held[0]):
                yield from sent()
        finally:
            tidy()

    return run


def _totals(words: Broadcast, least: int) -> Callable[[pa.Table], pa.Table]:
    """a, b and n of the pairs of a range that stand ``least`` times in all its runs together."""

    def run(table: pa.Table) -> pa.Table:
        known = words.value
        runs = [_unpacked(x) for x in table.column("data").to_pylist()]
        pairs, n = _summed(*(np.concatenate(x) for x in zip(*runs, strict=True)))
        pairs, n = pairs[n >= least], n[n >= least]
        return pa.table({"a": known.texts(pairs // len(known)), "b": known.texts(pairs % len(known)), "n": pa.array(n, pa.int64())})

    return run


def _outside(words: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """a and b of the pairs that have no number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in parts(whole, whole.num_rows):
                texts, _, at, pairs = _pairs(words.value, b.column("w"))
                at = at[pairs < 0]
                yield pa.RecordBatch.from_pydict({"a": texts.take(pa.array(at - 1)), "b": texts.take(pa.array(at))})

    return run


def collocations(words: DataFrame, least: int = 5, ratio: float = 10.83) -> DataFrame:
    """a, b, n and llr of the collocations in rows of words (w)."""
    spark, lists = words.sparkSession, words.where(F.size("w") > 1).select("w")
    each = lists.select(F.size("w").alias("k"), F.posexplode("w").alias("i", "word"))
    each = each.groupBy("word").agg(F.count(F.when(F.col("i") < F.col("k") - 1, 1)).alias("r"), F.count(F.when(F.col("i") > 0, 1)).alias("c"))
    often = (F.col("r") >= least) | (F.col("c") >= least)
    each = cut(each.groupBy(F.when(often, F.col("word")).alias("word")).agg(F.sum("r").alias("r"), F.sum("c").alias("c")))  # all others are one row
    every = each.agg(F.sum("r").alias("all"))
    each = each.where(F.col("word").isNotNull())
    whole = each.count() <= VOCABULARY
    table = (each if whole else each.orderBy(F.desc(F.col("r") + F.col("c")), "word").limit(VOCABULARY)).toArrow().combine_chunks()
    known = Frequent(pa.array([], pa.string()) if not table.num_rows else table.column("word").combine_chunks(), table.column("r").to_numpy(), table.column("c").to_numpy())
    sent = spark.sparkContext.broadcast(known)
    pairs = lists.mapInArrow(_counted(sent), "part long, data binary").groupBy("part").applyInArrow(_totals(sent, least), "a string, b string, n long")
    if not whole:
        pairs = pairs.unionByName(lists.mapInArrow(_outside(sent), "a string, b string").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least))
    rows = pairs.join(each.select(F.col("word").alias("a"), "r"), "a").join(each.select(F.col("word").alias("b"), "c"), "b").crossJoin(F.broadcast(every))  # one row
    n, r, c, every = (F.col(x).cast("double") for x in ("n", "r", "c", "all"))
    term = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    g = term(n, r * c / every) + term(r - n, r * (every - c) / every) + term(c - n, (every - r) * c / every) + term(every - r - c + n, (every - r) * (every - c) / every)
    scored = rows.withColumn("llr", F.round(2 * g, 6)).where((F.col("llr") >= ratio) & (n * every > r * c))
    return scored.select("a", "b", "n", "llr")


class Collocations(Words):
    """Collocations as sorted numbers of pairs, in a file that Spark gives to executors."""

    file = ""

    @cached_property
    def pairs(self) -> np.ndarray:
        path = SparkFiles.get(self.file)
        return np.memmap(path, np.int64, "r") if os.path.getsize(path) else np.zeros(0, np.int64)

    def together(self, lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words of lists, where lists begin, and whether a word and the one before it are a collocation."""
        texts, begin, at, pairs = _pairs(self, lists)
        out = np.zeros(len(texts), bool)
        if len(self.pairs):
            out[at] = self.pairs[np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)] == pairs
        return texts, begin, out


#: Kept until the driver ends, as executors may come later.
_FOLDERS: list[tempfile.TemporaryDirectory] = []


def _sent(known: DataFrame) -> Broadcast | None:
    """``known`` (a, b) for all tasks, if it has at most ``PAIRS`` rows."""
    if known.limit(PAIRS + 1).count() > PAIRS:
        return None
    context = known.sparkSession.sparkContext
    table = known.select(F.explode(F.array("a", "b")).alias("word")).distinct().toArrow()
    out = Collocations(table.column("word").combine_chunks() if table.num_rows else pa.array([], pa.string()))
    words = context.broadcast(out)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (words.value.numbers(b.column(x)) for x in ("a", "b"))
            yield pa.RecordBatch.from_pydict({"pair": pa.array(a * len(words.value) + c, pa.int64())})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"data": pa.array([b.column("pair").to_numpy().tobytes()], pa.binary())})

    _FOLDERS.append(tempfile.TemporaryDirectory(prefix="lodestone-"))
    out.file = f"{os.path.basename(_FOLDERS[-1].name)}.pairs"
    with open(f"{_FOLDERS[-1].name}/{out.file}", "wb") as f:  # a part at a time: the driver doesn't hold them
        for r in known.select("a", "b").mapInArrow(numbers, "pair long").sort("pair").mapInArrow(whole, "data binary").toLocalIterator():
            f.write(bytes(r[0]))
    context.addFile(f.name)
    return context.broadcast(out)


def _cut(known: Broadcast, made: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``made`` of the runs of sentences (key, pos, w): the sentences, their words, and of each run its sentence, its place among that
    one's runs from 1, the place of its first word among all words and in the sentence, and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for whole in batches:
                for b in parts(whole, whole.num_rows):
                    texts, begin, together = known.value.together(b.column("w"))
                    at = np.flatnonzero(~together)
                    owner = np.searchsorted(begin, at, "right") - 1
                    first = np.searchsorted(at, begin)
                    yield made(b, texts, owner, np.arange(len(at)) - first[owner] + 1, at, at - begin[owner], np.diff(np.append(at, len(texts))))
        finally:
            tidy()

    return run


def _joined(words: pa.Array, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """``size`` words from each place on, with spaces between them."""
    ends = np.cumsum(size)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - size), size)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), words.take(pa.array(place)).cast(pa.string()))
    return pc.binary_join(lists, " ").cast(pa.string())


def _batch(b: pa.RecordBatch, owner: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
    own = pa.array(owner)
    return pa.RecordBatch.from_pydict({"key": b.column("key").take(own), "pos": b.column("pos").take(own)} | columns)


def _all_runs(b, words, owner, seg, at, start, size):
    return _batch(b, owner, seg=pa.array(seg, pa.int64()), start=pa.array(start, pa.int32()), size=pa.array(size, pa.int64()), text=_joined(words, at, size))


def _entities(b, words, owner, seg, at, start, size):
    e = size > 1
    return _batch(b, owner[e], start=pa.array(start[e], pa.int32()), entity=_joined(words, at[e], size[e]))


def _relations(between: int) -> Callable:
    def made(b, words, owner, seg, at, start, size):
        e = np.flatnonzero(size > 1)
        p, q = e[:-1], e[1:]
        linked = (owner[p] == owner[q]) & (q - p >= 2) & (q - p <= between + 1)
        p, q = p[linked], q[linked]
        middle = at[p] + size[p]
        return _batch(b, owner[p], subject=_joined(words, at[p], size[p]), relation=_joined(words, middle, at[q] - middle), object=_joined(words, at[q], size[q]))

    return made


def _in_place(words: DataFrame, known: DataFrame, key: str, made: Callable, columns: str) -> DataFrame | None:
    """What ``made`` finds in sentences (key, pos, w), each in the task that has it; none if ``known`` can't be sent there."""
    sent = _sent(known)
    if sent is None:
        return None
    rows = words.where(F.size("w") > 0).select(F.col(key).alias("key"), "pos", "w")
    return rows.mapInArrow(_cut(sent, made), f"key {dict(words.dtypes)[key]}, pos int, {columns}").withColumnRenamed("key", key)


def segments(words: DataFrame, known: DataFrame, key: str = "doc_id", config: Config = DEFAULT) -> DataFrame:
    """key, pos, seg, start, size and text of the maximal runs of each sentence (key, pos, w); a word in no collocation is one of its own.

    Up to ``PAIRS`` collocations are sent to all executors: then the words of a sentence stay together, in order, and are cut into
    runs where they are. Beyond, words are dealt by pairs, and then by sentences.
    """
    rows = _in_place(words, known, key, _all_runs, "seg long, start int, size long, text string")
    return _dealt(words, known, key) if rows is None else rows


def _dealt(words: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """As ``segments``, for any number of collocations."""
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("w", 1, F.size("w") - 1))
    rows = words.where(F.size("w") > 0).select(key, "pos", F.posexplode(F.arrays_zip(before.alias("before"), F.col("w").alias("word"))).alias("i", "p"))
    rows = rows.select(key, "pos", "i", "p.word", "p.before")
    pairs = known.select(F.col("a").alias("before"), F.col("b").alias("word"), F.lit(0).alias("new"))
    rows = rows.join(pairs, ["before", "word"], "left")
    order = Window.partitionBy(key, "pos").orderBy("i")
    rows = rows.withColumn("seg", F.sum(F.coalesce("new", F.lit(1))).over(order))
    made = rows.groupBy(key, "pos", "seg").agg(F.min("i").alias("start"), F.count("*").alias("size"), F.array_sort(F.collect_list(F.struct("i", "word"))).alias("x"))
    return made.select(key, "pos", "seg", "start", "size", F.array_join(F.transform("x", lambda t: t["word"]), " ").alias("text"))


def entities_of(words: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """``entities`` of the runs of sentences (key, pos, w)."""
    rows = _in_place(words, known, key, _entities, "start int, entity string")
    return entities(_dealt(words, known, key), key) if rows is None else rows


def relations_of(words: DataFrame, known: DataFrame, key: str = "doc_id", between: int = 5) -> DataFrame:
    """``relations`` of the runs of sentences (key, pos, w); found without a shuffle of the runs."""
    rows = _in_place(words, known, key, _relations(between), "subject string, relation string, object string")
    return relations(_dealt(words, known, key), key, between) if rows is None else rows


def entities(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos, start and entity of the runs of two words or more."""
    return runs.where("size > 1").select(key, "pos", "start", F.col("text").alias("entity"))


def relations(runs: DataFrame, key: str = "doc_id", between: int = 5) -> DataFrame:
    """key, pos, subject, relation and object of two entities in a row of a sentence; a sentence can have several, in order."""
    rows = runs.groupBy(key, "pos").agg(F.array_sort(F.collect_list(F.struct("seg", "size", "text"))).alias("x"))
    at = F.filter(F.transform("x", lambda t, i: F.when(t["size"] > 1, i)), lambda i: i.isNotNull())
    rows = rows.withColumn("at", at).where(F.size("at") > 1)
    linked = F.transform(F.sequence(F.lit(0), F.size("at") - 2), lambda k: F.struct(F.col("at")[k].alias("p"), F.col("at")[k + 1].alias("q")))
    rows = rows.select(key, "pos", "x", F.explode(linked).alias("l")).where((F.col("l.q") - F.col("l.p")).between(2, between + 1))
    words = F.array_join(F.transform(F.slice("x", F.col("l.p") + 2, F.col("l.q") - F.col("l.p") - 1), lambda t: t["text"]), " ")
    return rows.select(key, "pos", F.col("x")[F.col("l.p")]["text"].alias("subject"), words.alias("relation"), F.col("x")[F.col("l.q")]["text"].alias("object"))

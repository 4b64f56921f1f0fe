"""Phrase collocation mining (operator 12), by bucket counts and Apriori pruning, one pass over the texts for each length.

A-Z become lower case; texts are cut at `[.,;:!?\\x0A-\\x0D]` into pieces, and those into words `[^\\x20\\x09]+`. All counts are per
language (null: `und`). Pass k counts k-grams exactly, those alone that can be frequent, and puts the (k + 1)-grams into
hash buckets, each with a count that stops at the threshold:

* pass 1 counts all words and puts all pairs into buckets;
* pass k > 1 counts a k-gram if its first and its last k - 1 words are frequent (Apriori) and its bucket's sum of pass k - 1
  reaches the threshold (PCY); a (k + 1)-gram gets into a bucket if both k-grams in it were counted (DHP).

Tasks know both by bitmaps, which lose nothing and let some others pass; the exact counts, by words and not by hashes, decide.
Both have at most 2^26 bits, 8 MB, at any size of input, and fewer where the input is small. Each task adds up its own
k-grams and buckets before anything is shuffled, and a task's table is emptied into the shuffle whenever it passes ``HELD`` rows.
Within one task, n-grams are told apart by 64-bit hashes.

Frequent n-grams are a table: parts of phrases are looked up in it by joins, and so are phrases within longer ones. A phrase
in one that is two words longer is also in one that is one word longer, of at least that count, so only those are compared.
Null and empty texts, and empty tables, give no rows. Repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bits import bitmap, has
from ._shared import drop_stage, in_arrow, stage
from ._text import U64, Slice, mix, ragged, slices

#: Buckets, and bits of a bitmap, at least and at most; buckets of a block; rows that a task holds.
FEWEST, BUCKETS, BLOCK, HELD = 1 << 16, 1 << 26, 1 << 15, 500_000
#: Languages, an (id, name) row each, up to which their totals are broadcast.
NAMES = 100_000
ROWS = "lang string, phrase string, key long, n long, block int, counts binary"

PIECE = np.zeros(256, bool)
PIECE[list(b".,;:!?\n\x0b\x0c\r")] = True
GAP = PIECE.copy()
GAP[[0x20, 0x09]] = True
_MIX = mix(np.arange(1, 64, dtype=U64) * U64(0xA0761D6478BD642F))


class Words:
    """The words of a slice: where they are, the text and the piece of each."""

    def __init__(self, part: Slice, seeds: np.ndarray):
        self.part = part = part.lower()
        self.starts, self.ends = part.runs(~GAP[part.data])
        self.doc = part.owner(self.starts)
        self.piece = np.cumsum(PIECE[part.data] | part.starts_here()[:-1])[self.starts]
        self.hash, self.seed = part.hashes(self.starts, self.ends), seeds[self.doc]

    def keys(self, k: int) -> np.ndarray:
        """A hash of each k words that stand together, and of their language."""
        n = max(len(self.hash) - k + 1, 0)
        total = self.seed[:n] * _MIX[62] + U64(k) * _MIX[61]
        for t in range(k):
            total += self.hash[t : t + n] * _MIX[t]
        return mix(total).view(np.int64)

    def together(self, k: int) -> np.ndarray:
        """Of each k words in a row, whether one piece holds them."""
        n = max(len(self.piece) - k + 1, 0)
        return self.piece[:n] == self.piece[k - 1 :][:n]

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        words = []
        for t in range(k):
            lo, size = self.starts[at + t], self.ends[at + t] - self.starts[at + t]
            data, ends = self.part.data[ragged(lo, size)], np.zeros(len(at) + 1, np.int32)
            np.cumsum(size, out=ends[1:])
            words.append(pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(data.tobytes())))
        return pc.binary_join_element_wise(*words, " ") if k > 1 else words[0]


class Counts:
    """A task's n-grams and their counts, by hash; given out when there are many."""

    def __init__(self, names: list[str]):
        self.names, self.rows, self.held = names, [], 0

    def add(self, keys: np.ndarray, langs: np.ndarray, words: Words, at: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
        own, first, n = np.unique(keys, return_index=True, return_counts=True)
        self.rows.append((own, n, langs[first], words.phrases(at[first], k)))
        self.held += len(own)
        if self.held > HELD:
            self._add_up()
            if self.held > HELD // 2:
                yield from self.all()

    def _add_up(self) -> None:
        if len(self.rows) > 1:
            keys, n, langs = (np.concatenate([r[i] for r in self.rows]) for i in range(3))
            own, first, to = np.unique(keys, return_index=True, return_inverse=True)
            total = np.zeros(len(own), np.int64)
            np.add.at(total, to, n)
            phrases = pa.concat_arrays([r[3] for r in self.rows]).take(pa.array(first))
            self.rows, self.held = [(own, total, langs[first], phrases)], len(own)

    def all(self) -> Iterator[pa.RecordBatch]:
        self._add_up()
        for keys, n, langs, phrases in self.rows:
            for lo in range(0, len(keys), 65_536):
                hi = min(lo + 65_536, len(keys))
                yield _batch(pa.array(self.names).take(pa.array(langs[lo:hi])), phrases[lo:hi], pa.array(keys[lo:hi]), pa.array(n[lo:hi].astype(np.int64)))
        self.rows, self.held = [], 0


def _batch(lang=None, phrase=None, key=None, n=None, block=None, counts=None) -> pa.RecordBatch:
    size = len(next(x for x in (n, block) if x is not None))
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    columns = [pa.nulls(size, t) if c is None else c.cast(t) for c, t in zip((lang, phrase, key, n, block, counts), kinds)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ROWS.split(", ")])


def _pass(docs: DataFrame, k: int, last: bool, least: int, buckets: int, frequent, full) -> DataFrame:
    """ROWS of pass k: k-grams with counts, a language's words (phrase null) in pass 1, and blocks of (k + 1)-grams' buckets."""
    spark = docs.sparkSession
    frequent, full = (spark.sparkContext.broadcast(x) if x is not None else None for x in (frequent, full))
    kind = np.uint8 if least < 256 else np.uint16 if least < 65_536 else np.uint32
    most = min(least, np.iinfo(kind).max)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        codes: dict[str, int] = {}
        seeds, totals = np.zeros(0, U64), {}
        counts, table = Counts(names), None if last else np.zeros(buckets, kind)
        for b in batches:
            coded = b.column("lang").dictionary_encode()
            for name in coded.dictionary.to_pylist():
                if name not in codes:
                    codes[name] = len(names)
                    names.append(name)
                    seeds = np.append(seeds, U64(int.from_bytes(blake2b(name.encode(), digest_size=8).digest(), "little")))
            lang = np.array([codes[n] for n in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
            for part in slices(b.column("text")):
                own = lang[part.lo : part.hi]
                words = Words(part, seeds[own])
                if not len(words.hash):
                    continue
                keys, counted = words.keys(k), words.together(k)
                if k == 1:
                    for code, n in enumerate(np.bincount(own[words.doc])):
                        totals[code] = totals.get(code, 0) + int(n)
                else:
                    known = has(frequent.value, words.keys(k - 1))
                    counted &= known[:-1] & known[1:]
                    counted[counted] = has(full.value, keys[counted])
                at = np.flatnonzero(counted)
                if len(at):
                    yield from counts.add(keys[at], own[words.doc[at]], words, at, k)
                if table is not None:
                    longer = words.together(k + 1) & counted[:-1] & counted[1:]
                    place, n = np.unique(words.keys(k + 1)[longer] & (buckets - 1), return_counts=True)
                    table[place] = np.minimum(table[place] + n, most)
        yield from counts.all()
        if k == 1 and names:
            yield _batch(lang=pa.array(names), n=pa.array([totals.get(c, 0) for c in range(len(names))], pa.int64()))
        if table is not None:
            table = table.reshape(-1, min(BLOCK, buckets))
            for i in np.flatnonzero(table.any(1)):
                yield _batch(block=pa.array([i]), counts=pa.array([table[i].tobytes()]))

    return stage(docs.transform(in_arrow, run, ROWS), f"phrases-{k}")


def _full(rows: DataFrame, least: int, buckets: int) -> np.ndarray:
    """The bitmap of buckets whose counts in all tasks come to ``least``: at most ``BUCKETS`` bits."""
    kind = np.uint8 if least < 256 else np.uint16 if least < 65_536 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counts in zip(b.column("block").to_pylist(), b.column("counts")):
                x = np.frombuffer(counts.as_buffer(), kind)
                sums[block] = np.minimum(sums.get(block, 0) + x.astype(np.uint64), least).astype(np.uint32)
        for block, x in sums.items():
            if (x >= least).any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "bits": pa.array([np.packbits(x >= least, bitorder="little").tobytes()], pa.binary())})

    n, size = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(BLOCK, buckets) // 8
    out = np.zeros((buckets // 8 // size, size), np.uint8)
    for r in rows.where("block IS NOT NULL").select("block", "counts").repartition(n, "block").transform(in_arrow, run, "block int, bits binary").collect():
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _power(n: float) -> int:
    return min(BUCKETS, max(FEWEST, 1 << max(int(n) - 1, 0).bit_length()))


def frequent_ngrams(docs: DataFrame, least: int = 100, most_words: int = 5) -> DataFrame:
    """(lang, phrase, size, n) of all n-grams of up to ``most_words`` words found ``least`` times in a language's ``docs`` (lang, text).

    A language's count of words has a null phrase and size 0. It is one staged table.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    docs = docs.where("text IS NOT NULL")
    found = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a text has a word in some six bytes: buckets get a quarter of the threshold, on average
    buckets, frequent, full, tables = _power(found / 6 * 4 / least), None, None, []
    for k in range(1, most_words + 1):
        rows = _pass(docs, k, k == most_words, least, buckets, frequent, full)
        own = rows.where("block IS NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.min("key").alias("key")).where((F.col("n") >= least) | F.col("phrase").isNull())
        own = stage(own.withColumn("size", F.when(F.col("phrase").isNull(), 0).otherwise(k)), f"frequent-{k}")
        tables.append(own)
        size = own.where("size > 0").count()
        if k < most_words:
            frequent, full = bitmap(own.where("size > 0"), _power(32 * size)), _full(rows, least, buckets)
        drop_stage(rows)
        if not size:
            break
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.select("lang", "phrase", "size", "n")


def collocations(docs: DataFrame, least: int = 100, most_words: int = 5, top: int = 2000, share: int = 100) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count; of its cuts in two, with counts l and r, that of the least score floor(1000 a n / (l r)) counts, the
    earliest of equal ones. Phrases within a longer one of at least ``share`` per cent of their count are left out.
    """
    found = frequent_ngrams(docs, least, most_words)
    totals = found.where("size = 0").select("lang", F.col("n").alias("n_words"))
    counts = found.where("size > 0").select("lang", "phrase", "n")
    phrases = found.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))

    words = lambda first, n: F.array_join(F.slice(F.split("phrase", " "), first, n), " ")
    inside = found.where("size > 2").select("lang", "n", F.explode(F.array(words(1, F.col("size") - 1), words(2, F.col("size") - 1))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = phrases.join(inside, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * CAST(longer AS DECIMAL(30, 0)) < {share} * CAST(a AS DECIMAL(30, 0))").drop("longer")

    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("left", words(1, F.col("k"))).withColumn("right", words(F.col("k") + 1, F.col("size") - F.col("k")))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    totals = F.broadcast(totals) if totals.count() <= NAMES else totals
    number = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"CAST(1000 AS DECIMAL(4, 0)) * {number('a')} * {number('n_words')} DIV ({number('l')} * {number('r')})")
    cuts = cuts.join(totals, "lang").withColumn("score", score)
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n_words")).alias("b"))
    best = best.select("lang", "phrase", "b.a", "b.l", "b.r", F.col("b.n_words").alias("n"), "b.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

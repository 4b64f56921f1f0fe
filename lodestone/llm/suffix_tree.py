"""LM scoring (operator 1): a probabilistic suffix tree over words.

A text is its words, A-Z lower-cased, then one end. The root predicts by additive smoothing over all training words, with
one place for all unknown ones. A state is a context of up to ``depth`` preceding symbols, the start of the text among
them. Contexts and their successors are eligible from a count of ``least_n`` on, whatever the input, so what is gathered
grows with it. Each length is counted by one grouped aggregation over all training texts, of n-grams whose parts are
eligible. A context is retained if its successors diverge from what its parent, the context less its first word, predicts
(a likelihood-ratio test against its number of successors), or if a longer retained context needs it. Successors'
probabilities are smoothed towards the parent's; all others share what is left, in proportion to the parent's, so each
distribution sums to one. A word is predicted by its longest suffix state.

The tree is a table. What a state adds to its parent's prediction depends on the n-gram alone: so each n-gram of a text has
one value (``values``), as a successor and as a context, and a text's states add the sum of them to the root. Tasks know
the values of at most ``common`` n-grams and words, the most frequent. The others are looked up in the whole table, which is
dealt by ranges of hashes, in one pass; frequent ones, the skewed ones, aren't among them. n-grams and words that can't be
in the table are left out before by a bitmap of bounded size, which may let others pass, but loses none.

Counts and look-ups are shuffled as packed runs (``_runs``), a row for each range of hashes and million of n-grams or so.

Null texts are empty: they have the end alone. Null doc_ids train and aren't held out. Repeated rows count, and are
returned, each. An empty table gives no rows. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bits import BITS, BLOCK, bitmap, has
from ._runs import PART, from_gaps, gaps, pack, part_of, spans, unpack
from ._shared import drop_stage, in_arrow, stage
from ._text import Slice, slices

#: Distinct keys that a task gathers before it gives them out.
GATHERED = 2_000_000
#: Hashes of a text's start and end.
START, END = np.int64(0x5BD1E9955BD1E995), np.int64(0x1B8735939E3779B9)
#: Rows of a level up to which it is broadcast; beyond, joins with it are shuffled.
ROWS = 100_000


class Counter:
    """Counts of 64-bit keys, merged batch after batch."""

    def __init__(self) -> None:
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        """``keys`` are ascending and distinct."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        self.n[at[known]] += n[known]
        self.keys, self.n = np.insert(self.keys, at[~known], keys[~known]), np.insert(self.n, at[~known], n[~known])

    def out(self) -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(self.keys), pa.array(self.n)], ["key", "n"])
        self.__init__()
        return b


def _words(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    part = part.lower()
    starts, ends = part.words()
    return part.hashes(starts, ends).view(np.int64), part.owner(starts)


def word_counts(texts: DataFrame) -> DataFrame:
    """key, a word's hash, and n, its count in all of ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for b in batches:
            for part in slices(b.column("text")):
                found.add(*np.unique(_words(part)[0], return_counts=True))
                if len(found.keys) > GATHERED:
                    yield found.out()
        yield found.out()

    return texts.select("text").transform(in_arrow, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _find(table: np.ndarray, keys: np.ndarray, ok: np.ndarray | None = None) -> np.ndarray:
    """The place of each key in an ascending table, -1 where it has none or isn't ``ok``."""
    out = np.full(len(keys), -1, np.int64)
    which = np.arange(len(keys)) if ok is None else np.flatnonzero(ok)
    if len(table) and len(which):
        at = np.minimum(np.searchsorted(table, keys[which]), len(table) - 1)
        hit = table[at] == keys[which]
        out[which[hit]] = at[hit]
    return out


def _alike(key: np.ndarray, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys, of one owner, stand together, and where in it each run of them begins.

    One unstable sort of single numbers. With an owner these are its number and most bits of the key: a key may then have several
    runs, where another one is equal in these bits, but no run holds two.
    """
    if owner is None:
        order = np.argsort(key)
    elif len(owner) and owner.max() >= 1 << 16:
        order = np.lexsort((key, owner))
    else:
        order = np.argsort(owner.astype(np.uint64) << np.uint64(48) | key.view(np.uint64) >> np.uint64(16))
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    if owner is not None:
        new[1:] |= owner[order[1:]] != owner[order[:-1]]
    return order, np.flatnonzero(new)


def _rotl(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = seed + np.uint64(0x27D4EB2F165667C5 + 8)
    h = h ^ (_rotl(x * np.uint64(0xC2B2AE3D27D4EB4F), 31) * np.uint64(0x9E3779B185EBCA87))
    h = _rotl(h, 27) * np.uint64(0x9E3779B185EBCA87) + np.uint64(0x85EBCA77C2B2AE63)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return h ^ (h >> np.uint64(32))


def pair_keys(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Spark's xxhash64(context, suffix): the key of an n-gram, from those of its two parts."""
    seed = _hash_long(context.view(np.uint64), np.full(len(context), 42, np.uint64))
    return _hash_long(suffix.view(np.uint64), seed).view(np.int64)


def _levels(part: Slice, most: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The text of each symbol, start and end included; then of each length up to ``most`` the keys of the n-grams that end there, and whether there is one."""
    h, doc = _words(part)
    n = np.bincount(doc, minlength=part.n)
    first = np.cumsum(n + 2) - (n + 2)
    owner = np.repeat(np.arange(part.n), n + 2)
    symbol = np.empty(len(owner), np.int64)
    symbol[np.arange(len(h)) + 2 * doc + 1] = h
    symbol[first], symbol[first + n + 1] = START, END
    keys, ok = [symbol], [np.ones(len(owner), bool)]
    inside = np.ones(len(owner), bool)
    inside[first] = False  # the start has nothing before it
    for _ in range(most - 1):
        keys.append(np.concatenate((keys[-1][:1], pair_keys(keys[-1][:-1], keys[-1][1:]))))
        ok.append(inside & ok[-1] & np.concatenate(([False], ok[-1][:-1])))
    return owner, keys, ok


class Grams:
    """n-grams of a task: key, context, suffix and count, added up whenever there are many."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, *part: np.ndarray) -> None:
        self.parts.append(part)
        self.held += len(part[0])
        if self.held > GATHERED:
            self.add_up()

    def add_up(self) -> None:
        key, ctx, suf, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order, first = _alike(key)
        at = order[first]
        self.parts = [(key[at], ctx[at], suf[at], np.add.reduceat(n[order], first))]
        self.held = len(at)

    def out(self, n_parts: int) -> pa.RecordBatch:
        """A run for each range of keys: contexts and their numbers of successors, then the successors, each named once, and counts."""
        self.add_up()
        key, ctx, suf, n = self.parts[0]
        self.__init__()
        part = part_of(key, n_parts)
        order = np.argsort(part.astype(np.uint64) << np.uint64(48) | ctx.view(np.uint64) >> np.uint64(16)) if n_parts <= 1 << 16 else np.lexsort((ctx, part))
        parts, data = [], []
        for k, at in spans(part[order]):
            which = order[at]
            own = ctx[which]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            names, index = np.unique(suf[which].view(np.uint64), return_inverse=True)
            parts.append(k)
            data.append(pack(gaps(own[first]), np.diff(np.append(first, len(own))).astype("<u4"), gaps(names), index.astype("<u4"), n[which]))
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

    def add_run(self, data: bytes) -> None:
        own, runs, names, index, n = unpack(data, "<u8", "<u4", "<u8", "<u4", "<i8")
        ctx, suf = np.repeat(from_gaps(own), runs), from_gaps(names)[index]
        self.parts.append((pair_keys(ctx, suf), ctx, suf, n))


def _eligible_counts(texts: DataFrame, known: Broadcast, length: int, least_n: int, n_parts: int) -> DataFrame:
    """ctx, suf and n, from ``least_n`` on, of n-grams of a length, of all whose context and suffix are in the bitmap.

    A task adds up its own first. ``n_parts`` ranges of keys are added up each by a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, found = known.value, Grams()
        for b in batches:
            for part in slices(b.column("text")):
                _, keys, ok = _levels(part, length - 1)
                below, fits = keys[-1], ok[-1] & has(bits, keys[-1])
                at = np.flatnonzero(fits[:-1] & fits[1:] & (keys[0][1:] != START)) + 1
                if len(at):
                    key = pair_keys(below[at - 1], below[at])
                    order, first = _alike(key)
                    one = order[first]
                    found.add(key[one], below[at[one] - 1], below[at[one]], np.diff(np.append(first, len(order))))
                if found.held > GATHERED // 2:
                    yield found.out(n_parts)
        if found.held:
            yield found.out(n_parts)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Grams()
        for b in batches:
            for data in b.column("data"):
                found.add_run(data.as_py())
        if found.parts:
            found.add_up()
            _, ctx, suf, n = found.parts[0]
            at = n >= least_n
            yield pa.RecordBatch.from_arrays([pa.array(ctx[at]), pa.array(suf[at]), pa.array(n[at])], ["ctx", "suf", "n"])

    runs = texts.select("text").transform(in_arrow, run, "part int, data binary").repartitionById(n_parts, F.col("part"))
    return runs.select("data").transform(in_arrow, add_up, "ctx long, suf long, n long")


def _bits(keys: DataFrame) -> int:
    """Bits of a bitmap of ``keys``: 32 a key or so, up to the bitmap's bound."""
    return min(BITS, max(BLOCK, 1 << (32 * keys.count()).bit_length()))


def _ranges(spark: SparkSession, tokens: int) -> int:
    """How many ranges keys are dealt into: a task holds one, and an n-gram has a token."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // PART))


def _small(df: DataFrame) -> DataFrame:
    """A staged table, with a broadcast hint if it has few rows."""
    return F.broadcast(df) if df.count() <= ROWS else df


def values(texts: DataFrame, counts: DataFrame, ends: int, scale: float, depth: int = 3, least_n: int = 4, strength: float = 4.0) -> DataFrame:
    """The tree as a table: key, n and value of each n-gram that adds something to the root's log10 probability.

    counts: key and n of the words of ``texts``.
    """
    spark = texts.sparkSession
    n_parts = _ranges(spark, counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + ends)
    marks = spark.createDataFrame([(int(START), ends), (int(END), ends)], "key long, n long")
    words = counts.where(F.col("n") >= least_n).unionByName(marks.where("n > 0"))
    levels, contexts = [stage(words.select("key", "n", ((F.col("n") + 0.5) / F.lit(scale)).alias("p")), "tree-words")], []
    for length in range(2, depth + 2):
        below = levels[-1]
        sent = spark.sparkContext.broadcast(bitmap(below, _bits(below)))
        found = stage(_eligible_counts(texts, sent, length, least_n, n_parts), "tree-counts")
        sent.destroy()
        below = _small(below)
        n, c, above = F.col("n"), F.col("c"), F.col("above")
        grams = found.join(below.select(F.col("key").alias("ctx"), F.col("n").alias("c")), "ctx").join(below.select(F.col("key").alias("suf"), F.col("p").alias("above")), "suf")
        grams = grams.select("ctx", "suf", "n", "c", "above", ((n + strength * above) / (c + strength)).alias("p"))
        grams = stage(grams, "tree-grams").withColumn("key", F.xxhash64("ctx", "suf"))
        drop_stage(found)
        sums = grams.groupBy("ctx").agg(F.max("c").alias("c"), F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("above").alias("above"), F.count("*").alias("kinds"), F.sum(n * F.log(n / c / above)).alias("gain"))
        other, left_above = F.greatest(c - n, F.lit(0)), F.greatest(1 - above, F.lit(1e-12))
        ratio = 2 * (F.col("gain") + F.when(other > 0, other * F.log(other / c / left_above)).otherwise(0.0))
        kinds = F.col("kinds")
        rest = F.log10(F.greatest(1 - F.col("p"), F.lit(1e-12)) / left_above)
        contexts.append(stage(sums.select("ctx", "c", rest.alias("rest"), (ratio >= kinds + 4 * F.sqrt(2 * kinds) + 10).alias("own")), "tree-contexts"))
        levels.append(grams)

    out, needed, staged = [], None, []
    for at in range(depth - 1, -1, -1):
        kept = contexts[at].where("own").select("ctx")
        kept = kept if needed is None else kept.unionByName(needed).distinct()
        kept = stage(contexts[at].join(kept, "ctx", "left_semi").select("ctx", "c", "rest"), "tree-kept")
        staged.append(kept)
        if at:  # the parents of what is kept
            needed = _small(kept).join(levels[at].select(F.col("key").alias("ctx"), "suf"), "ctx").select(F.col("suf").alias("ctx")).distinct()
        out.append(kept.select(F.col("ctx").alias("key"), F.col("c").alias("n"), F.col("rest").alias("value")))
        own = levels[at + 1].drop("c").join(_small(kept.select("ctx", "rest")), "ctx")
        out.append(own.select("key", "n", (F.log10(F.col("p") / F.col("above")) - F.col("rest")).alias("value")))
    both = out[0]
    for x in out[1:]:
        both = both.unionByName(x)
    both = stage(both.groupBy("key").agg(F.max("n").alias("n"), F.sum("value").alias("value")), "tree-values")
    for x in (*levels, *contexts, *staged):
        drop_stage(x)
    return both


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows from some power of two on, the least such that there are at most ``most``: nothing is sorted for it."""
    levels = {r["b"]: r["n"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()}  # at most 63 rows
    total, least = 0, 63
    while least > 0 and total + levels.get(least - 1, 0) <= most:
        least -= 1
        total += levels.get(least, 0)
    return counts.where(F.col("n") >= F.lit(1 << least))


#: What a row holds: a range of the table, the keys that a group of texts looks up in it, what they add, or the texts' own rows.
TABLE, ASKED, ADDED, TEXTS = range(4)
#: Texts of a group, at most, and keys from which on it is given out.
GROUP, ASKS = 1 << 16, 1 << 20
RUNS = "part int, group long, kind byte, data binary"


def _rows(*rows: tuple[int, int, int, bytes]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = (pa.int32(), pa.int64(), pa.int8(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "group", "kind", "data"])


def _table_runs(table: DataFrame, n_parts: int) -> DataFrame:
    """The table's rows, dealt into ranges of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            held.clear()
            key, base, value = (t.column(c).to_numpy() for c in ("key", "base", "value"))
            order = np.argsort(key.view(np.uint64))
            return _rows(*((k, -1, TABLE, pack(gaps(key[order[at]]), base[order[at]].astype("<f8"), value[order[at]])) for k, at in spans(part_of(key[order], n_parts))))

        for b in batches:
            held.append(b)
            if sum(map(len, held)) > GATHERED // 4:
                yield out()
        if held:
            yield out()

    return table.select("key", "base", "value").transform(in_arrow, run, RUNS)


class Group:
    """Texts of a task: their rows, sums over what the task knows, and the keys that must be looked up."""

    def __init__(self) -> None:
        self.n, self.held, self.texts, self.keys, self.owners = 0, 0, [], [], []

    def out(self, number: int, n_parts: int) -> pa.RecordBatch:
        """A run of keys and the texts that ask for them for each range, and one of the texts."""
        rows = [(number % n_parts, number, TEXTS, pack(*(np.concatenate(x) for x in zip(*self.texts, strict=True))))]
        if self.held:
            key, owner = np.concatenate(self.keys), np.concatenate(self.owners)
            order = np.argsort(key.view(np.uint64))
            key, owner = key[order], owner[order]
            rows += [(k, number, ASKED, pack(gaps(key[at]), owner[at])) for k, at in spans(part_of(key, n_parts))]
        self.__init__()
        return _rows(*rows)


def _text_runs(docs: DataFrame, table: DataFrame, common: int, most: int, missing: float, n_parts: int) -> DataFrame:
    """Groups of ``docs`` (doc_id, text), and the keys that each must look up."""
    top = _most_frequent(table, common).select("key", "base", "value").toArrow().sort_by("key")  # at most `common` rows of 24 bytes
    key, base, value = (top.column(c).to_numpy().astype(t) for c, t in (("key", np.int64), ("base", float), ("value", float)))
    sent = docs.sparkSession.sparkContext.broadcast((key, base, value, bitmap(table, _bits(table))))
    del top, key, base, value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base, value, bits = sent.value
        is_word = ~np.isnan(base)
        base = np.nan_to_num(base)
        group, number = Group(), TaskContext.get().partitionId() << 32
        for b in batches:
            ids = b.column("doc_id")
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            for part in slices(b.column("text")):
                if group.n and (group.n + part.n > GROUP or group.held > ASKS):
                    yield group.out(number, n_parts)
                    number += 1
                owner, keys, ok = _levels(part, most)
                sums = np.zeros((3, part.n))
                for length, (k, fits) in enumerate(zip(keys, ok, strict=True)):
                    at = np.flatnonzero(fits & has(bits, k))
                    place = _find(known, k[at])
                    found = place >= 0
                    hit, place = owner[at[found]], place[found]
                    for total, worth in zip(sums, (base, value, is_word), strict=True):
                        total += np.bincount(hit, weights=worth[place], minlength=part.n)
                    if not length:  # words that aren't known count as missing; those the table has add the rest there
                        unknown = k != START
                        unknown[at[found]] = False
                        sums[0] += missing * np.bincount(owner[unknown], minlength=part.n)
                    at = at[~found]
                    group.keys.append(k[at])
                    group.owners.append((owner[at] + group.n).astype("<u2"))
                    group.held += len(at)
                at = slice(part.lo, part.hi)
                group.texts.append((ids[at], null[at].astype("u1"), np.bincount(owner, minlength=part.n) - 1, *sums))
                group.n += part.n
        if group.n:
            yield group.out(number, n_parts)

    return docs.select("doc_id", "text").transform(in_arrow, run, RUNS)


def _look_up(runs: DataFrame, missing: float, n_parts: int) -> DataFrame:
    """What the table adds to the texts of each group: a task has one range of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked = [], []
        for b in batches:
            for row in b.to_pylist():
                if row["kind"] == TEXTS:
                    yield _rows((0, row["group"], TEXTS, row["data"]))
                elif row["kind"] == TABLE:
                    held.append(unpack(row["data"], "<u8", "<f8", "<f8"))
                else:
                    asked.append((row["group"], row["data"]))
        if not held:
            return
        key = np.concatenate([from_gaps(x[0]) for x in held])
        base, value = (np.concatenate([x[i] for x in held]) for i in (1, 2))
        held.clear()
        order = np.argsort(key)
        key, base, value = key[order], base[order], value[order]
        is_word = ~np.isnan(base)
        base = np.where(is_word, base - missing, 0.0)
        for group, data in asked:
            asks, owner = unpack(data, "<u8", "<u2")
            place = _find(key, from_gaps(asks))
            owner, place = owner[place >= 0], place[place >= 0]
            texts = np.flatnonzero(np.bincount(owner))
            if len(texts):
                sums = [np.bincount(owner, weights=worth[place])[texts] for worth in (base, value, is_word)]
                yield _rows((0, group, ADDED, pack(texts.astype("<u2"), *sums)))

    return runs.repartitionById(n_parts, F.col("part")).transform(in_arrow, run, RUNS)


def _add_up(runs: DataFrame, n_parts: int) -> DataFrame:
    """A row for each text, with all sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, added = {}, {}
        for b in batches:
            for row in b.to_pylist():
                if row["kind"] == TEXTS:
                    texts[row["group"]] = unpack(row["data"], "<i8", "u1", "<i8", "<f8", "<f8", "<f8")
                    continue
                at, *sums = unpack(row["data"], "<u2", "<f8", "<f8", "<f8")
                total = added.setdefault(row["group"], np.zeros((3, GROUP)))
                for x, y in zip(total, sums, strict=True):
                    x[at] += y
        if added.keys() - texts.keys():
            raise ValueError("sums of texts that aren't there")
        for group, (ids, null, size, *sums) in texts.items():
            if group in added:
                sums = [x + y[: len(ids)] for x, y in zip(sums, added.pop(group), strict=True)]
            base, value, known = sums
            cols = [pa.array(ids, mask=null == 1), pa.array(size), pa.array(np.round(known).astype(np.int64)), pa.array(base), pa.array(value)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "n_known", "base", "value"])

    return runs.select("group", "kind", "data").repartition(n_parts, "group").transform(in_arrow, run, "doc_id long, n_tokens long, n_known long, base double, value double")


def score_texts(docs: DataFrame, train, common: int = 1 << 20, depth: int = 3, least_n: int = 4) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``.

    ``train`` is a condition on doc_id that says which rows to learn from. base_score is the root's alone.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    train = F.coalesce(train, F.lit(True))
    learnt = docs.where(train)
    counts = stage(word_counts(learnt), "word-counts")
    ends = learnt.select("doc_id").count()
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, kinds = int(total) + ends, int(kinds) + (ends > 0)
    scale = total + 0.5 * (kinds + 1)
    tree = values(learnt, counts, ends, scale, depth, least_n)

    # one table: of words the root's log10 probability, of n-grams (words as contexts too) what states add
    words = counts.unionByName(spark.createDataFrame([(int(END), ends)], "key long, n long").where("n > 0"))
    words = words.select("key", "n", F.log10((F.col("n") + 0.5) / F.lit(scale)).alias("base"), F.lit(0.0).alias("value"))
    both = words.unionByName(tree.select("key", "n", F.lit(None).cast("double").alias("base"), "value"))
    table = stage(both.groupBy("key").agg(F.max("n").alias("n"), F.max("base").alias("base"), F.sum("value").alias("value")), "root-and-tree")
    drop_stage(tree, counts)

    missing = float(np.log10(0.5 / scale))
    n_parts = _ranges(spark, total)
    runs = _table_runs(table, n_parts).unionByName(_text_runs(docs, table, common, depth + 1, missing, n_parts))
    each = runs.transform(_look_up, missing, n_parts).transform(_add_up, n_parts)
    return each.select("doc_id", (~train).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("base") + F.col("value")).alias("score"))

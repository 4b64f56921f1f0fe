"""Document fingerprints (operator 13): one-permutation MinHash of word shingles, in DataFrame functions alone.

A text's words (`[^\\x20\\x09-\\x0D]+`, A-Z in lower case) give its 5-word shingles; a text of fewer words, or none, has one
shingle, its whole sequence. Each shingle is hashed once, to 64 bits: the top 8 say its bin, one of 256, and each bin keeps its
smallest hash. An empty bin takes that of another by optimal densification: bin i tries the bins h(i, 1), h(i, 2), ... until one
isn't empty. Where ``PROBES`` tries all fail, as in texts of few shingles, bin i takes the bin that comes first in an order of
its own, r(i, j); so each bin is filled, by a rule that is the same for all texts. What is taken is hashed with i, or else two
texts of one shingle each would agree in all bins or in none. A fingerprint is the low 4 bits of each bin, packed, 128 bytes:
equal texts have equal ones.

Two fingerprints' likeness estimates their shingle sets' Jaccard similarity. Of bins whose smallest hashes differ, one in 16
agrees in 4 bits all the same, so of a share m of equal bins the likeness is (m - 1/16) / (1 - 1/16), 0 at least.

All stays within a document's row, with no explode: the hashes and one marker for each bin are sorted as one array, so a bin's
smallest is the first of its run, and a bin whose first is its marker was empty.

``followed`` gives each document the next one's text. Texts are shuffled once, by ranges of doc_id, and each range also gets
the head of the range after it; a range is cut by hash where one id holds it. Ids are descending and null ids come last; rows
of one id are in descending order of their text's hash, then of their text; equal rows follow each other. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH, BINS, BITS, PROBES = 5, 256, 4, 16
#: Ranges of doc_id at most, and cuts of a range that one id holds.
RANGES, CUTS = 10_000, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_REST = (1 << 56) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """The 64-bit hashes of a text's shingles, repeated ones too."""
    words = F.filter(F.split(F.translate(text, _UPPER, _LOWER), "[ \\t-\\r]+"), lambda w: w != "")

    def of(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[h[i + k] for k in range(width)]))
        return F.when(F.size(h) >= width, each).otherwise(F.array(F.xxhash64(h)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _bin(h: Column) -> Column:
    return F.shiftright(h, 56).cast("int") + BINS // 2


def fingerprint(text: Column) -> Column:
    """A text's packed fingerprint, binary."""
    markers = F.array(*[F.lit(((i - BINS // 2) << 56) | _REST).cast("long") for i in range(BINS)])
    low = lambda v: v.bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))

    def least(h: Column) -> Column:
        """The smallest hash of each bin, in order; null in an empty one."""
        first = F.filter(h, lambda v, i: (i == 0) | (F.shiftright(v, 56) != F.shiftright(h[F.greatest(i - 1, F.lit(0))], 56)))
        return F.transform(first, lambda v: F.when(v.bitwiseAND(F.lit(_REST)) != _REST, v))

    def filled(bins: Column, full: Column) -> Column:
        order = lambda i, v: F.xxhash64(i, _bin(v)).bitwiseAND(F.lit(-(1 << BITS)).cast("long"))
        other = lambda i: F.array_min(F.transform(full, lambda v: order(i, v).bitwiseOR(low(F.xxhash64(v, i)))))
        tries = lambda i: F.coalesce(*[bins[F.xxhash64(i, F.lit(t)).bitwiseAND(F.lit(BINS - 1).cast("long")).cast("int")] for t in range(1, PROBES + 1)])
        return F.transform(bins, lambda v, i: low(F.coalesce(v, let(tries(i), lambda t: F.when(t.isNotNull(), F.xxhash64(t, i))), other(i))))

    packed = lambda v: F.unhex(F.array_join(F.transform(v, lambda x: F.hex(x)), ""))
    sorted_hashes = F.sort_array(F.concat(shingle_hashes(text), markers))
    return let(let(sorted_hashes, least), lambda bins: let(F.filter(bins, lambda v: v.isNotNull()), lambda full: packed(filled(bins, full))))


def likeness(a: Column, b: Column) -> Column:
    """The bias-corrected estimate, from 0 to 1, of the similarity of two fingerprints."""
    piece = lambda c, k: F.conv(F.substring(F.hex(c), k * 8 + 1, F.lit(8)), 16, 10).cast("long")

    def unequal(k: Column) -> Column:
        """How many of eight digits differ: the bits of each are folded into its lowest."""
        return let(piece(a, k).bitwiseXOR(piece(b, k)), lambda x: F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3)).bitwiseAND(F.lit(0x11111111).cast("long"))))

    differ = F.aggregate(F.sequence(F.lit(0), F.lit(BINS * BITS // 32 - 1)), F.lit(0), lambda n, k: n + unequal(k))
    equal = F.lit(BINS) - differ
    chance = 2.0**-BITS
    return F.greatest((equal / F.lit(BINS) - chance) / (1 - chance), F.lit(0.0))


def _ranges(docs: DataFrame, n: int) -> Column:
    """The range of a row (doc_id, h): a number that falls with the order of rows. Null ids are the lowest ranges."""
    marks = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else None
    marks = sorted(set(marks or []))
    cut = F.shiftright("h", 58).cast("int") + CUTS // 2
    if not marks:
        return F.when(F.col("doc_id").isNull(), cut - CUTS).otherwise(F.lit(0))
    side = int(len(marks) ** 0.5) + 1
    blocks = [marks[i : i + side] for i in range(0, len(marks), side)]
    below = lambda a: F.size(F.filter(a, lambda m: m < F.col("doc_id")))
    numbers = lambda x: F.array(*[F.lit(int(m)).cast("long") for m in x])
    block = F.greatest(below(numbers([b[0] for b in blocks])) - 1, F.lit(0))
    inner = F.array(*[numbers(b) for b in blocks])

    def place(k: Column) -> Column:
        return let(k * side + below(inner[k]), lambda p: (2 * p + hit(p)) * CUTS + hit(p) * cut)

    # an id that is a mark may hold many rows: it has a range of its own, cut by hash
    hit = lambda p: F.when(F.get(numbers(marks), p) == F.col("doc_id"), 1).otherwise(0)
    return F.when(F.col("doc_id").isNull(), cut - CUTS).otherwise(let(block, place))


def followed(docs: DataFrame, make: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, text, made, next_text, next_made) of each row of ``docs`` (doc_id, text); made is ``make`` of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n = min(RANGES, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("part", _ranges(rows, n))
    heads = rows.groupBy("part").agg(F.max(F.struct("doc_id", "h")).alias("head"))
    # one row of at most one entry a range: each range gets the head of the one below, the lowest that of the highest
    ring = heads.agg(F.sort_array(F.collect_list(F.struct("part", "head"))).alias("a")).where(F.size("a") > 0)
    after = F.transform("a", lambda x, i: F.struct(x["part"].alias("part"), F.element_at("a", F.when(i == 0, F.size("a")).otherwise(i))["head"].alias("head")))
    after = ring.select(F.explode(after).alias("e")).select(F.col("e.part").alias("to"), F.col("e.head.doc_id").alias("id"), F.col("e.head.h").alias("hash"))
    guests = rows.join(F.broadcast(after), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hash")))
    guests = guests.groupBy("to").agg(F.max("text").alias("text")).join(F.broadcast(after), "to").select(F.col("id").alias("doc_id"), "text", F.col("hash").alias("h"), F.col("to").alias("part"), F.lit(True).alias("guest"))
    both = rows.withColumn("guest", F.lit(False)).unionByName(guests).withColumn("made", make(F.col("text")))
    order = Window.partitionBy("part").orderBy("guest", F.desc("doc_id"), F.desc("h"), F.desc("text"))
    both = both.withColumn("next", F.lead(F.struct("text", "made")).over(order))
    return both.where("NOT guest").select("doc_id", "text", "made", F.col("next.text").alias("next_text"), F.col("next.made").alias("next_made"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many, or all, of the following one."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): its fingerprint, that of its edited text, and how near it is to both neighbours.

    doc_id, n_chars (code points), edited_sha256, fingerprint and edited_fingerprint (hexadecimal, a digit a bin), near_edited and near_next.
    """
    rows = followed(docs, fingerprint).withColumn("edit", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"), "made", "next_made", fingerprint(F.col("edit")).alias("edit_made"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("made")).alias("fingerprint"),
        F.lower(F.hex("edit_made")).alias("edited_fingerprint"),
        likeness(F.col("made"), F.col("edit_made")).alias("near_edited"),
        likeness(F.col("made"), F.col("next_made")).alias("near_next"),
    )

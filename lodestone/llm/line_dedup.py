"""Line dedup (operator 8), native: a deletion-neighbourhood join of lines within one edit, and the earliest stays.

A line is trimmed of spaces, tabs and carriage returns; blank lines stay and take no part. A line goes if an earlier one (by
document, then place) is equal, or within one insertion, deletion or substitution of a character. Whether the earlier line goes
too makes no difference. That holds for lines of any length: of two lines of one character, the later goes.

Equal lines are grouped by a 128-bit digest, with partial sums, so a line of many copies costs a row a task. Distinct
lines then emit their variants with a character deleted, as hashed keys:

- Lines a substitution apart give equal variants when the same place is deleted. Place and variant make the key; all lines
  of a key are within one edit of each other.
- A line and one with a character more: the longer line's variant equals the shorter line, itself a key.

So a key's group is never expanded into pairs: each line needs only the earliest line of its groups, an aggregation with
partial results, joined back by key, which Spark can split where a key has very many lines. That line's text is then fetched
and the edit distance verified.

Variants are emitted only where there can be a partner. A line is seen as ``PIECES`` pieces; one edit leaves all but one
of them as they are. Lines first give a key for each piece, of what is outside of it, and only those with a key in common
with another line go on, with deletions in that piece alone. That loses no pair.

Everything is DataFrame expressions. Null texts have no lines and stay null; ties by equal doc_id are broken by text, and
wholly equal rows are one document. Null doc_ids come last. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stage

PIECES = 4
#: Digests or keys, 16 bytes each at most, up to which a selection of lines is broadcast; beyond, it is a shuffled join.
IDS = 1_000_000
#: The same for rows with three lines' places.
FIRSTS = 100_000


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row (a key of the document), line_no from 0, line (trimmed) of all lines; blank ones too."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return rows.select("doc_id", "row", "line_no", "raw", F.trim(F.col("raw"), F.lit(" \t\r")).alias("line"))


def _place() -> Column:
    """Order of lines: by document, nulls last, then place."""
    return F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row", "line_no")


def _outside(n: Column, skip: int) -> Column:
    """For lines seen as ones of n characters: a key for each piece of what lies outside; ``skip`` more characters lie in the piece."""
    at = lambda j: F.floor(n * j / PIECES).cast("int")
    keys = [F.struct(F.lit(j).alias("piece"), F.xxhash64(F.lit(j), n, F.expr("line").substr(F.lit(1), at(j)), F.expr("line").substr(at(j + 1) + 1 + skip, n)).alias("key")) for j in range(PIECES)]
    return F.array(*keys)


def _few(rows: DataFrame, name: str, most: int = IDS) -> DataFrame:
    """Staged, and broadcast where a count says that it is small."""
    rows = stage(rows, name)
    return F.broadcast(rows) if rows.count() <= most else rows


def near_lines(lines: DataFrame) -> DataFrame:
    """h and other: distinct lines (h, line, place) with an earlier one within one edit, and that one's h."""
    n = F.char_length("line")
    # role 0: as the shorter or equal line; role 1: as one of a character more than n
    keyed = lines.select("h", F.explode(F.array(F.struct(F.lit(0).alias("role"), n.alias("n"), _outside(n, 0).alias("keys")), F.struct(F.lit(1).alias("role"), (n - 1).alias("n"), _outside(n - 1, 1).alias("keys")))).alias("x"))
    keyed = keyed.select("h", "x.role", "x.n", F.explode("x.keys").alias("k")).select("h", "role", "n", "k.*")
    id_of = F.xxhash64("h")
    met = keyed.groupBy("key").agg(F.min(id_of).alias("least"), F.max(id_of).alias("most")).where("least <> most").select("key")
    shared = stage(keyed.join(_few(met, "line-keys"), "key", "left_semi").select("h", "role", "n", "piece"), "line-pieces")

    some = _few(shared.select("h").distinct(), "near-ids")
    texts = stage(lines.join(some, "h", "left_semi"), "near-lines")
    lo, hi = F.floor(F.col("n") * F.col("piece") / PIECES).cast("int"), F.floor(F.col("n") * (F.col("piece") + 1) / PIECES).cast("int")
    # places, from 1, that are deleted: in role 0 those of the piece, in role 1 one more
    first, last = lo + 1, hi + F.col("role")
    cut = lambda i: F.concat(F.col("line").substr(F.lit(1), i - 1), F.col("line").substr(i + 1, F.col("n") + 1))
    places = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    spread = texts.join(shared, "h")
    swaps = spread.where("role = 0").select("h", "place", F.explode(F.transform(places, lambda i: F.xxhash64(i, cut(i)))).alias("key"), F.lit(0).alias("side"))
    longer = spread.where("role = 1").select("h", "place", F.explode(F.transform(places, lambda i: F.xxhash64(F.lit(0), cut(i)))).alias("key"), F.lit(1).alias("side"))
    itself = texts.select("h", "place", F.xxhash64(F.lit(0), F.col("line")).alias("key"), F.lit(2).alias("side"))
    rows = swaps.unionByName(longer).unionByName(itself)
    mine = F.struct("place", "h")
    earliest = lambda side: F.min(F.when(F.col("side") == side, mine)).alias(f"m{side}")
    first = rows.groupBy("key").agg(F.count("*").alias("lines"), earliest(0), earliest(1), earliest(2)).where("lines > 1").drop("lines")
    best = rows.join(_few(first, "line-firsts", FIRSTS), "key")
    # of one key: swaps are within one edit of each other; a longer line of the shorter one, and the other way round
    best = best.select("h", "place", F.when(F.col("side") == 0, F.col("m0")).when(F.col("side") == 1, F.col("m2")).otherwise(F.col("m1")).alias("m"))
    best = best.where((F.col("m.h") != F.col("h")) & (F.col("m.place") < F.col("place"))).groupBy("h").agg(F.min("m").alias("m")).select("h", F.col("m.h").alias("other"))
    own = texts.select("h", F.col("line").alias("a"))
    theirs = texts.select(F.col("h").alias("other"), F.col("line").alias("b"))
    return best.join(own, "h").join(theirs, "other").where(F.levenshtein("a", "b", 1) >= 0).select("h", "other")


def kept_lines(docs: DataFrame) -> DataFrame:
    """row and line_no of the lines that stay, blank ones aside."""
    lines = split_lines(docs).where("line <> ''").select(F.unhex(F.md5(F.col("line").cast("binary"))).alias("h"), "line", _place().alias("place"))
    # a rank of one is cut in each task before the shuffle, so a line of many copies is a row a task there
    nth = F.row_number().over(Window.partitionBy("h").orderBy("place"))
    distinct = stage(lines.withColumn("nth", nth).where("nth = 1").select("h", "line", "place"), "distinct-lines")
    near = near_lines(distinct).select("h")
    return distinct.select("h", "place").join(near, "h", "left_anti").select(F.col("place.row").alias("row"), F.col("place.line_no").alias("line_no"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with the text of the lines that stay, and n_lines and n_kept, of lines that aren't blank.

    Columns of these two names are replaced.
    """
    docs = docs.drop("n_lines", "n_kept")
    places = stage(kept_lines(docs).groupBy("row").agg(F.collect_list("line_no").alias("__kept")), "kept-lines")
    rows = docs.withColumn("__row", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    rows = rows.join(places.withColumnRenamed("row", "__row"), "__row", "left")
    rows = rows.withColumn("__lines", F.split("text", "\n"))
    blank = F.filter(F.transform(F.col("__lines"), lambda x, i: F.when(F.trim(x, F.lit(" \t\r")) == "", i)), lambda i: i.isNotNull())
    rows = rows.withColumn("__blank", blank).withColumn("__all", F.array_sort(F.concat("__blank", F.coalesce("__kept", F.array().cast("array<int>")))))
    text = F.array_join(F.transform("__all", lambda i: F.col("__lines")[i]), "\n")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    out = rows.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(size(F.col("__lines")) - size(F.col("__blank"))).cast("long"))
    out = out.withColumn("n_kept", F.when(F.col("__kept").isNull(), 0).otherwise(F.size("__kept")).cast("long"))
    return out.withColumn("text", text).select(*docs.columns, "n_lines", "n_kept")

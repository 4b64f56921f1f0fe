"""N-gram Jaccard join (operator 3) over sets of word shingles, by PartEnum signatures.

Texts with the same set of shingles are one class. Classes that share a signature are candidates (see ``partenum``).
No group is expanded into all its pairs:

1. Each signature's group is linked to its most central member, the one whose signatures are the most frequent, as a
   group of copies is to its original. Verified links make components; pairs within one are links already implied.
2. In groups that hold several components still, members of different ones are compared, in blocks, by array arithmetic.
   Each component of a block gives the likeliest pair with another one, and these are verified: one link joins two
   components. That is done ``ROUNDS`` times, with ``FEW`` signatures of each class, as it need not find all.
3. Pairs that may link and are apart still, all of them, are verified: first found are those with one of the ``FEW`` in
   common, then in all groups those without, so that a pair isn't found once for each of its signatures.

Whether a pair may link is told by odd sketches: a differing shingle flips one bit, so more bits that differ than shingles
may differ rule a link out; what passes is verified over the sets. All steps are exact, up to equal 64-bit digests.

Short sets, which have no signatures, give single shingles in their place, as many as two linked sets can't all differ in;
all other sets give those of their shingles that are among them.

Null texts are empty. Documents without words have an empty set and link with nothing. Null doc_ids give their own rows,
link others, and have a null component where no document with an id is in it. Repeated rows link like copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bits import bitmap, has
from ._shared import drop_stage, in_arrow, stage
from ._text import U64, mix, shingles, slices
from .components import connected_components
from .partenum import fingerprints, signatures, unique_sets

#: Members of a group's block.
BLOCK = 1024
#: Rows of keys, 8 bytes each, up to which a selection of documents is broadcast; beyond, it is a shuffled join.
IDS = 2_000_000
#: Rounds of likeliest pairs, and signatures of a class in them.
ROUNDS, FEW = 2, 8
NUM, DEN = 75, 100
#: The signature under which short sets are told.
SHORT = -(2**63)


def _sets(part, width: int):
    doc, h, _ = shingles(part, width)
    h, start, size = unique_sets(doc, h, part.n)
    return h, start, size, fingerprints(h, start, size)


def _sketch(h: np.ndarray) -> bytes:
    """Parity of the shingles on each bit; two to four bits a shingle, so that halves fold onto a smaller set's sketch."""
    bits = 1 << max(6, int(len(h)).bit_length() + 1)
    odd = np.bincount((mix(h ^ U64(0x3C79AC492BA7B653)) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """A lower bound on the number of shingles that are in one of two sets alone."""
    if len(x) < len(y):
        x, y = y, x
    v, n = int.from_bytes(x, "little"), len(x)
    while n > len(y):
        n //= 2
        v = (v >> (8 * n)) ^ (v & ((1 << (8 * n)) - 1))
    return (v ^ int.from_bytes(y, "little")).bit_count()


def row_key():
    """Tells rows apart by doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def shingle_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """key and doc_id of each document, n (shingles), fp (a digest of the set; null if it is empty) and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b.column("text")):
                h, start, size, fp = _sets(part, width)
                sketch = [_sketch(h[s : s + n]) if n else None for s, n in zip(start.tolist(), size.tolist(), strict=True)]
                own = [b.column(c).slice(part.lo, part.n) for c in ("key", "doc_id")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(size), pa.array(fp, mask=size == 0), pa.array(sketch, pa.binary())], ["key", "doc_id", "n", "fp", "sketch"])

    return docs.select(row_key().alias("key"), F.col("doc_id").cast("long"), "text").transform(in_arrow, run, "key long, doc_id long, n long, fp long, sketch binary")


def _signature_rows(docs: DataFrame, width: int, coarse: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b.column("text")):
                h, start, size, fp = _sets(part, width)
                _, one = np.unique(fp, return_index=True)  # copies within a slice give the same rows
                own, sig, short = signatures(h, start[one], size[one], NUM, DEN, coarse)
                few = fp[one][short]
                out = np.concatenate((sig.view(np.int64), np.full(len(few), SHORT)))
                yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(np.concatenate((fp[one][own], few)))], ["sig", "fp"])

    return docs.select("text").transform(in_arrow, run, "sig long, fp long")


def _of(docs: DataFrame, classes: DataFrame, fps: DataFrame) -> DataFrame:
    """Texts of the classes ``fps``, from one row each."""
    keys = stage(classes.join(fps, "fp", "left_semi").select("key"), "keys")
    keys = F.broadcast(keys) if keys.count() <= IDS else keys
    return docs.select(row_key().alias("key"), "text").join(keys, "key", "left_semi").select("text")


def _short_groups(docs: DataFrame, classes: DataFrame, short: DataFrame, width: int) -> DataFrame:
    """sig and fp: the first shingles of short sets, and all other sets' shingles that are among them."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b.column("text")):
                h, start, size, fp = _sets(part, width)
                nth = np.arange(len(h)) - np.repeat(start, size)
                own = np.repeat(np.arange(part.n), size)
                keep = nth <= ((size + size * DEN // NUM) * (DEN - NUM) // (DEN + NUM))[own]
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(fp[own[keep]])], ["key", "fp"])

    found = _of(docs, classes, short).transform(in_arrow, firsts, "key long, fp long")
    found = stage(found.join(short, "fp", "left_semi").distinct(), "short-sets")
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(found))

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for b in batches:
            for part in slices(b.column("text")):
                h, _, size, fp = _sets(part, width)
                h, own = h.view(np.int64), np.repeat(np.arange(part.n), size)
                hit = has(bits, h)
                yield pa.RecordBatch.from_arrays([pa.array(h[hit]), pa.array(fp[own[hit]])], ["sig", "fp"])

    return docs.select("text").transform(in_arrow, lookup, "sig long, fp long").unionByName(found.select(F.col("key").alias("sig"), "fp"))


def _elements(texts: DataFrame, width: int) -> DataFrame:
    """fp and shingles of texts; equal texts may give a set twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b.column("text")):
                h, start, _, fp = _sets(part, width)
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.ListArray.from_arrays(pa.array(np.append(start, len(h)), pa.int32()), pa.array(h.view(np.int64)))], ["fp", "items"])

    return texts.transform(in_arrow, run, "fp long, items array<long>")


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (x, y) of classes whose sizes and sketches allow a link."""
    c = classes.select("fp", "n", "sketch")
    x = c.select(F.col("fp").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("sx"))
    y = c.select(F.col("fp").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("sy"))
    rows = pairs.join(x, "x").join(y, "y").where(f"nx * {DEN} >= ny * {NUM} AND ny * {DEN} >= nx * {NUM}").select("x", "y", "nx", "ny", "sx", "sy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            keep = [_differ(p, q) * (DEN + NUM) <= (m + n) * (DEN - NUM) for p, q, m, n in zip(d["sx"], d["sy"], d["nx"], d["ny"], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y")], ["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return rows.transform(in_arrow, run, "x long, y long")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """Of staged pairs (x, y), those that link, over their whole sets, staged."""
    fps = pairs.select(F.col("x").alias("fp")).unionByName(pairs.select(F.col("y").alias("fp"))).distinct()
    sets = stage(_elements(_of(docs, classes, fps), width).join(fps, "fp", "left_semi").groupBy("fp").agg(F.first("items").alias("items")), "sets")
    x = sets.select(F.col("fp").alias("x"), F.col("items").alias("ix"))
    y = sets.select(F.col("fp").alias("y"), F.col("items").alias("iy"))
    both = pairs.join(x, "x").join(y, "y").withColumn("both", F.size(F.array_intersect("ix", "iy")))
    links = stage(both.where(f"{DEN} * both >= {NUM} * (size(ix) + size(iy) - both)").select("x", "y"), "links")
    drop_stage(sets, pairs)
    return links


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one length, the shortest's, as rows of 64-bit words."""
    least = min(map(len, sketches))
    out = np.empty((len(sketches), least // 8), U64)
    for i, x in enumerate(sketches):
        v = np.frombuffer(x, U64)
        while v.nbytes > least:
            v = v[: len(v) // 2] ^ v[len(v) // 2 :]
        out[i] = v
    return out


def _near_in_group(fp: np.ndarray, comp: np.ndarray, n: np.ndarray, side: np.ndarray, sketches: list[bytes], few: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (places i, j) of different components whose sizes and sketches allow a link, and the bits that differ.

    side: 0 and 1, two blocks to compare with each other, or 2 alone, one block with itself. few: signatures of each, in rows;
    pairs with one in common are left out.
    """
    rows = _folded(sketches)
    for i in np.flatnonzero(side != 1):
        other = side == 1 if side[i] == 0 else np.arange(len(fp)) > i
        at = np.flatnonzero(other & (comp != comp[i]) & (n * DEN >= n[i] * NUM) & (n[i] * DEN >= n * NUM))
        if len(at):
            differ = np.bitwise_count(rows[at] ^ rows[i]).sum(1, dtype=np.int64)
            ok = differ * (DEN + NUM) <= (n[at] + n[i]) * (DEN - NUM)
            if few is not None and ok.any():
                ok[ok] = ~(few[at[ok]][:, :, None] == few[i]).any((1, 2))
            if ok.any():
                yield np.full(int(ok.sum()), i), at[ok], differ[ok]


def _likeliest(comp: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the pairs, one for each component in the block: those that differ in the fewest bits."""
    of, pair = np.concatenate((comp[i], comp[j])), np.tile(np.arange(len(d)), 2)
    order = np.lexsort((pair, d[pair], of))
    return np.unique(pair[order[np.diff(of[order], prepend=of[order[0]] - 1) != 0]])


def _pairs_apart(groups: DataFrame, comp: DataFrame, classes: DataFrame, likeliest: bool, seen: DataFrame | None = None) -> DataFrame:
    """Pairs (x, y) of ``groups`` (sig, fp) that share a signature, not a component of ``comp`` (fp, comp), and may link.

    A group is cut into blocks of about ``BLOCK`` members, and each two blocks meet in a task: pairs are compared there by
    array arithmetic. With ``likeliest`` there is no more than a row for each component of a block, and then of all. Pairs
    with a signature of ``seen`` (fp, few) in common are left out.
    """
    placed = groups.join(comp, "fp", "left").select("sig", "fp", F.coalesce("comp", "fp").alias("comp"))
    size = placed.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    rows = placed.join(size.where("c0 <> c1").select("sig", "blocks"), "sig").join(classes.select("fp", "n", "sketch"), "fp")
    skips = seen is not None
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), F.when(own == j, 2).when(own < j, 0).otherwise(1).alias("side")))
    rows = rows.withColumn("few", F.lit(None).cast("array<long>")) if seen is None else rows.join(seen, "fp")
    rows = rows.select("sig", "fp", "comp", "n", "sketch", "few", F.explode(meets).alias("b")).select("sig", "b.i", "b.j", "b.side", "fp", "comp", "n", "sketch", "few")
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "sig", "i", "j").sortWithinPartitions("sig", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            out, rest = split(t, False)
            yield out
        if rest is not None:
            yield split(rest, True)[0]

    def split(t: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
        """Pairs of the groups that end in the table, and the rows of the one that may go on."""
        key = [t.column(c).to_numpy() for c in ("sig", "i", "j")]
        new = np.ones(t.num_rows, bool)
        new[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])
        at = np.append(np.flatnonzero(new), t.num_rows)
        done = len(at) - 1 if last else len(at) - 2
        fp, comp, n, side = (t.column(c).to_numpy() for c in ("fp", "comp", "n", "side"))
        sketch, few = t.column("sketch").to_pylist(), None
        if skips:
            few = np.repeat(fp[:, None], FEW, 1)  # a class' own digest stands where it has fewer
            for i, x in enumerate(t.column("few").to_pylist()):
                few[i, : len(x)] = x
        out = [np.zeros((0, 5), np.int64)]
        for lo, hi in zip(at[:done].tolist(), at[1 : done + 1].tolist(), strict=True):
            found = list(_near_in_group(fp[lo:hi], comp[lo:hi], n[lo:hi], side[lo:hi], sketch[lo:hi], None if few is None else few[lo:hi]))
            if found:
                i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
                some = _likeliest(comp[lo:hi], i, j, d) if likeliest else slice(None)
                i, j, d = i[some] + lo, j[some] + lo, d[some]
                flip = fp[i] > fp[j]
                i, j = np.where(flip, j, i), np.where(flip, i, j)
                out.append(np.stack([fp[i], fp[j], comp[i], comp[j], d], 1))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(5)], ["x", "y", "cx", "cy", "d"]), t.slice(int(at[done]))

    pairs = rows.transform(in_arrow, run, "x long, y long, cx long, cy long, d long")
    if not likeliest:
        return pairs.select("x", "y").distinct()
    ends = F.explode(F.array("cx", "cy")).alias("comp")
    best = pairs.select(ends, "x", "y", "d").groupBy("comp").agg(F.min(F.struct("d", "x", "y")).alias("m"))
    return best.select("m.x", "m.y").distinct()


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("fp"), F.col("component").alias("comp"))


def class_links(docs: DataFrame, classes: DataFrame, width: int = 5, coarse: int = 0) -> DataFrame:
    """Links (x, y) between classes that connect all classes which the links of all pairs connect."""
    of = Window.partitionBy("sig")  # a group spills to disk where it is large
    shared = lambda rows: rows.withColumn("least", F.min("fp").over(of)).withColumn("most", F.max("fp").over(of))
    groups = stage(shared(_signature_rows(docs, width, coarse)).where(F.expr("least <> most") | (F.col("sig") == SHORT)).select("sig", "fp").distinct(), "signatures")
    short = groups.where(F.col("sig") == SHORT).select("fp")
    if short.take(1):
        more = shared(_short_groups(docs, classes, short, width)).where("least <> most").select("sig", "fp").distinct()
        groups = stage(groups.where(F.col("sig") != SHORT).unionByName(more), "signatures-and-short")

    df = groups.groupBy("sig").agg(F.count("*").alias("df"))
    found, groups = groups, stage(groups.join(df, "sig"), "groups")
    drop_stage(found)
    weight = groups.groupBy("fp").agg(F.sum("df").alias("weight"))
    lead = groups.join(weight, "fp").groupBy("sig").agg(F.max_by("fp", F.struct("weight", "fp")).alias("lead"))
    stars = groups.join(lead, "sig").where("fp <> lead").select(F.least("fp", "lead").alias("x"), F.greatest("fp", "lead").alias("y")).distinct()
    links = _verified(docs, classes, stage(_possible(stars, classes), "stars"), width)
    # a group of two is its star
    rest = stage(groups.where("df > 2").select("sig", "fp"), "larger-groups")
    drop_stage(groups)
    nth = F.row_number().over(Window.partitionBy("fp").orderBy("sig"))
    few = stage(rest.withColumn("nth", nth).where(F.col("nth") <= FEW).select("sig", "fp"), "few-signatures")
    for k in range(ROUNDS + 1):
        comp = stage(_components(links), "components-so-far")
        pairs = _pairs_apart(few, comp, classes, k < ROUNDS)
        if k == ROUNDS:
            seen = few.groupBy("fp").agg(F.collect_list("sig").alias("few"))  # at most FEW
            pairs = pairs.unionByName(_pairs_apart(rest, comp, classes, False, seen)).distinct()
        pairs = stage(pairs, "pairs")
        links = stage(links.unionByName(_verified(docs, classes, pairs, width)), "all-links")
        drop_stage(comp)
    drop_stage(rest, few)
    return links


def class_components(docs: DataFrame, width: int = 5, coarse: int = 0) -> tuple[DataFrame, DataFrame]:
    """The documents' sets, as ``shingle_sets`` gives them, and fp and comp, a digest of the component, of each class."""
    sets = stage(shingle_sets(docs, width), "shingle-sets")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")).alias("row")
    classes = sets.where("fp IS NOT NULL").groupBy("fp").agg(one, F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = stage(classes.select("fp", "row.doc_id", "row.key", "n", "sketch"), "classes")
    comp = _components(class_links(docs, classes, width, coarse))
    return sets, stage(classes.select("fp", "doc_id", "key").join(comp, "fp", "left").withColumn("comp", F.coalesce("comp", "fp")), "class-components")


def ngram_components(docs: DataFrame, width: int = 5, coarse: int = 0) -> DataFrame:
    """doc_id, n_shingles and component_id of each document: the smallest doc_id that links reach.

    ``coarse`` halves PartEnum's number of parts so many times: signatures are longer, and more sets short.
    """
    docs = docs.select("doc_id", "text")
    sets, comps = class_components(docs, width, coarse)
    label = comps.join(comps.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "comp").select("fp", "component_id")
    return sets.join(label, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row of each component, all its columns: the one with the smallest doc_id, nulls last, then by text.

    Rows without words stay all. Of wholly equal rows of doc_id and text, one stays.
    """
    sets, comps = class_components(docs.select("doc_id", "text"), width)
    best = comps.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")).alias("row")).select("row.key")
    stays = stage(best.unionByName(sets.where("fp IS NULL").select("key").distinct()), "stays")
    times = sets.where("fp IS NOT NULL").groupBy("key").count().where("count > 1").select("key")
    times = stage(times.join(stays, "key", "left_semi"), "repeated")
    small = lambda t: F.broadcast(t) if t.count() <= IDS else t
    rows = docs.withColumn("__key", row_key())
    keyed = lambda t: small(t.withColumnRenamed("key", "__key"))
    rows = rows.join(keyed(stays), "__key", "left_semi")
    once = rows.join(keyed(times), "__key", "left_anti")
    again = rows.join(keyed(times), "__key", "left_semi").dropDuplicates(["__key"])
    return once.unionByName(again).select(docs.columns)

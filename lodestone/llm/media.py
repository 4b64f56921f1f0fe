"""Media columns (operator 5): texts as 8-bit audio whose payload is kept in content-defined chunks, each chunk once.

A text's UTF-8 bytes, filled up with spaces to a multiple of 192, are the samples of an 8-bit mono WAV file. A rolling
gear hash over the last 32 bytes cuts the payload where its top bits are zero, so equal passages give equal chunks
wherever they stand. Chunks have 128-bit digests. Digests that occur twice or more are counted by a grouped aggregation.
Writing is one pass without a shuffle: a bit map of fixed size (``BITS``) tells which chunks may be shared. Chunks it
excludes stay in their own document's row, compressed together; all others go to the chunk table, one row a digest.
A false alarm costs a row there, never a byte. Reading joins shared chunks to the documents that list them, puts chunks
in order, verifies every digest, builds the file, and computes features from the samples in it.

Texts that are equal are rebuilt once, and their documents get the values by their payload's digest. Null texts are empty
(192 spaces). Null doc_ids and repeated rows give a row each. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import in_arrow, stage
from ._text import slices

UNIT = 192
LEAST, MOST, MASK_BITS = 256, 8192, 10
BITS = 1 << 24
RATE = 8000
ROWS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _gear() -> np.ndarray:
    """A pseudo-random word for each byte, from a digest of the byte."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)


GEAR = _gear()


def header(n: int) -> bytes:
    """The 44 bytes before n samples of one channel, a byte each."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n & 0xFFFFFFFF, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n & 0xFFFFFFFF)


def payload(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def cuts(data: bytes) -> list[int]:
    """Where chunks end. At least ``LEAST`` bytes lie between, more than the hash looks back, so only the payload counts."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in range(5):  # after step k a word sums up 2**(k+1) bytes
        step = 1 << k
        if len(h) > step:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    ends, last, n = [], 0, len(data)
    for c in np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0).tolist():
        c += 1
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST:
            last = c
            ends.append(c)
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def features(samples: np.ndarray) -> str:
    """Of 8-bit samples: mean level, deviation, entropy in bits, crossings of the mean per thousand samples, distinct levels."""
    n = np.bincount(samples, minlength=256)
    p = n[n > 0] / len(samples)
    mean = float((n * np.arange(256)).sum() / len(samples))
    above = samples > mean
    return f"mean={mean:.4f};std={float(samples.std()):.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};crossings={1000 * int((above[1:] != above[:-1]).sum()) / len(samples):.2f};levels={len(p)}"


@dataclass
class Store:
    """The tables of a media column. index: doc_id, n_bytes, payload; media: a row for each document; shared: chunks by digest."""

    index: DataFrame
    media: DataFrame
    shared: DataFrame


def _index(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b.column("text")):
                raw = [part.text(i) for i in range(part.n)]
                full = [payload(x) for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(part.lo, part.n),
                        pa.array([len(x) for x in raw], pa.int64()),
                        pa.array([hashlib.sha256(x).digest() for x in full], pa.binary()),
                        pa.array([[digest(c) for c in chunks(x)] for x in full], pa.list_(pa.binary())),
                    ],
                    ["doc_id", "n_bytes", "payload", "digests"],
                )

    return docs.transform(in_arrow, run, "doc_id long, n_bytes long, payload binary, digests array<binary>")


def _bit(column: str):
    """A bit for a digest: from its first 7 bytes, which fit a long."""
    return F.conv(F.substring(F.hex(column), 1, 14), 16, 10).cast("long") % BITS


def shared_bits(index: DataFrame) -> np.ndarray:
    """The bit map of digests that occur more than once; at most BITS/32 rows come to the driver, whatever the input."""
    seen = index.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    bit = seen.select(_bit("digest").alias("bit"))
    words = bit.groupBy((F.col("bit") / 32).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 AS int)))").alias("bits"))
    got = words.toPandas()
    out = np.zeros(BITS // 32, np.uint32)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


MEDIA = "payload binary, own binary, chunks array<struct<digest:binary,size:int,shared:boolean>>, sent array<struct<digest:binary,data:binary>>"


def write(docs: DataFrame) -> Store:
    """Store the texts of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    index = stage(_index(docs), "media-index")
    bits = spark.sparkContext.broadcast(shared_bits(index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, has = zstandard.ZstdCompressor(level=3), bits.value
        chunk = pa.struct([("digest", pa.binary()), ("size", pa.int32()), ("shared", pa.bool_())])
        data = pa.struct([("digest", pa.binary()), ("data", pa.binary())])
        for b in batches:
            for part in slices(b.column("text")):
                sent: set[bytes] = set()
                out: list[tuple] = []
                for i in range(part.n):
                    full = payload(part.text(i))
                    rows, kept, shared = [], [], []
                    for c in chunks(full):
                        d = digest(c)
                        bit = int.from_bytes(d[:7], "big") % BITS
                        common = bool(int(has[bit >> 5]) >> (bit & 31) & 1)
                        rows.append({"digest": d, "size": len(c), "shared": common})
                        if not common:
                            kept.append(c)
                        elif d not in sent:
                            sent.add(d)
                            shared.append({"digest": d, "data": pack.compress(c)})
                    out.append((hashlib.sha256(full).digest(), pack.compress(b"".join(kept)) if kept else b"", rows, shared))
                a, o, r, t = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(o, pa.binary()), pa.array(r, pa.list_(chunk)), pa.array(t, pa.list_(data))], ["payload", "own", "chunks", "sent"])

    media = stage(docs.select("text").transform(in_arrow, run, MEDIA), "media-rows")
    sent = media.select(F.explode("sent").alias("x")).select("x.*")
    shared = stage(sent.groupBy("digest").agg(F.first("data").alias("data")), "media-chunks")
    return Store(index.drop("digests"), media.drop("sent"), shared)


VALUES = "payload binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _rebuild(rows: DataFrame) -> DataFrame:
    """payload, own, chunks and, where chunks are shared, got: what the files hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for k in range(b.num_rows):
                key, own, rows, got = (b.column(c)[k].as_py() for c in ("payload", "own", "chunks", "got"))
                own = memoryview(unpack.decompress(own) if own else b"")
                shared = {x["digest"]: x["data"] for x in got or ()}
                parts, at = [], 0
                for c in rows:
                    if c["shared"]:
                        part = unpack.decompress(shared[c["digest"]])
                    else:
                        part, at = own[at : at + c["size"]], at + c["size"]
                    if digest(part) != c["digest"]:
                        raise ValueError("a chunk's bytes don't have its digest")
                    parts.append(part)
                size = sum(len(x) for x in parts)
                file = b"".join([header(size), *parts])
                samples = file[44 : 44 + int.from_bytes(file[40:44], "little")]
                if hashlib.sha256(samples).digest() != key:
                    raise ValueError("a payload's bytes don't have its digest")
                out.append({"payload": key, "payload_bytes": len(samples), "payload_sha256": key.hex(), "tail_crc32": zlib.crc32(samples[-16:]), "media_bytes": len(file), "media_sha256": hashlib.sha256(file).hexdigest(), "feature": features(np.frombuffer(samples, np.uint8))})
            kinds = [("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
            yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    return rows.transform(in_arrow, run, VALUES)


def read(store: Store) -> DataFrame:
    """Rebuild the files of all distinct payloads, verify them, and give each document its values.

    A payload that several documents have consists of shared chunks only, so rows without one are distinct already.
    """
    some = F.exists("chunks", lambda c: c["shared"])
    none = F.lit(None).cast("array<struct<digest:binary,data:binary>>")
    alone = store.media.where(~some).select("payload", "own", "chunks", none.alias("got"))
    mixed = store.media.where(some)
    needs = mixed.select("payload", F.explode(F.array_distinct(F.transform(F.filter("chunks", lambda c: c["shared"]), lambda c: c["digest"]))).alias("digest")).distinct()
    got = needs.join(store.shared, "digest").groupBy("payload").agg(F.collect_list(F.struct("digest", "data")).alias("got"))  # one document's own chunks
    whole = mixed.groupBy("payload").agg(F.first("own").alias("own"), F.first("chunks").alias("chunks")).join(got, "payload")
    values = _rebuild(alone).unionByName(_rebuild(whole.select("payload", "own", "chunks", "got")))
    return store.index.join(values, "payload").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def media_columns(docs: DataFrame) -> DataFrame:
    """Store the texts and read them back."""
    return read(write(docs))

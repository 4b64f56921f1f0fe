"""Token-ID output (operator 7): flat files of unsigned integers with 64-bit document offsets, memory-mapped on reading.

Documents are dealt out by ranges of doc_id, so partition k holds smaller ids than partition k+1. Each partition writes
``<k>.bin``, its ids in the smallest of 16 or 32 bits that the vocabulary fits, and ``<k>.idx``: doc_ids, then n+1 offsets,
both as 64-bit little-endian integers. Files get their name only when whole, by a rename, so a task that runs again
after a lost executor puts the same content in the same place. Partition bases are prefix sums over one row a partition.

Null texts are empty and have only the end id; null doc_ids come first; rows with equal doc_id stay together, ordered by
text. An empty table gives no files and no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import in_arrow, new_path, stage
from ._text import slices

NULL_ID = -(2**63)
#: Bytes of text that a file's ids are made of, about.
FILE_BYTES = 64 << 20
INDEX = "part int, path string, n_docs long, n_tokens long, width int"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@contextmanager
def _file(path: str):
    """A stream to a file that gets its name only when whole."""
    from pyarrow import fs

    system, at = _fs(path)
    if isinstance(system, fs.LocalFileSystem):
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    own = f"{at}.{TaskContext.get().taskAttemptId()}.part"
    with system.open_output_stream(own) as out:
        yield out
    system.move(own, at)


def _load(path: str, kind: str) -> np.ndarray:
    from pyarrow import fs

    system, at = _fs(path)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(at, kind, "r") if system.get_file_info(at).size else np.zeros(0, kind)
    with system.open_input_file(at) as f:
        return np.frombuffer(f.read(), kind)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, partitions: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text), append ``end_id`` to each, write the files; a row for each partition that holds documents."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if partitions is None:  # more files where there is more text
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        n = max(n, -(-size // FILE_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._tokens import codec

        encode = codec(tokenizer)
        kind = np.dtype("<u2") if max(encode.vocabulary, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        doc_ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        k = TaskContext.get().partitionId()
        path = f"{folder}/{k:06d}"
        first = next(batches, None)
        if first is None:
            return
        with _file(f"{path}.bin") as out:  # a task keeps ids and counts of documents, tokens of one slice
            for b in chain([first], batches):
                doc_ids.append(b.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False))
                for part in slices(b.column("text")):
                    flat, n_ids = encode(part)
                    own = np.full(len(flat) + part.n, end_id, kind)
                    own[np.arange(len(flat)) + np.repeat(np.arange(part.n), n_ids)] = flat
                    out.write(own)
                    counts.append(n_ids + 1)
        docs_, counts_ = np.concatenate(doc_ids).astype("<i8"), np.concatenate(counts)
        offsets = np.concatenate(([0], np.cumsum(counts_))).astype("<i8")
        if not len(docs_):
            return
        with _file(f"{path}.idx") as out:
            out.write(docs_)
            out.write(offsets)
        yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "path": [path], "n_docs": [len(docs_)], "n_tokens": [int(offsets[-1])], "width": pa.array([kind.itemsize], pa.int32())})

    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id", F.length("text")).sortWithinPartitions("doc_id", "text")
    return stage(rows.transform(in_arrow, write, INDEX, True), "token-index")


def read_token_files(index: DataFrame) -> DataFrame:
    """The documents of the files that ``index`` lists: where each begins among all ids, and the checksum of its ids."""
    based = index.withColumn("base", F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = _load(f"{row['path']}.bin", f"<u{row['width']}")
                idx = _load(f"{row['path']}.idx", "<i8")
                n = row["n_docs"]
                offsets = idx[n:]
                if len(ids) != row["n_tokens"] or len(idx) != 2 * n + 1 or offsets[-1] != len(ids):
                    raise ValueError(f"{row['path']}: the files don't hold what their index says")
                for lo in range(0, n, 10_000):
                    hi = min(n, lo + 10_000)
                    crc = [zlib.crc32(ids[a:z].astype("<u4")) for a, z in zip(offsets[lo:hi].tolist(), offsets[lo + 1 : hi + 1].tolist(), strict=True)]
                    own = np.array(idx[lo:hi])
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(own, pa.int64(), mask=own == NULL_ID),
                        "start": pa.array(row["base"] + offsets[lo:hi], pa.int64()),
                        "n_tokens": pa.array(np.diff(offsets[lo : hi + 1]), pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    })

    n = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), index.count())
    return based.repartition(n, "part").transform(in_arrow, read, READ)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the files to a new folder of the shared place and read them back."""
    folder = new_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, tokenizer, folder, end_id))

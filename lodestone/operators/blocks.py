"""Vectors packed into blocks, and the nearest of a block's vectors to a block of questions, by one matrix product.

A block is a row: its vectors' length, their ids and groups, and the numbers, row after row, as 8-byte floats. Blocks hold about
a megabyte whatever the vectors' length, so a task's memory doesn't depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.batches import each, rounded

#: Bytes of the numbers of a block.
BLOCK = 1 << 20
#: Scores of vectors and questions that are computed at once.
SCORES = 1 << 18


def _array(x: pa.Array) -> np.ndarray:
    return np.array(x.to_pylist()) if pa.types.is_string(x.type) else x.to_numpy(zero_copy_only=False)


def fits(dims: int) -> int:
    """Vectors of a block."""
    return max(1, BLOCK // (8 * max(dims, 1)))


def packed(rows: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of ``rows`` (id, v, g and the columns ``by``): dim, ``by``, and, each after ``name``, _n, _ids, _g and _v.

    A block holds vectors of one length and one value of each column of ``by`` that stand together in a batch. Rows whose id is null,
    or whose vector is null, empty or holds nulls, are left out.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join(["dim int", *(f"{c} {kinds[c]}" for c in by), f"{name}_n int", f"{name}_ids array<{kinds['id']}>", f"{name}_g array<string>", f"{name}_v binary"])

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        dims = pc.list_value_length(b.column("v")).to_numpy()
        key, out = [pa.array(dims), *(b.column(c) for c in by)], []
        codes = np.zeros(len(dims), np.int64)
        for k in key:
            own = k.dictionary_encode().fill_null(0) if k.null_count else k.dictionary_encode()
            codes = codes * (len(own.dictionary) + 1) + own.indices.fill_null(len(own.dictionary)).to_numpy(zero_copy_only=False)
        for code in np.unique(codes):
            at = np.flatnonzero(codes == code)
            size = fits(int(dims[at[0]]))
            for lo in range(0, len(at), size):
                own = b.take(pa.array(at[lo : lo + size]))
                v = own.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f8")
                out.append([int(dims[at[0]]), *(own.column(c)[0].as_py() for c in by), len(own), own.column("id"), own.column("g"), v.tobytes()])
        if not out:
            return None
        cols = list(zip(*out, strict=True))
        n = np.concatenate(([0], np.cumsum(cols[-4]))).astype(np.int32)
        lists = lambda c: pa.ListArray.from_arrays(pa.array(n), pa.concat_arrays(c))
        fixed = [pa.array(c, b.column(x).type) for c, x in zip(cols[1 : 1 + len(by)], by, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *fixed, pa.array(cols[-4], pa.int32()), lists(cols[-3]), lists(cols[-2]), pa.array(cols[-1], pa.binary())], [c.split()[0] for c in schema.split(", ")])

    return whole(rows).select("id", F.transform("v", lambda x: x.cast("double")).alias("v"), F.col("g").cast("string").alias("g"), *by).mapInArrow(each(run, 4096), schema)


def whole(rows: DataFrame) -> DataFrame:
    """Rows with an id and a vector (id, v), which holds numbers and no nulls."""
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))


def matrix(row: dict, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, groups and vectors of a block."""
    return np.array(row[f"{name}_ids"]), np.array(row[f"{name}_g"]), np.frombuffer(row[f"{name}_v"], "<f8").reshape(-1, row["dim"])


def nearest(v: tuple, q: tuple, k: int, others: bool, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each question of a block, the k vectors of a block of its group with the greatest cosine, rounded; ties to the smaller id."""
    (ids, groups, x), (qids, of, y) = v, q
    length = lambda m: np.sqrt((m * m).sum(1))
    own, theirs, step = length(x), length(y), max(1, SCORES // max(len(x), 1))
    for lo in range(0, len(y), step):  # some questions at a time, so that their scores are few megabytes
        scale = theirs[lo : lo + step, None] * own[None, :]
        score = rounded(np.where(scale > 0, (y[lo : lo + step] @ x.T) / np.where(scale > 0, scale, 1), 0.0), digits)
        for i, qid in enumerate(qids[lo : lo + step]):
            at = best(score[i], ids, np.flatnonzero((groups == of[lo + i]) & ((ids != qid) if others else True)), k)
            yield np.full(len(at), qid), ids[at], score[i][at]


def best(score: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``at``, the k of greatest score, in order; ties to the smaller id."""
    if len(at) > k:
        at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def meet(pairs: DataFrame, kinds: tuple[str, str], k: int, others: bool, digits: int) -> DataFrame:
    """qid, vec_id and score: of each two blocks that stand in a row, as v_ and q_, each question's k nearest vectors."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for n in range(b.num_rows):
            row = b.slice(n, 1).to_pylist()[0]
            out += nearest(matrix(row, "v"), matrix(row, "q"), k, others, digits)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["qid", "vec_id", "score"]) if out else None

    return pairs.select("dim", "v_ids", "v_g", "v_v", "q_ids", "q_g", "q_v").mapInArrow(each(run, 16), f"qid {kinds[0]}, vec_id {kinds[1]}, score double")


def meet_all(rows: DataFrame, questions: Broadcast, kinds: tuple[str, str], k: int, others: bool, digits: int) -> DataFrame:
    """qid, vec_id and score: as ``meet`` of the blocks of ``rows`` (id, v, g) with all blocks of questions, which tasks hold.

    Vectors are compared by the worker that reads them, a block's bytes at a time: no block is made a row, and a core has one worker.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        dims, out = pc.list_value_length(b.column("v")).to_numpy(), []
        for dim in np.unique(dims):
            own = b.filter(pa.array(dims == dim))
            v = (_array(own.column("id")), _array(own.column("g")), own.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f8", copy=False).reshape(-1, dim))
            for q in questions.value:
                if q["dim"] == dim:
                    out += nearest(v, matrix(q, "q"), k, others, digits)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["qid", "vec_id", "score"]) if out else None

    return whole(rows).select("id", F.col("v").cast("array<double>").alias("v"), F.col("g").cast("string").alias("g")).mapInArrow(each(run, 4096, BLOCK), f"qid {kinds[0]}, vec_id {kinds[1]}, score double")


def grid(vectors: DataFrame, questions: DataFrame, parts: int) -> DataFrame:
    """Each block of vectors with each of questions of its length: both are dealt to the cells of a square of ``parts`` cells or so.

    A cell gets its blocks by an equality join, so each task meets a share of either side, and neither is sent whole.
    """
    side = max(1, round(parts**0.5))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    v = vectors.withColumn("i", group("v_v")).withColumn("j", every)
    q = questions.withColumn("j", group("q_v")).withColumn("i", every)
    return v.join(q.hint("merge"), ["dim", "i", "j"])

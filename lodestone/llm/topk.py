"""Exact top-k search by inner product (operator 2), three-phase uniform threshold over blocks of dimensions.

The dimensions are cut into ``LISTS`` lists. A vector's score in a list is its partial inner product there; its score is
the sum. Vectors and queries are packed into blocks, and each two blocks of one length meet in a task: a stated query set
against all rows, in blocks. Row blocks are dealt to groups, query blocks to as few as the sizes ask for, and each cell of
that grid gets its blocks by an equality join, so no key holds more than its share of rows, whatever their length.

1. Each row block gives each list's k best partial scores; the vectors that they name, no others, are resolved. The k-th
   best of all these scores is a safe cutoff T: no vector below it is in the result.
2. T goes out with its queries. A vector that scores T or more has T/m or more in one of m lists; each block collects all
   entries that have, list by list. A block whose norms say that no vector in it can come to T is passed over.
3. The scores of what was collected are resolved exactly; each block gives its k best at least as good as T, and the
   best k of these are the result, ties to the smaller id.

Components become floor(scale * x), 64-bit integers (beyond their range, their nearest bound). Sums are taken in 64-bit
floats where a bound on them shows that those are exact, else in 64-bit integers, else in unbounded ones; a score beyond a
long's range becomes its nearest bound. Vectors that are null, empty or hold null or non-finite components, and rows with a
null id, take no part. Vectors of another length than the query's have no inner product with it and aren't its candidates.
Repeated ids are separate rows, but none is a candidate for a query of its own id. All query rows of an id are asked and
share one list, as in the SQL, and one cutoff, the k-th best of what any of them found: it is safe for each. Fewer than k
candidates are returned all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import drop_stage, in_arrow, stage

#: Rows of a row block and of a query block.
ROWS, QUERIES, LISTS = 4096, 1024, 4
LEAST, MOST = -(2**63), 2**63 - 1


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """id, dim and v, the integers, of vectors that are whole."""
    x = F.col(vec_col)
    whole = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(whole & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.size(x).alias("dim"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _packed(rows: DataFrame, name: str, most: int) -> DataFrame:
    """Blocks of at most ``most`` rows: dim, block (a digest), ids, t (cutoffs, as 8-byte integers) and vals, row after row in 4 or 8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                ids, t = own.column("id").to_numpy(), own.column("t").to_numpy()
                v = own.column("v").flatten().to_numpy().reshape(-1, dim)
                for lo in range(0, len(ids), most):
                    i, x = ids[lo : lo + most], v[lo : lo + most]
                    kind = "<i4" if x.min() >= -(2**31) and x.max() < 2**31 else "<i8"
                    yield pa.RecordBatch.from_pydict({
                        "dim": pa.array([int(dim)], pa.int32()),
                        name: pa.array([int(np.bitwise_xor.reduce(i * 0x9E3779B1)) ^ int(i[0]) << 20 & 0x7FFFFFFFFFFFFFF], pa.int64()),
                        f"{name}_ids": [i.astype("<i8").tobytes()],
                        f"{name}_t": [t[lo : lo + most].astype("<i8").tobytes()],
                        f"{name}_vals": [x.astype(kind).tobytes()],
                    })

    return rows.select("id", "dim", "v", "t").transform(in_arrow, run, f"dim int, {name} long, {name}_ids binary, {name}_t binary, {name}_vals binary")


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query's scores, ties to the smaller id."""
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= edge)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


class _Pair:
    """Two blocks that meet: q and r, their ids; qv and rv, their vectors; in which arithmetic their products are exact."""

    def __init__(self, row: dict, lists: int):
        self.q, self.r = (np.frombuffer(row[f"{c}_ids"], "<i8") for c in "qr")
        self.t = np.frombuffer(row["q_t"], "<i8")
        qv, rv = (np.frombuffer(row[f"{c}_vals"], f"<i{len(row[f'{c}_vals']) // (len(i) * row['dim'])}").reshape(len(i), -1) for c, i in (("q", self.q), ("r", self.r)))
        self.lists = np.array_split(np.arange(row["dim"]), min(lists, row["dim"]))
        top = lambda x: max(int(x.max()), -int(x.min()))
        bound = top(qv) * top(rv) * row["dim"] * len(self.lists)
        self.kind = float if bound < 2**53 else np.int64 if bound < 2**63 else object
        self.qv, self.rv = qv.astype(self.kind), rv.astype(self.kind)

    def partial(self, d: np.ndarray) -> np.ndarray:
        """Partial scores of all queries with all vectors in one list."""
        return self.qv[:, d] @ self.rv[:, d].T

    def scores(self, i: int, at: np.ndarray) -> np.ndarray:
        """Whole scores of query i with the vectors at some places, as longs."""
        s = self.rv[at] @ self.qv[i]
        return np.clip(s, LEAST, MOST).astype(np.int64) if self.kind is object else s.astype(np.int64)

    def hopeless(self) -> np.ndarray:
        """Of each query, whether no vector can come to its cutoff, by the norms of its lists and theirs."""
        norm = lambda x: np.stack([np.sqrt((x[:, d].astype(float) ** 2).sum(1)) for d in self.lists], 1)
        return (norm(self.qv) @ norm(self.rv).max(0)) * (1 + 1e-9) + 1 < self.t

    def first(self, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """Of each query, the vectors that its lists' k best partial scores name."""
        named: list[list[np.ndarray]] = [[] for _ in self.q]
        for d in self.lists:
            p = self.partial(d)
            for i, x in enumerate(self.q):
                other = np.flatnonzero(self.r != x)
                named[i].append(other[_best(p[i, other], self.r[other], k)])
        for i, x in enumerate(named):
            yield i, np.unique(np.concatenate(x))

    def second(self, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """Of each query, the vectors with enough in one list."""
        ask = np.flatnonzero(~self.hopeless())
        enough = np.zeros((len(self.q), len(self.r)), bool)
        t = self.t.astype(self.kind)
        for d in self.lists if len(ask) else []:
            enough[ask] |= ((self.qv[np.ix_(ask, d)] @ self.rv[:, d].T) * len(self.lists) >= t[ask, None]).astype(bool)
        for i in ask.tolist():
            yield i, np.flatnonzero(enough[i] & (self.r != self.q[i]))


HITS = "query_id long, vec_id long, score long"


def _meet(pairs: DataFrame, k: int, lists: int, named: Callable[[_Pair, int], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """The k best scores that come to the cutoff, of what ``named`` names in each two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                pair = _Pair(b.slice(n, 1).to_pylist()[0], lists)
                out = [np.zeros((3, 0), np.int64)]
                for i, at in named(pair, k):
                    score = pair.scores(i, at)
                    at, score = at[score >= pair.t[i]], score[score >= pair.t[i]]
                    best = _best(score, pair.r[at], k)
                    out.append(np.stack([np.full(len(best), pair.q[i]), pair.r[at[best]], score[best]]))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, 1)], ["query_id", "vec_id", "score"])

    return pairs.transform(in_arrow, run, HITS)


def _grid(blocks: DataFrame, n_blocks: int, asked: DataFrame, n_asked: int, parts: int) -> DataFrame:
    """Each row block with each query block of its length, dealt to the cells of a grid of groups of both."""
    across = max(1, min(n_asked, round((parts * n_asked / max(n_blocks, 1)) ** 0.5)))
    down = max(1, -(-parts // across))
    group = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = ["dim", "i", "j"]
    rows = blocks.withColumn("i", group("r", down)).withColumn("j", every(across)).repartition(parts, *cell)
    queries = asked.withColumn("j", group("q", across)).withColumn("i", every(down)).repartition(parts, *cell)
    return rows.join(queries, cell).select("dim", "r_ids", "r_vals", "q_ids", "q_t", "q_vals")


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int = 5, lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of each query; both tables as ``quantised`` gives them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    queries = stage(queries.select("id", "dim", "v"), "queries")
    blocks = stage(_packed(rows.withColumn("t", F.lit(LEAST)), "r", ROWS), "row-blocks")
    asked = stage(_packed(queries.withColumn("t", F.lit(LEAST)), "q", QUERIES), "query-blocks")
    sizes = blocks.count(), asked.count()

    local = _meet(_grid(blocks, sizes[0], asked, sizes[1], parts), k, lists, _Pair.first)
    cutoff = _ranked(local, k).groupBy("query_id").agg(F.min("score").alias("t"), F.count("*").alias("n"))
    # without k entries yet, nothing is below the cutoff
    cutoff = stage(cutoff.where(F.col("n") >= k).select(F.col("query_id").alias("id"), "t"), "cutoffs")
    known = queries.join(cutoff, "id", "left").withColumn("t", F.coalesce("t", F.lit(LEAST)))
    sent = stage(_packed(known, "q", QUERIES), "query-cutoffs")
    drop_stage(asked, queries, cutoff)

    found = _meet(_grid(blocks, sizes[0], sent, sent.count(), parts), k, lists, _Pair.second)
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

"""A stored index of vectors for nearest neighbours by cosine: inverted lists by trained cells, searched exactly.

Cells are those of a spherical k-means, fitted on a bounded sample (``sample``); every vector is then put into the cell of the
nearest centre. A cell's vectors are sorted by their angle to the centre and packed into blocks, each with the least and the
greatest such angle. By the triangle inequality of angles, a vector of a block that spans the angles lo..hi is at least
max(0, t - hi, lo - t) away from a question that is t away from the centre: that is the block's bound.

A question first reads the blocks of best bounds until they hold k vectors or more. The k-th best of those is a score that every
result reaches, so then it reads the blocks whose bound allows for it, and no others. The result is that of comparing all
vectors; ``probes`` tells what share of them was compared. Vectors without length are a cell of their own: their cosine is 0.

Adding vectors adds blocks, in a version of its own, with the same centres. Nothing but centres comes to the driver: at most ``cells`` a length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, Config
from lodestone.functions.batches import each
from lodestone.operators import blocks as B
from lodestone.operators.retrieval import top
from lodestone.sources.commits import Commits

#: What rounding of angles and of scores can hide.
SLACK = 2e-6


def _nearest_centre(centres: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each vector and its angle to the centre; -1 and 0 for one without length."""
    length = np.sqrt((v * v).sum(1))
    cos = (v / np.where(length > 0, length, 1)[:, None]) @ centres.T
    cell = cos.argmax(1)
    angle = np.arccos(np.clip(cos[np.arange(len(v)), cell], -1, 1))
    return np.where(length > 0, cell, -1), np.where(length > 0, angle, 0.0)


class VectorIndex:
    """Blocks of vectors (vec_id, embedding) under a folder."""

    def __init__(self, spark: SparkSession, folder: str, config: Config = DEFAULT):
        self.spark, self.config, self.log = spark, config, Commits(spark, folder)

    # --- build

    def add(self, vectors: DataFrame, cells: int | None = None, sample: int = 20_000) -> int:
        """Add vectors; the index's new version. Cells are trained by the first addition of a length: its square root, from 1 to 1024, unless told.

        Rows whose id or vector is null, or whose vector is empty or holds nulls, are left out.
        """
        version, state = self.log.last()
        rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull()))
        rows = rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
        # made once, however costly: lengths, sample, ranges and blocks are read from this table, which no version names
        staged = f"{self.log.new_folder()}/vectors"
        rows.write.parquet(staged)
        rows = self.spark.read.parquet(staged)
        centres = {int(d): c for d, c in state.get("centres", {}).items()}
        sizes = {r["d"]: r["n"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}  # the lengths that there are
        for d, n in sizes.items():
            if d not in centres:
                centres[d] = self._train(rows.where(F.size("v") == d), min(1024, cells or max(1, math.isqrt(n))), min(sample, (64 << 20) // (8 * d)), n)
        folder = self.log.new_folder()
        self._blocks(rows, {d: np.array(c) for d, c in centres.items()}).write.parquet(f"{folder}/blocks")
        self.log.commit(version + 1, {"folders": [*state.get("folders", []), folder], "centres": centres, "vectors": state.get("vectors", 0) + sum(sizes.values()), "kind": dict(rows.dtypes)["vec_id"]})
        return version + 1

    def _train(self, rows: DataFrame, cells: int, sample: int, n: int) -> list[list[float]]:
        """Centres of length 1. The sample is by a hash of the id: the same in each run."""
        some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 1.2 * sample / n)) + 1).limit(sample)
        some = some.where(F.exists("v", lambda x: x != 0)).select(array_to_vector("v").alias("features"))
        some = some.persist()
        try:
            if some.count() <= cells:
                found = [r["features"].toArray() for r in some.collect()] or [np.ones(rows.select(F.size("v")).first()[0])]
            else:
                found = KMeans(k=cells, seed=42, maxIter=10, distanceMeasure="cosine").fit(some).clusterCenters()
        finally:
            some.unpersist()
        lengths = [float(np.sqrt((c * c).sum())) for c in found]
        return [(c / x).tolist() for c, x in zip(found, lengths, strict=True) if x > 0]

    def _blocks(self, rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
        kind = dict(rows.dtypes)["vec_id"]
        sent = self.spark.sparkContext.broadcast(centres)

        def place(b: pa.RecordBatch) -> pa.RecordBatch:
            dims = np.array([len(x) for x in b.column("v")])
            cell, angle = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                v = b.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                cell[at], angle[at] = _nearest_centre(sent.value[int(d)], v)
            return pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(angle)], ["id", "v", "cell", "angle"])

        placed = rows.mapInArrow(each(place), f"id {kind}, v array<double>, cell int, angle double")
        # ranges of (cell, angle): a cell that holds a great part of all vectors is several of them
        ordered = placed.repartitionByRange("cell", "angle").sortWithinPartitions("cell", "angle")
        sized = ordered.withColumn("g", F.concat_ws(" ", F.col("cell"), F.col("angle")))
        made = B.packed(sized, "v", ("cell",))
        angle = lambda x: F.substring_index(x, " ", -1).cast("double")
        return made.select("dim", "cell", F.xxhash64("cell", "v_v").alias("block"), angle(F.element_at("v_g", 1)).alias("lo"), angle(F.element_at("v_g", -1)).alias("hi"), F.col("v_n").alias("n"), "v_ids", F.transform("v_g", lambda _: F.lit("")).alias("v_g"), "v_v")

    # --- search

    def _table(self, state: dict) -> DataFrame:
        return self.spark.read.parquet(*(f"{f}/blocks" for f in state["folders"]))

    def _bounds(self, questions: DataFrame, state: dict) -> DataFrame:
        """qid, block, n and bound: for each question (id, v) and block of its length, the best cosine that can be in it."""
        centres = self.spark.sparkContext.broadcast({int(d): np.array(c) for d, c in state["centres"].items()})
        kind = dict(questions.dtypes)["id"]

        def angles(b: pa.RecordBatch) -> pa.RecordBatch | None:
            out = []
            for qid, v in zip(b.column("id"), b.column("v").to_pylist(), strict=True):
                c = centres.value.get(len(v))
                if c is not None:
                    v = np.array(v)
                    length = np.sqrt((v * v).sum())
                    t = np.arccos(np.clip(c @ v / length, -1, 1)) if length > 0 else np.full(len(c), np.nan)
                    # the cell of vectors without length is at a right angle to all
                    out.append((qid, len(v), np.arange(-1, len(c)), np.append(np.nan, t)))
            if not out:
                return None
            n = [len(x[2]) for x in out]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0].as_py() for x in out], n)), pa.array(np.repeat([x[1] for x in out], n).astype(np.int32)), pa.array(np.concatenate([x[2] for x in out]).astype(np.int32)), pa.array(np.concatenate([x[3] for x in out]))], ["qid", "dim", "cell", "t"])

        t = questions.select("id", "v").mapInArrow(each(angles), f"qid {kind}, dim int, cell int, t double")
        directory = self._table(state).select("dim", "cell", "block", "lo", "hi", "n")
        away = F.greatest(F.lit(0.0), F.col("t") - F.col("hi"), F.col("lo") - F.col("t"))
        bound = F.when(F.isnan("t"), 0.0).otherwise(F.cos(away))
        return t.join(directory, ["dim", "cell"]).select("qid", "block", "n", bound.alias("bound"))

    def _read(self, wanted: DataFrame, questions: DataFrame, state: dict, k: int, others: bool, digits: int) -> DataFrame:
        """qid, vec_id and score of the k nearest in each of the ``wanted`` (qid, block)."""
        kind = dict(questions.dtypes)["id"]
        asked = wanted.join(questions.select(F.col("id").alias("qid"), "v"), "qid").select(F.col("qid").alias("id"), "v", F.lit("").alias("g"), "block")
        asked = B.packed(asked.repartition("block").sortWithinPartitions("block"), "q", ("block",))
        return B.meet(self._table(state).join(asked, ["dim", "block"]), (kind, state["kind"]), k, others, digits)

    def probes(self, questions: DataFrame, k: int | None = None, others: bool = True, digits: int = 6, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """The hits, as ``search`` gives them, and qid, compared and vectors: how many of all vectors a question was compared with.

        The two tables share work: both are made from tables that are checkpointed.
        """
        from lodestone.sources.tables import cut

        k, (at, state) = k or self.config.top_k, self.log.last()
        if version:
            at, state = version, self.log.read(version)
        kinds = dict(questions.dtypes)
        if not at:
            empty = self.spark.createDataFrame([], f"qid {kinds['qid']}, rank int, vec_id long, score double")
            return empty, self.spark.createDataFrame([], f"qid {kinds['qid']}, compared long, vectors long")
        rows = questions.where(F.col("qid").isNotNull() & F.col("q").isNotNull()).select(F.col("qid").alias("id"), F.transform("q", lambda x: x.cast("double")).alias("v"))
        bounds = cut(self._bounds(rows, state))
        order = Window.partitionBy("qid").orderBy(F.desc("bound"), "block")
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # the question's own vector may be among them
        first = bounds.withColumn("before", before).where(F.col("before") < k + (1 if others else 0)).select("qid", "block", "n")
        first = cut(first)
        found = cut(self._read(first, rows, state, k, others, digits))
        least = top(found, k, F.desc("score"), "vec_id").groupBy("qid").agg(F.count("*").alias("n_found"), F.min("score").alias("t"))
        need = F.when(F.coalesce("n_found", F.lit(0)) < k, F.lit(-2.0)).otherwise(F.col("t"))
        rest = bounds.join(least, "qid", "left").where(F.col("bound") >= need - SLACK).select("qid", "block", "n").join(first.select("qid", "block"), ["qid", "block"], "left_anti")
        rest = cut(rest)
        hits = top(found.unionByName(self._read(rest, rows, state, k, others, digits)), k, F.desc("score"), "vec_id").select("qid", "rank", "vec_id", "score")
        seen = first.unionByName(rest).groupBy("qid").agg(F.sum("n").alias("compared")).withColumn("vectors", F.lit(state["vectors"]).cast("long"))
        return hits, seen

    def search(self, questions: DataFrame, k: int | None = None, others: bool = True, digits: int = 6, version: int | None = None) -> DataFrame:
        """qid, rank, vec_id and cosine of the nearest vectors to each of questions (qid, q): as ``retrieval.dense_topk``."""
        return self.probes(questions, k, others, digits, version)[0]

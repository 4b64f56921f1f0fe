"""Whitening of vectors (operator 11): the covariance by one aggregation over every pair of dimensions, decomposed by LAPACK.

An entry c becomes the integer x = floor(SCALE * c) + SHIFT. A first aggregation gives n and the sums S of each dimension.
The second has one Spark SQL expression for each pair i <= j of dimensions, the sum of y_i * y_j, where y = x - m and m is the
whole number nearest to the mean; as m is not quite the mean, n * cov = sum(y_i y_j) - sum(y_i) sum(y_j) / n. Products and
sums are doubles of whole numbers: while n * max(y)^2 is below 2^53 they are exact, whatever the tasks' order, and beyond it
they are as good as doubles are. Of d dimensions that is d (d + 1) / 2 sums a task; at most ``MOST`` stand in one aggregation,
wider vectors take several.

Entries whose x leaves +-2^61 count as that bound. A deviation beyond a long becomes its greatest value.

Rows whose vector is null, or holds null or non-finite entries, take no part. Vectors of several lengths come from several
models: each length is a fit of its own. Vectors without entries have no component. Repeated rows and null ids count as rows.
A component that the vectors don't vary in (its eigenvalue is within rounding of 0) has a null ``whitened`` and no part in
``identity_error``; with no varying component at all, ``explained`` and ``identity_error`` are null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import in_arrow

SCALE, SHIFT, MOST = 1024, 100_000, 4096
_LIMIT = 2.0**61
_LONG = 2**63 - 1


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and x, the integers, of vectors that are whole."""
    v = F.col(vec_col)
    whole = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    x = lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(_LIMIT)), F.lit(-_LIMIT))) + SHIFT
    return vectors.where(whole).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, x).alias("x"))


class Fit:
    """Of vectors of one length: n, the sums of each dimension, the covariance, its eigenvalues and vectors."""

    def __init__(self, rows: DataFrame, dims: int):
        self.dims = dims
        x = [F.col("x")[i] for i in range(dims)]
        sums = [F.sum(c.cast("decimal(20,0)")) for c in x]
        found = rows.agg(F.count("*"), *sums, *[F.min(c) for c in x], *[F.max(c) for c in x]).first()
        self.n, sums = found[0], [int(s) for s in found[1 : dims + 1]]
        self.sums = sums
        self.middle = [round(Fraction(s, self.n)) for s in sums]
        #: What n times the middle lacks of the sum: at most n / 2.
        self.rest = [s - self.n * m for s, m in zip(sums, self.middle)]
        least, most = found[dims + 1 : 2 * dims + 1], found[2 * dims + 1 :]
        self.reach = max(max(abs(a - m), abs(b - m)) for a, b, m in zip(least, most, self.middle))
        self.covariance = self._covariance(rows)
        values, vectors = np.linalg.eigh(self.covariance)
        order = np.argsort(-values, kind="stable")
        self.values, self.vectors = values[order], vectors[:, order]
        self.trace = float(np.trace(self.covariance))
        self.varies = self.values > self.trace * dims * np.finfo(float).eps

    def centred(self, rows: DataFrame) -> DataFrame:
        """y0, y1, ...: x less the whole number nearest to its mean. Nothing is null here, and the plan knows it, which spares checks a pair."""
        y = [F.coalesce((F.col("x")[i] - F.lit(m).cast("long")).cast("double"), F.lit(0.0)) for i, m in enumerate(self.middle)]
        return rows.select(*[c.alias(f"y{i}") for i, c in enumerate(y)])

    def _covariance(self, rows: DataFrame) -> np.ndarray:
        pairs = list(combinations_with_replacement(range(self.dims), 2))
        rows, out = self.centred(rows), np.zeros((self.dims, self.dims))
        for lo in range(0, len(pairs), MOST):
            part = pairs[lo : lo + MOST]
            for (i, j), s in zip(part, rows.agg(*[F.expr(f"sum(y{i} * y{j})") for i, j in part]).first()):
                out[i, j] = out[j, i] = float((Fraction(s) - Fraction(self.rest[i] * self.rest[j], self.n)) / self.n)
        return out

    def project(self, rows: DataFrame, components: int) -> DataFrame:
        """vec_id, deviation and w: the centred vectors projected on the first components, over their standard deviations."""
        n, dims, varies = self.n, self.dims, self.varies[:components]
        middle, rest = np.array(self.middle, object), np.array(self.rest, object)
        off = np.array([float(Fraction(r, n)) for r in self.rest])
        by = self.vectors[:, :components] / np.sqrt(np.where(varies, self.values[:components], 1.0))
        # of whole numbers: (n y - rest)^2 summed is n^2 sum(y^2) - 2 n sum(y rest) + sum(rest^2); only these sums may pass 64 bits
        kind = np.int64 if dims * self.reach * max(self.reach, *map(abs, self.rest)) <= _LONG else object
        squares = sum(r * r for r in self.rest)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                y = b.column("x").flatten().to_numpy().reshape(-1, dims).astype(kind) - middle.astype(kind)
                deviation = n * n * (y * y).sum(1).astype(object) - 2 * n * (y * rest.astype(kind)).sum(1).astype(object) + squares
                w = pa.array(((y.astype(float) - off) @ by).ravel(), mask=np.tile(~varies, len(y)))
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), pa.array(np.minimum(deviation, _LONG).astype(np.int64)), pa.ListArray.from_arrays(np.arange(0, len(w) + 1, components, dtype=np.int32), w)],
                    ["vec_id", "deviation", "w"],
                )

        return rows.transform(in_arrow, run, "vec_id long, deviation long, w array<double>")

    def identity_error(self, rows: DataFrame, components: int) -> float | None:
        """The largest entry of the whitened vectors' covariance, measured over all of them, less the identity."""
        own = [c for c in range(components) if self.varies[c]]
        if not own:
            return None
        pairs = list(combinations_with_replacement(own, 2))
        w = [F.col("w")[c] for c in range(components)]
        rows = self.project(rows, components)
        mean = dict(zip(own, rows.agg(*[F.avg(w[c]) for c in own]).first()))
        found = rows.agg(*[F.avg((w[i] - F.lit(mean[i])) * (w[j] - F.lit(mean[j]))) for i, j in pairs]).first()
        return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found))


def whiten(rows: DataFrame, components: int = 8) -> DataFrame:
    """One row for each vector of ``integers`` and each of its first ``components`` components.

    vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error.
    """
    out = None
    for dims in sorted(r[0] for r in rows.select(F.size("x")).distinct().collect()) or [0]:
        own = rows.where(F.size("x") == dims)
        out = _one_length(own, dims, components) if out is None else out.unionByName(_one_length(own, dims, components))
    return out


def _one_length(rows: DataFrame, dims: int, components: int) -> DataFrame:
    k = min(components, dims)
    if not k:
        return rows.where("false").selectExpr("vec_id", "0 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    fit = Fit(rows, dims)
    error, share = fit.identity_error(rows, k), [float(v / fit.trace) if fit.trace > 0 else None for v in fit.values[:k]]
    shares = F.array(*[F.lit(v).cast("double") for v in share])
    out = fit.project(rows, k).select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))

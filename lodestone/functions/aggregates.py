"""Aggregates of one's own over Arrow batches, with partial states that can be merged, as Spark's own have.

Tasks make a state for each group of their rows; states, not rows, are shuffled, and merged a group at a time. So a group of any
size costs a task's memory one state, and what is shuffled of it is a row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups that a task holds before it gives their states out.
HELD = 100_000


class Aggregate:
    """What an aggregate of one column is: the names of a state's numbers, their start, how values and states come together, the result."""

    fields: tuple[str, ...]

    def partial(self, values: np.ndarray) -> np.ndarray:
        """The state of some values."""
        raise NotImplementedError

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def result(self) -> dict[str, Column]:
        """Columns made of a merged state's fields."""
        raise NotImplementedError


class Moments(Aggregate):
    """Count, mean, variance, skewness and kurtosis (of the population), from sums of powers about the mean, which lose no digits when merged."""

    fields = ("n", "mean", "m2", "m3", "m4")

    def partial(self, values: np.ndarray) -> np.ndarray:
        d = values - values.mean()
        return np.array([len(values), values.mean(), (d**2).sum(), (d**3).sum(), (d**4).sum()])

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (na, ma, a2, a3, a4), (nb, mb, b2, b3, b4) = a, b
        n, d = na + nb, mb - ma
        m3 = a3 + b3 + d**3 * na * nb * (na - nb) / n**2 + 3 * d * (na * b2 - nb * a2) / n
        m4 = a4 + b4 + d**4 * na * nb * (na**2 - na * nb + nb**2) / n**3 + 6 * d**2 * (na**2 * b2 + nb**2 * a2) / n**2 + 4 * d * (na * b3 - nb * a3) / n
        return np.array([n, ma + d * nb / n, a2 + b2 + d**2 * na * nb / n, m3, m4])

    def result(self) -> dict[str, Column]:
        n, m2, m3, m4 = (F.col(c) for c in ("n", "m2", "m3", "m4"))
        some = m2 > 0
        return {"n": n.cast("long"), "mean": F.col("mean"), "variance": m2 / n, "skewness": F.when(some, F.sqrt(n) * m3 / F.pow(m2, F.lit(1.5))), "kurtosis": F.when(some, n * m4 / (m2 * m2) - 3)}


def aggregate(rows: DataFrame, by: list[str], column: str, of: Aggregate) -> DataFrame:
    """``by`` and the results of ``of`` over ``column``, a number; nulls and NaN are left out, and groups of nothing else."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), *(f"{f} double" for f in of.fields)])

    def out(held: dict, types: list[pa.DataType]) -> pa.RecordBatch:
        keys, states = list(held), np.array(list(held.values())).reshape(len(held), len(of.fields))
        own = [pa.array([k[i] for k in keys], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([*own, *(pa.array(states[:, i]) for i in range(len(of.fields)))], [*by, *of.fields])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        types: list[pa.DataType] = []
        for b in batches:
            types = [b.column(c).type for c in by]
            grouped = pa.Table.from_batches([b]).append_column("__at", pa.array(np.arange(b.num_rows))).group_by(by).aggregate([("__at", "list")])
            values = b.column(column).to_numpy(zero_copy_only=False).astype(float)
            for *key, at in zip(*(grouped.column(c).to_pylist() for c in by), grouped.column("__at_list").to_pylist(), strict=True):
                state = of.partial(values[at])
                key = tuple(key)
                held[key] = of.merge(held[key], state) if key in held else state
            if len(held) > HELD:
                yield out(held, types)
                held = {}
        if held:
            yield out(held, types)

    def merged(t: pa.Table) -> pa.Table:
        state = None
        for row in zip(*(t.column(f).to_pylist() for f in of.fields), strict=True):
            state = np.array(row) if state is None else of.merge(state, np.array(row))
        first = [t.column(c).slice(0, 1) for c in by]
        return pa.table([*first, *([x] for x in state)], names=[*by, *of.fields])

    whole = rows.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(*by, F.col(column).cast("double").alias(column))
    states = whole.mapInArrow(partial, schema).groupBy(*by).applyInArrow(merged, schema)
    return states.select(*by, *(c.alias(n) for n, c in of.result().items()))

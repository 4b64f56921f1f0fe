"""Joins that equality alone doesn't give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, Config
from lodestone.sources.tables import bounded, cut


def asof(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Each left row with ``value`` of the last right row of the same ``by`` at or before ``at``: one shuffle of both sides.

    Right rows of equal time: the greatest value. Both sides need the columns ``by`` and ``at``.
    """
    cols = [c for c in left.columns if c not in (by, at)]
    a = left.select(by, at, F.lit(1).alias("__side"), F.struct(*cols).alias("__row"), F.lit(None).cast(dict(right.dtypes)[value]).alias(value))
    none = F.lit(None).cast(a.schema["__row"].dataType)
    b = right.select(by, at, F.lit(0).alias("__side"), none.alias("__row"), value)
    w = Window.partitionBy(by).orderBy(at, "__side", value).rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(b).withColumn(value, F.last(value, ignorenulls=True).over(w))
    return seen.where("__side = 1").select(by, at, "__row.*", value)


def range_join(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: float) -> DataFrame:
    """Points within lo <= at < hi, by an equality join on buckets of ``width``: a range is a row for each bucket it meets."""
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    r = ranges.withColumn("__b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return p.join(r, "__b").where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("__b")


def median(rows: DataFrame, by: list[str], column: str, bands: int = 32, config: Config = DEFAULT) -> DataFrame:
    """``by`` and the median of ``column``, a number, the smaller one of two; nulls are left out. Exact at any size.

    A sketch of quantiles cuts each group into bands, whose rows are counted; only the values of the band that holds the middle row
    are ordered. However far off the sketch is, the counts are exact, so the result is.
    """
    own = rows.where(F.col(column).isNotNull()).select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(by)), F.col(column).alias("median"))
    keys = [f"__{i}" for i in range(len(by))]
    same = lambda end: reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"{k}{end}")) for k in keys))
    edges = own.groupBy(*keys).agg(F.percentile_approx("median", [i / bands for i in range(1, bands)], 10 * bands).alias("edges"), F.count("*").alias("n"))
    band = F.size(F.filter("edges", lambda e: e < F.col("median")))
    edges = bounded(cut(edges.select(*(F.col(k).alias(f"{k}e") for k in keys), "edges", "n")), config.broadcast_rows)
    placed = own.join(edges, same("e")).select(*keys, "n", "median", band.alias("band"))
    counted = placed.groupBy(*keys, "n", "band").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy(*keys).orderBy("band"))
    middle = F.ceil(F.col("n") / 2)
    held = counted.withColumn("to", before).where((F.col("to") >= middle) & (F.col("to") - F.col("c") < middle)).select(*(F.col(k).alias(f"{k}h") for k in keys), F.col("band").alias("b"), (middle - (F.col("to") - F.col("c"))).alias("nth"))
    values = placed.join(held, same("h") & (F.col("band") == F.col("b")))
    times = values.groupBy(*keys, "nth", "median").agg(F.count("*").alias("c")).withColumn("to", F.sum("c").over(Window.partitionBy(*keys).orderBy("median")))
    return times.where(F.col("to") >= F.col("nth")).groupBy(*keys).agg(F.min("median").alias("median")).select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), "median")

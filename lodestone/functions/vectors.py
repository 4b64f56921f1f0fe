"""Vectors as array columns, and a deterministic embedding by signed feature hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.batches import Tokens, each


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(0.0)


def hash_cells(tokens: DataFrame, keys: list[str], dims: int = 64) -> DataFrame:
    """Of rows (keys, token): bucket and value of the cells that aren't 0, integer sums of signs.

    The bucket is the first 8 hex digits of the token's MD5, modulo dims; an even 9th digit counts +1, an odd one -1.
    """
    digest = F.md5(F.col("token").cast("binary"))
    bucket = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dims).cast("int")
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    cells = tokens.select(*keys, bucket.alias("bucket"), sign.alias("sign")).groupBy(*keys, "bucket").agg(F.sum("sign").alias("value"))
    return cells.where("value <> 0")


def embed(rows: DataFrame, key: str, dims: int = 64, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns ``keep``, and embedding, the hashed embedding of each row's lower-cased text, as integers. Each distinct word of a batch is hashed once."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        v = Tokens(b.column("lowered")).vectors(dims)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * dims, pa.int32()), pa.array(v.reshape(-1)))
        return pa.RecordBatch.from_arrays([b.column("key"), *(b.column(c) for c in keep), lists], ["key", *keep, "embedding"])

    kinds = dict(rows.dtypes)
    made = rows.select(F.col(key).alias("key"), *keep, F.lower("text").alias("lowered")).mapInArrow(each(run), ", ".join([f"key {kinds[key]}", *(f"{c} {kinds[c]}" for c in keep), "embedding array<long>"]))
    return made.withColumnRenamed("key", key)


def text_cells(rows: DataFrame, key: str, dims: int = 64) -> DataFrame:
    """key, bucket and value of the cells of texts, as they are, that aren't 0; rows of one key are summed."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        v = Tokens(b.column("text")).vectors(dims)
        i, bucket = np.nonzero(v)
        return pa.RecordBatch.from_arrays([b.column("key").take(pa.array(i)), pa.array(bucket, pa.int32()), pa.array(v[i, bucket])], ["key", "bucket", "value"])

    kind = dict(rows.dtypes)[key]
    cells = rows.select(F.col(key).alias("key"), "text").mapInArrow(each(run), f"key {kind}, bucket int, value long")
    return cells.groupBy(F.col("key").alias(key), "bucket").agg(F.sum("value").alias("value")).where("value <> 0")

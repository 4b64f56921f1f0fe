"""Where results go: partitioned tables, keyed overwrite, write-once tables, JSON and server-sent events."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_partitioned(rows: DataFrame, path: str, *by: str) -> None:
    """Replace only the partitions that ``rows`` have."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_once(rows: DataFrame, path: str) -> None:
    """Keep what is there."""
    rows.write.mode("ignore").parquet(path)


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key: the last by ``order``. With a union of stored and new rows, insert-or-replace."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def json_rows(answers: DataFrame) -> DataFrame:
    return answers.select(F.to_json(F.struct(*answers.columns)).alias("json"))


def server_sent_events(tokens: Iterable[str]) -> Iterator[str]:
    """Frames of a token stream, empty tokens left out, and the one that ends it. The frames' format."""
    for t in tokens:
        if t:
            yield f"data: {json.dumps({'token': t})}\n\n"
    yield "data: [DONE]\n\n"

"""Two streams joined within a range of time, with state that goes as time passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, key: str, within: str = "1 hour", late: str = "1 day", how: str = "inner") -> DataFrame:
    """Rows of two streams (key, ts, ...) with equal keys where the right one's time is in [ts, ts + within] of the left one.

    Rows later than the watermark of both allows are left out; a row is kept for the other side until no partner can come any
    more. With ``leftOuter``, a left row that had no partner is given then, its right columns null: so it comes once, and late by
    ``within`` and the watermark. Right columns, the key's too, are named with ``right_`` in front.
    """
    a = left.withWatermark("ts", late)
    b = right.select([F.col(c).alias(f"right_{c}") for c in right.columns]).withWatermark("right_ts", late)
    on = (F.col(key) == F.col(f"right_{key}")) & (F.col("right_ts") >= F.col("ts")) & (F.col("right_ts") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, on, how)

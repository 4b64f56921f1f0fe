"""Structured Streaming: windowed counts, sessions, deduplication, incremental ingestion, and the cache's time-to-live."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.functions import clean_html, slug
from lodestone.sources.tables import exists, shared_folder


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream; their times, without a zone in the file, are of the session's zone."""
    path = f"{folder}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*").parquet(_directory(spark, path))
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _directory(spark: SparkSession, path: str) -> str:
    """A file stream reads folders: a single file is named by a pattern."""
    return path if path.endswith("/") else path + "*"


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def distinct_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sliding(events: DataFrame, width: str = "1 day", step: str = "6 hours", late: str = "1 day") -> DataFrame:
    w = F.window("ts", width, step)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def with_ttl(questions: DataFrame, ttl_seconds: int = 3600, late: str = "1 day") -> DataFrame:
    """Of a stream (key, ts): key, ts and whether an entry of the key, kept for the time-to-live, is live.

    A key has one state, which goes when the watermark passes its expiry. Rows later than the watermark allows are no
    less answered, but may find their key's state gone.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("ts")
        expires = state.get[0] if state.exists else None
        hits = []
        for t in rows["ts"].astype("int64") // 1000:
            live = expires is not None and t < expires
            hits.append(live)
            if not live:
                expires = int(t) + ttl_seconds * 1_000_000
        state.update((expires,))
        state.setTimeoutTimestamp(max(expires // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"].to_numpy(), "hit": hits})

    rows = questions.withWatermark("ts", late).groupBy("key")
    return rows.applyInPandasWithState(run, "key long, ts timestamp, hit boolean", "expires long", "append", GroupStateTimeout.EventTimeTimeout)


def ingest_pages(pages: DataFrame, target: str, checkpoint: str, collection: str) -> None:
    """Clean pages as they come and add those whose URL the collection doesn't have; running twice adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(["url"]).select(F.lit(collection).alias("collection"), "url", slug(F.col("url")).alias("slug"), clean_html(F.col("html")).alias("text")).where("text <> ''")
        if exists(spark, target):
            rows = rows.join(spark.read.parquet(target).where(F.col("collection") == collection).select("url"), "url", "left_anti")
        rows.write.mode("append").partitionBy("collection").parquet(target)

    pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run over what there is, and return the result table, which is written with its checkpoint to the shared folder.

    A batch has a folder of its own, so one that runs again replaces what it wrote. ``complete``: the last batch is the table.
    """
    spark, folder = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    batches: list[int] = []

    def add(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={k}")
        batches.append(k)

    stream.writeStream.foreachBatch(add).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    wanted = sorted(set(batches))[-1:] if mode == "complete" else sorted(set(batches))
    if not wanted:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(f"{folder}/table/batch={k}" for k in wanted))

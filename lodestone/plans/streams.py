"""Streaming queries over the events; a stream run to its end equals the batch, which the SQL computes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.registry import query
from lodestone.sources.tables import load
from lodestone.streaming import cache as SC
from lodestone.streaming import windows as S
from lodestone.streaming.joins import interval_join


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return S.run_to_table(S.tumbling(S.event_stream(spark, sf))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, s")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return S.run_to_table(S.sessions(S.event_stream(spark, sf))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT make_timestamp((CAST(floor(epoch(ts) / 21600) AS BIGINT) - k) * 21600 * 1000000) AS start, event_type, count(*) AS n FROM events, range(0, 4) t(k) GROUP BY ALL")
def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of a day every six hours."""
    return S.run_to_table(S.sliding(S.event_stream(spark, sf))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Each event twice in the stream, counted once."""
    e = S.event_stream(spark, sf)
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return S.run_to_table(S.distinct_events(twice).select("event_type"), "append").groupBy("event_type").agg(F.count("*").alias("n"))


@query()
def stream_cache_ttl(spark: SparkSession, sf: str) -> DataFrame:
    """Users' events as questions against a cache of an hour: hits and misses by user. A walk along time, so no SQL."""
    rows = S.with_ttl(S.event_stream(spark, sf).select(F.col("user_id").alias("key"), "ts"))
    return S.run_to_table(rows, "append").groupBy(F.col("key").alias("user_id")).agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.when(~F.col("hit"), 1)).alias("misses"))


_PAIRS = "FROM (SELECT * FROM events WHERE event_type = 'click') a {0} JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR"


def _clicks_and_purchases(spark: SparkSession, sf: str, how: str) -> DataFrame:
    events = S.event_stream(spark, sf).select("event_id", "user_id", "ts", "event_type")
    clicks, purchases = (events.where(F.col("event_type") == x).drop("event_type") for x in ("click", "purchase"))
    return interval_join(clicks, purchases, "user_id", "6 hours", "1 day", how)


@query(f"SELECT a.event_id AS click, b.event_id AS purchase, a.user_id {_PAIRS.format('')}")
def stream_interval_join(spark: SparkSession, sf: str) -> DataFrame:
    """Two streams: purchases of a user within six hours of a click."""
    out = _clicks_and_purchases(spark, sf, "inner")
    return S.run_to_table(out.select(F.col("event_id").alias("click"), F.col("right_event_id").alias("purchase"), "user_id"), "append")


@query(f"SELECT a.event_id AS click, coalesce(b.event_id, -1) AS purchase, a.user_id {_PAIRS.format('LEFT')} WHERE a.ts < (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def stream_outer_join(spark: SparkSession, sf: str) -> DataFrame:
    """The same, with clicks that had no purchase (-1): given out when none can come any more, so those of the stream's last days still wait."""
    end = load(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    out = _clicks_and_purchases(spark, sf, "leftOuter").where(F.col("ts") < F.lit(end) - F.expr("INTERVAL 3 DAYS"))
    return S.run_to_table(out.select(F.col("event_id").alias("click"), F.coalesce("right_event_id", F.lit(-1)).alias("purchase"), "user_id"), "append")


_NEAR = "round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) * list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4)"


@query(f"""WITH near AS (SELECT * FROM (SELECT a.vec_id AS u, b.vec_id AS w, {_NEAR} AS similarity FROM embeddings a, embeddings b) WHERE similarity >= 0.95)
SELECT qid, entry, similarity FROM (SELECT q.event_id AS qid, e.event_id AS entry, similarity, row_number() OVER (PARTITION BY q.event_id ORDER BY similarity DESC, e.ts, e.event_id) AS k
FROM events q JOIN near ON u = q.user_id JOIN events e ON e.user_id = w AND (e.ts, e.event_id) < (q.ts, q.event_id) AND q.ts < e.ts + INTERVAL 1 HOUR) WHERE k = 1""")
def stream_semantic_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Events as questions, each with its user's vector, against the entries that the hour before left: state in cells, by timers."""
    vectors = SC.placed(load(spark, sf, "embeddings").select(F.col("vec_id").alias("user_id"), "embedding"), 64)
    asked = S.event_stream(spark, sf).select(F.col("event_id").alias("qid"), "user_id", "ts").join(vectors, "user_id")
    before = spark.conf.get(SC.STORE, None)
    spark.conf.set(SC.STORE, SC.ROCKS)
    try:
        found = S.run_to_table(SC.lookups(asked.withColumn("collection", F.lit("events")), 64), "append")
    finally:
        spark.conf.unset(SC.STORE) if before is None else spark.conf.set(SC.STORE, before)
    return SC.best(found)

"""Replies, aggregates and table functions of one's own, and streams that are joined."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import aggregates as G
from lodestone.functions import replies as R
from lodestone.functions.tables import register


def decoded(spark, column, replies):
    return [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string").orderBy("i").select(column).collect()]


def test_replies_that_are_malformed_get_a_default(spark):
    reply = F.col("reply")
    good = ['{"a": ["x", "y"]}', ' ```json\n{"a": ["x"]}\n``` ', '{"a": ["x", 1, null, true, ["y"], {"b": 1}, "z"]}']
    bad = ['{"a": ["x"', '{"b": ["x"]}', '{"a": "x"}', '{"a": []}', '{"a": [1, null]}', '["x"]', "plain text", "", None, "null", "3"]
    got = decoded(spark, R.decode_strings(reply, "a", F.array(F.lit("default"))), good + bad)
    assert got == [["x", "y"], ["x"], ["x", "z"]] + [["default"]] * len(bad)
    triples = ['{"t": [["A", "b", "C"], ["a", "b"], ["a", "b", 3], "a b c", ["a", "b", "c", "d"], null, ["D", "e", "f"]]}', '{"t": {}}', '{"t": [', None]
    assert decoded(spark, R.decode_triples(reply, "t"), triples) == [[["a", "b", "c"], ["d", "e", "f"]], [], [], []]
    scores = ['{"s": 0.25}', '{"s": 1}', '{"s": 0}', '{"s": "0.5"}', '{"s": 1.5}', '{"s": -0.1}', '{"s": null}', '{"s": true}', "{", "{}", None]
    assert decoded(spark, R.decode_score(reply, "s", 1.0), scores) == [0.25, 1.0, 0.0] + [1.0] * 8
    labels = ['{"l": " HowTo "}', '{"l": "other"}', '{"l": 3}', "x", None]
    assert decoded(spark, R.decode_label(reply, "l", ("howto", "precise"), "precise"), labels) == ["howto"] + ["precise"] * 4


def test_an_aggregate_of_ones_own_merges_states(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(("a", "b", None)[i % 3], float(x)) for i, x in enumerate(rng.gamma(2, 3, 900) + 1e6)] + [("c", 5.0), ("c", 5.0), ("d", None), ("e", float("nan")), ("one", 2.0)]
    frame = spark.createDataFrame(rows, "g string, x double").repartition(7)
    for held in (G.HELD, 1):
        monkeypatch.setattr(G, "HELD", held)
        got = {r["g"]: r for r in G.aggregate(frame, ["g"], "x", G.Moments()).collect()}
        assert set(got) == {"a", "b", None, "c", "one"}
        for g in ("a", "b", None):
            x = np.array([v for k, v in rows if k == g])
            d = x - x.mean()
            want = (len(x), x.mean(), (d**2).mean(), (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2 - 3)
            assert tuple(got[g])[1:] == pytest.approx(want, rel=1e-6)
        assert tuple(got["c"])[1:] == (2, 5.0, 0.0, None, None) and got["one"]["n"] == 1
    assert G.aggregate(frame.where("false"), ["g"], "x", G.Moments()).collect() == []


def test_table_functions_from_sql(spark):
    register(spark)
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(8)] + [(2, 0, "assistant", "first"), (3, 0, "user", None), (3, 1, "assistant", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4).createOrReplaceTempView("some_turns")
    got = spark.sql("SELECT * FROM dialogue_windows(TABLE(some_turns) PARTITION BY conv_id ORDER BY turn)").collect()
    assert sorted((r["conv_id"], r["turn"], r["history"], r["answer"]) for r in got) == [(1, 1, "t0", "t1"), (1, 3, "t0\nt1\nt2", "t3"), (1, 5, "t2\nt3\nt4", "t5"), (1, 7, "t4\nt5\nt6", "t7"), (2, 0, "", "first"), (3, 1, "", None)]
    windows = spark.sql("SELECT w.* FROM VALUES ('k', 'a b c d e'), ('l', '') AS v(k, t), LATERAL token_windows(k, t, 3, 2) w").collect()
    assert sorted(tuple(r) for r in windows) == [("k", 0, 3, "a b c"), ("k", 2, 3, "c d e")]


def test_streams_join_within_an_interval(spark, tmp_path):
    """Rows of one time find each other over batches, late ones are left out, and a row without a partner comes when none can come."""
    from lodestone.streaming.joins import interval_join

    def put(name, rows):
        spark.createDataFrame(rows, "id string, u int, ts string").select("id", "u", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")

    def run():
        out = []
        a, b = (spark.readStream.schema("id string, u int, ts timestamp").parquet(f"{tmp_path}/{n}") for n in "ab")
        both = interval_join(a, b, "u", "1 hour", "1 day", "leftOuter").select("id", "right_id")
        stream = both.writeStream.foreachBatch(lambda d, _: out.extend(tuple(r) for r in d.collect())).option("checkpointLocation", f"{tmp_path}/check").outputMode("append")
        stream.trigger(availableNow=True).start().awaitTermination()
        return sorted(out, key=str)

    put("a", [("a1", 1, "2024-01-01 10:00:00"), ("a2", 2, "2024-01-01 10:00:00"), ("a3", 1, "2024-01-05 00:00:00")])
    put("b", [("b1", 1, "2024-01-01 11:00:00"), ("b2", 1, "2024-01-01 11:00:01"), ("b3", 2, "2024-01-01 09:59:59"), ("b4", 1, "2024-01-05 00:00:00")])
    assert run() == [("a1", "b1"), ("a2", None), ("a3", "b4")]
    put("a", [("a4", 3, "2024-01-09 00:00:00"), ("late", 1, "2024-01-01 10:30:00")])
    put("b", [("b5", 9, "2024-01-09 00:00:00"), ("b6", 1, "2024-01-05 01:00:00")])
    assert run() == [("a3", "b6")]
    put("a", [("a5", 4, "2024-01-12 00:00:00")])
    put("b", [("b7", 9, "2024-01-12 00:00:00")])
    assert run() == [("a4", None)]

"""Nearest vectors, the vector index, the inverted index and the commit log."""

import dataclasses
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.config import DEFAULT
from lodestone.operators import blocks, retrieval


def brute_nearest(vectors, questions, k, others=False):
    out = []
    for qid, q in questions:
        rows = []
        for i, v in vectors:
            if q is None or v is None or not v or len(v) != len(q) or None in v or i is None or (others and i == qid):
                continue
            scale = float(np.linalg.norm(v) * np.linalg.norm(q))
            s = float(np.dot(v, q)) / scale if scale else 0.0
            rows.append((-round(s, 6) + 0.0, i))
        out += [(qid, n + 1, i, -s) for n, (s, i) in enumerate(sorted(rows)[:k])]
    return sorted(out)


def some_vectors(seed, n, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims)) * 3
    return [(i, [float(c) for c in np.round(centres[rng.integers(6)] + rng.normal(size=dims), 3)]) for i in range(n)]


def close(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-6)


def test_dense_topk_is_the_same_at_any_number_of_questions(spark):
    vectors = some_vectors(1, 300) + [(1000, [1.0, 2.0]), (1001, None), (1002, []), (1003, [0.0] * 8), (1004, [1.0] * 7 + [None]), (None, [1.0] * 8)]
    questions = some_vectors(2, 40) + [(500, None), (501, [3.0, 1.0]), (502, [0.0] * 8)]
    v = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame(questions, "qid long, q array<double>")
    want = brute_nearest(vectors, questions, 5)
    for most in (DEFAULT.broadcast_bytes, 0):
        config = dataclasses.replace(DEFAULT, broadcast_bytes=most)
        out = retrieval.dense_topk(v, q, 5, config, others=False)
        close(sorted((r["qid"], r["rank"], r["vec_id"], r["score"]) for r in out.collect()), want)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scores_of_two_blocks_are_computed_in_bounded_memory():
    rng = np.random.default_rng(3)
    block = lambda n: (np.arange(n), np.full(n, ""), rng.integers(-9, 9, (n, 64)).astype(float))
    v, q = block(2048), block(2048)
    tracemalloc.start()
    try:
        got = [(list(ids), list(score)) for _, ids, score in blocks.nearest(v, q, 3, True, 6)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 30e6  # all 4,194,304 scores are 34 MB, and were held some times over
    length = lambda m: np.sqrt((m * m).sum(1))
    score = np.round(q[2] @ v[2].T / (length(q[2])[:, None] * length(v[2])[None, :]), 6)
    for i in (0, 127, 128, 129, 2047):
        want = [j for j in np.lexsort((np.arange(2048), -score[i])) if j != i][:3]
        assert got[i][0] == want and got[i][1] == pytest.approx(score[i][want], abs=2e-6)


def test_vectors_are_compared_by_the_worker_that_reads_them(spark):
    v = spark.createDataFrame(some_vectors(1, 50), "vec_id long, embedding array<float>")
    plan = retrieval.dense_topk(v, v.where("vec_id < 9").selectExpr("vec_id AS qid", "embedding AS q"), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_dense_topk_within_groups_and_string_ids(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [1.0, 0.1], None), ("c", [0.9, 0.1], "x")], "vec_id string, embedding array<double>, g string")
    q = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("z", [1.0, 0.0], None)], "qid string, q array<double>, g string")
    for most in (1 << 20, 0):
        out = retrieval.dense_topk(v, q, 3, dataclasses.replace(DEFAULT, broadcast_bytes=most), by="g")
        assert sorted((r["qid"], r["vec_id"]) for r in out.select("qid", "vec_id").collect()) == [("a", "c"), ("z", "b")]
        assert out.where(F.col("qid") == "nobody").count() == 0


# --- the commit log


def test_commits_are_whole_and_numbered_once(spark, tmp_path):
    from lodestone.sources.commits import Commits, Taken

    log, other = Commits(spark, str(tmp_path)), Commits(spark, str(tmp_path))
    assert log.last() == (0, {}) and log.get("nothing") is None
    folders = [log.new_folder() for _ in range(4)]
    for f in folders:
        spark.range(3).write.parquet(f"{f}/t")
    for v in (1, 2, 3):
        log.commit(v, {"tables": {"t": f"{folders[v - 1]}/t"}, "é": v})
    with pytest.raises(Taken):
        other.commit(3, {"tables": {}})
    assert other.last() == (3, {"tables": {"t": f"{folders[2]}/t"}, "é": 3}) and other.versions() == [1, 2, 3]
    gone = log.vacuum(2)
    assert sorted(gone) == sorted(f.rsplit("/", 1)[1] for f in (folders[0], folders[3])) and log.versions() == [2, 3]
    assert spark.read.parquet(other.read(2)["tables"]["t"]).count() == 3
    with pytest.raises(Taken):
        log.commit(1, {})


# --- the inverted index


TEXTS = ["the cat sat on the mat", "the dog sat", "cats and dogs", None, "", "a mat for the cat, the cat's mat", "zebra"] + [f"word{i} common filler the" for i in range(60)]


def test_segments_give_the_scores_of_one_index(spark, tmp_path):
    from lodestone.operators.inverted_index import InvertedIndex

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("extra", F.lit(1))
    questions = spark.createDataFrame([(0, "the cat"), (1, "zebra mat mat"), (2, "nowhere"), (3, None), (4, "word7 common")], "qid long, text string")
    index = InvertedIndex(spark, str(tmp_path))
    assert index.search(questions).collect() == []
    assert index.add(docs.where("doc_id < 20")) == 1
    before = sorted(map(tuple, index.search(questions, 50).collect()))
    assert index.add(docs.where("doc_id >= 15")) == 2  # five are there already
    assert index.add(docs) == 2
    rows = lambda d: sorted(map(tuple, d.collect()))
    whole = docs.withColumn("text", F.coalesce("text", F.lit("")))
    assert rows(index.search(questions, 50)) == rows(retrieval.bm25_topk(whole, questions, 50))
    assert rows(index.search(questions, 50, version=1)) == before == rows(retrieval.bm25_topk(whole.where("doc_id < 20"), questions, 50))
    few = dataclasses.replace(DEFAULT, broadcast_rows=1)
    assert rows(InvertedIndex(spark, str(tmp_path), few).search(questions, 50)) == rows(index.search(questions, 50))


def test_a_question_reads_the_files_that_can_hold_its_words(spark, tmp_path, monkeypatch):
    from lodestone.operators import inverted_index as I

    monkeypatch.setattr(I, "FILE", 30)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    index = I.InvertedIndex(spark, str(tmp_path))
    index.add(docs)
    hit, every = index.files(["zebra"])
    assert len(hit) == 1 and every > 4 and index.files(["0000", "zzzz"])[0] == []
    scores = index.scores(spark.createDataFrame([(0, "zebra")], "qid long, text string"))
    scanned = [f for f in scores.inputFiles() if "/postings/" in f]
    assert [f.rsplit("/", 1)[1] for f in scanned] == [hit[0].rsplit("/", 1)[1]]
    assert "In(term" in scores._jdf.queryExecution().executedPlan().toString() or "EqualTo(term" in scores._jdf.queryExecution().executedPlan().toString()
    assert [r["doc_id"] for r in scores.collect()] == [6]


# --- the vector index


def test_the_vector_index_is_exact_and_reads_a_part(spark, tmp_path):
    from lodestone.operators.vector_index import VectorIndex

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 12))
    vectors = [(i, [float(c) for c in centres[i % 40] + rng.normal(size=12) * 0.05]) for i in range(4000)]
    vectors += [(9000, [0.0] * 12), (9001, [1.0, 2.0]), (9002, None), (9003, []), (9004, [1.0] * 11 + [None]), (None, [1.0] * 12)] + [(9100 + i, vectors[0][1]) for i in range(9)]
    questions = [(i, v) for i, v in vectors[:30]] + [(5000, [0.0] * 12), (5001, [2.0, 1.0]), (5002, None), (5003, [1.0] * 5)]
    v = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(6)
    q = spark.createDataFrame(questions, "qid long, q array<double>")
    index = VectorIndex(spark, str(tmp_path))
    assert index.search(q).collect() == []
    index.add(v.where("vec_id < 2000"), cells=40)
    index.add(v.where("vec_id >= 2000"))
    for others in (True, False):
        hits, read = index.probes(q, 5, others)
        close(sorted(map(tuple, hits.collect())), brute_nearest(vectors, questions, 5, others))
        share = {r["qid"]: r["compared"] / r["vectors"] for r in read.collect()}
        assert max(share[i] for i in range(30)) < 0.5 and share[5000] > 0.99
    want = retrieval.dense_topk(v.where("vec_id < 2000"), q, 5).collect()
    close(sorted(map(tuple, index.search(q, 5, version=1).collect())), sorted(map(tuple, want)))

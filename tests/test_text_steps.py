"""Steps that are done where a text is: the same rows as by joins, and what they hold and shuffle."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions.batches import SLICE, Tokens, each, parts
from lodestone.functions.vectors import embed
from lodestone.operators import chunking as C
from lodestone.operators import retrieval as R
from lodestone.operators.inverted_index import InvertedIndex
from lodestone.operators.mining import plain_words
from lodestone.operators.vector_index import VectorIndex


@pytest.fixture(scope="module")
def corpus(spark):
    words = [f"w{i}" for i in range(40)] + ["the"] * 20
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(words, rng.integers(0, 30))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate([*texts, *texts[:20], None, " \t\n"])]  # copies tie
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    asked = [(f"q{i}", " ".join(rng.choice([*words, "nowhere"], 6))) for i in range(12)]
    return docs, spark.createDataFrame([*asked, ("none", "nowhere"), ("blank", ""), ("null", None)], "qid string, text string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def shuffled(df):
    """What stands below the plan's first shuffle."""
    return df._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)[1]


def test_bm25_in_tasks(corpus, monkeypatch):
    docs, asked = corpus
    got = R.bm25_topk(docs, asked, 5)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString(), "a text is scored where it is"
    monkeypatch.setattr(R, "CELLS", 0)
    assert rows(got) == rows(R.bm25_topk(docs, asked, 5)) and got.count() > 50


def test_bm25_in_tasks_with_negative_idf(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a a"), (2, "a"), (3, "a")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "A"), (2, "b")], "qid long, text string")
    got = rows(R.bm25_topk(docs, asked, 2))
    monkeypatch.setattr(R, "CELLS", 0)
    assert got == rows(R.bm25_topk(docs, asked, 2)) and len(got) == 2


def test_dense_in_one_worker(corpus):
    docs, asked = corpus
    q = embed(asked, "qid").withColumnRenamed("embedding", "q")
    got = R.dense_texts_topk(docs, q, 4)
    assert shuffled(got).count("MapInArrow") == 1
    vectors = embed(docs.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    assert rows(got) == rows(R.dense_topk(vectors, q, 4, others=False))


def test_rerank_leaves_texts_where_they_are(corpus):
    docs, asked = corpus
    hits = R.bm25_topk(docs, asked, 5).select("qid", F.col("rank").alias("pos"), "doc_id")
    plan = R.rerank(hits, asked, docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2


def test_slices_are_of_few_bytes():
    batch = pa.record_batch([pa.array(["x" * 100_000] * 300)], ["text"])
    sizes = [p.num_rows for p in parts(batch)]
    assert sum(sizes) == 300 and max(sizes) <= SLICE // 100_000


def test_tokens_split_at_the_same_spaces():
    t = Tokens(pa.array([" a\tb\n\x0bc\x0c\rd  e f g ", None, "", "\n"]))
    assert t.words.take(pa.array(t.code)).to_pylist() == ["a", "b", "c", "d", "e f g"] and set(t.owner.tolist()) == {0}


def test_counts_of_a_task_are_added_up(corpus, monkeypatch):
    docs, _ = corpus
    whole = R.corpus_stats(docs)
    monkeypatch.setattr(R, "HELD", 10)
    again = R.corpus_stats(docs)
    assert rows(whole[0]) == rows(again[0]) and whole[1:] == again[1:]


def test_index_keeps_no_texts(spark, tmp_path):
    index = InvertedIndex(spark, f"file://{tmp_path}/index")
    first = [(1, "a b"), (2, None), (3, "b b b"), (3, "b b b"), (None, "c")]
    assert index.add(spark.createDataFrame(first, "doc_id long, text string")) == 1
    assert index.add(spark.createDataFrame([(1, "z"), (4, ""), (4, ""), (5, "a")], "doc_id long, text string")) == 2
    assert index.add(spark.createDataFrame([(5, "y")], "doc_id long, text string")) == 2
    state = index.log.last()[1]
    got = [spark.read.parquet(f"{s['folder']}/docs") for s in state["segments"]]
    assert [x.columns for x in got] == [["doc_id", "dl"]] * 2
    assert [rows(x) for x in got] == [[(1, 2), (2, 0), (3, 3)], [(4, 0), (5, 1)]]
    assert (state["docs"], state["words"]) == (5, 6) and all(lo is not None for s in state["segments"] for _, lo, _ in s["files"])
    whole = spark.createDataFrame([(1, "a b"), (2, None), (3, "b b b"), (4, ""), (5, "a")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "A b"), (2, "z")], "qid long, text string")
    assert rows(index.search(asked, 5)) == rows(R.bm25_topk(whole, asked, 5))


def test_index_of_empty_documents(spark, tmp_path):
    index = InvertedIndex(spark, f"file://{tmp_path}/index")
    assert index.add(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")) == 1
    assert index.search(spark.createDataFrame([(1, "a")], "qid long, text string")).count() == 0


def test_words_without_punctuation_at_their_ends(spark):
    texts = ["(A.b) --c-d!? ... 'x' y--", "", " . ", "e" + "-" * 5000 + "f", "g.\u2028 h.", "¿i? j…"]
    want = [["a.b", "c-d", "x", "y"], [], [], ["e" + "-" * 5000 + "f"], ["g.\u2028", "h"], ["¿i", "j…"]]  # as the SQL: only a word's very end counts
    got = spark.createDataFrame(list(enumerate(texts)), "i long, x string").orderBy("i").select(plain_words(F.col("x"))).collect()
    assert [r[0] for r in got] == want


def test_vectors_of_an_index_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(100)], "vec_id long, embedding array<double>")
    VectorIndex(spark, f"file://{tmp_path}/index").add(vectors.mapInArrow(run, vectors.schema))
    assert made.value == 100


def test_chunks_are_made_of_few_bytes_at_once():
    seen = []
    batch = pa.record_batch([pa.array(["x" * 100_000] * 50)], ["text"])
    list(each(lambda b: seen.append(b.num_rows), most=C.SLICE)(iter([batch])))
    assert sum(seen) == 50 and max(seen) * 100_000 <= 1 << 20

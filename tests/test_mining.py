"""Phrases, entities and relations of a corpus, and re-ranking by places, against loops in memory."""

import math
import random
import re
import string
from collections import Counter

from pyspark.sql import functions as F

from lodestone.config import DEFAULT
from lodestone.operators import mining as M
from lodestone.operators import positions as P

PUNCT = string.punctuation


def brute_mining(texts, least):
    split = [[w for w in (x.strip(PUNCT) for x in s.lower().split()) if w] for t in texts for s in re.split(r"(?<=[.!?])\s+", t or "") if s.strip()]
    n = Counter(p for w in split for p in zip(w, w[1:]))
    r, c, every = Counter(), Counter(), sum(n.values())
    for (a, b), k in n.items():
        r[a] += k
        c[b] += k
    known = {}
    for (a, b), k in n.items():
        cells = [(k, r[a] * c[b]), (r[a] - k, r[a] * (every - c[b])), (c[b] - k, (every - r[a]) * c[b]), (every - r[a] - c[b] + k, (every - r[a]) * (every - c[b]))]
        g = 2 * sum(x * math.log(x / (e / every)) for x, e in cells if x > 0)
        if k >= least and g >= 10.83 and k * every > r[a] * c[b]:
            known[a, b] = (k, round(g, 6))
    found, linked = [], []
    for w in split:
        runs = []
        for i, x in enumerate(w):
            if i and (w[i - 1], x) in known:
                runs[-1].append(x)
            else:
                runs.append([x])
        at = [i for i, x in enumerate(runs) if len(x) > 1]
        found += [" ".join(runs[i]) for i in at]
        linked += [(" ".join(runs[i]), " ".join(" ".join(x) for x in runs[i + 1 : j]), " ".join(runs[j])) for i, j in zip(at, at[1:]) if 2 <= j - i <= 6]
    return known, sorted(found), sorted(linked)


def test_mining_against_loops(spark):
    rng = random.Random(1)
    fill = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(80):
        w = rng.choices(fill, k=rng.randint(0, 12))
        for phrase in rng.sample(["New York City", "machine learning", "(open source)", "big, apple"], rng.randint(0, 3)):
            w.insert(rng.randint(0, len(w)), phrase)
        texts.append(" ".join(w) + rng.choice([".", "! Short one. ", "? ... -- ", ""]))
    texts += [None, "", "one", ". . ."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pos", F.lit("clash"))
    words = M.sentence_words(docs)
    known = M.collocations(words, 5)
    want, found, linked = brute_mining(texts, 5)
    assert {(x["a"], x["b"]): (x["n"], x["llr"]) for x in known.collect()} == want and ("new", "york") in want
    runs = M.segments(words, known)
    assert sorted(x["entity"] for x in M.entities(runs).collect()) == found and "new york city" in found
    assert sorted((x["subject"], x["relation"], x["object"]) for x in M.relations(runs).collect()) == linked and linked
    none = M.sentence_words(docs.where("false"))
    assert M.collocations(none).count() == 0 and M.segments(none, known).count() == 0


def test_smallest_window_against_all_windows():
    rng = random.Random(2)
    for _ in range(300):
        words = rng.choices("abcdef", k=rng.randint(0, 12))
        wanted = set(rng.choices("abcz", k=rng.randint(0, 4)))
        here = wanted & set(words)
        spans = [j - i for i in range(len(words)) for j in range(i + 1, len(words) + 1) if here <= set(words[i:j])]
        assert P.smallest_window(words, wanted) == ((len(here), min(spans)) if here else (0, 0))
    assert P.phrase_hits("a b c a b".split(), "a b a b d".split()) == 1


def test_reranking_by_places(spark):
    docs = spark.createDataFrame([(1, "clock of the old harbour"), (2, "the old clock tower"), (3, "clock " + "x " * 40 + "old"), (4, None), (5, "nothing")], "doc_id long, text string")
    hits = spark.createDataFrame([(0, i, i) for i in range(1, 6)] + [(1, 1, 1)], "qid long, pos int, doc_id long")
    asked = spark.createDataFrame([(0, "Old clock"), (1, "")], "qid long, text string")
    got = P.rerank(hits, asked, docs, 5, DEFAULT).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["doc_id"], r["matched"], r["stretch"], r["phrases"]) for r in got] == [(0, 2, 2, 2, 1), (0, 1, 2, 4, 0), (0, 3, 2, 42, 0), (0, 4, 0, 0, 0), (0, 5, 0, 0, 0), (1, 1, 0, 0, 0)]
    assert got[0]["score"] == 2.0


def test_relations_of_a_graph_context_are_made_once(spark):
    """However many steps read the edges, their texts are parsed once: by the checkpoint, not in the plan."""
    from lodestone.operators import knowledge as K

    docs = spark.createDataFrame([(i, f"word{i} leads to{i} word{i + 1} again. word{i} knows word{i + 1} well.") for i in range(6)], "doc_id long, text string")
    seeds = spark.createDataFrame([(1, "word2")], "qid long, node string")
    out = K.graph_context(K.relations(docs), seeds)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 0 and "CartesianProduct" not in plan
    assert out.first()["context"].startswith(K.GRAPH_HEADER)


def shuffled_rows(spark):
    """Rows that the stages run so far have shuffled."""
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, quantiles, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_graph_context_against_loops_with_words_that_all_questions_have(spark):
    """Common words make no row for each question and edge: what is shuffled stays near the edges, and results are those of loops."""
    from dataclasses import replace

    from lodestone.operators import knowledge as K

    rng = random.Random(7)
    name = lambda: f"n{min(int(rng.expovariate(0.25)), 60)}"
    edges = [(i // 3, i % 3, name(), f"r{i}", name()) for i in range(1500)] + [(900, 0, "rare", "r", "rarer"), (901, 0, "rarer", "r", "n0")]
    seeds = sorted({(q, f"n{x}") for q in range(150) for x in (0, q % 9)} | {(500, "rare"), (501, "n50"), (501, "n55"), (502, "none")})
    rows = spark.createDataFrame(edges, "doc_id long, pos int, subject string, relation string, object string")
    asked = spark.createDataFrame(seeds, "qid long, node string")
    for hops in (1, 2, 3):
        want = {}
        for q in {q for q, _ in seeds}:
            near = {n for k, n in seeds if k == q}
            for _ in range(hops - 1):
                near |= {b for _, _, s, _, o in edges for a, b in ((s, o), (o, s)) if a in near}
            lines = [f"{s} → {r} → {o}" for _, _, s, r, o in edges if s in near and o in near][:20]
            if lines:
                want[q] = K.GRAPH_HEADER + "\n".join(lines)
        before = shuffled_rows(spark)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
        try:
            got = K.graph_context(rows, asked, replace(DEFAULT, graph_hops=hops)).collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert {r["qid"]: r["context"] for r in got} == want
        if hops == 2:
            assert shuffled_rows(spark) - before < 20 * len(edges)


def test_runs_are_cut_where_the_sentence_is(spark):
    """Without a shuffle of words, the same runs as by dealing words out, also of sentences that are longer than a batch."""
    rng = random.Random(11)
    sentences = [[f"w{rng.randint(0, 9)}" for _ in range(n)] for n in (1, 2, 30, 25_000, 0, 12_000, 7)]
    words = spark.createDataFrame([(i // 2, i % 2, w) for i, w in enumerate(sentences)], "doc_id long, pos int, w array<string>").coalesce(1)
    known = spark.createDataFrame([("w1", "w2"), ("w2", "w3"), ("w4", "w4")], "a string, b string")
    before = shuffled_rows(spark)
    got = sorted(tuple(r) for r in M.segments(words, known).collect())
    assert shuffled_rows(spark) - before < 100
    held, M.PAIRS = getattr(M, "PAIRS", 0), 0
    try:
        assert sorted(tuple(r) for r in M.segments(words, known).collect()) == got and len(got) > 30_000
    finally:
        M.PAIRS = held


def test_pairs_and_relations_are_not_dealt_out_as_rows(spark, monkeypatch):
    """Pairs are shuffled as a few packed runs, and entities and relations not at all, however the limits cut them up."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(90)] + ["naïve", "東京"]
    texts = [" ".join(rng.choices(vocabulary, k=40)) + rng.choice([". ", "! "]) + " ".join(rng.choices(["New York", "open source", "naïve 東京", *vocabulary[:9]], k=9)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = M.sentence_words(docs)
    want, found, linked = brute_mining(texts, 5)
    distinct = len({p for w in words.collect() for p in zip(w["w"], w["w"][1:])})
    before = shuffled_rows(spark)
    known = M.collocations(words).localCheckpoint()
    assert {(x["a"], x["b"]): (x["n"], x["llr"]) for x in known.collect()} == want
    assert shuffled_rows(spark) - before < distinct / 2
    before = shuffled_rows(spark)
    assert sorted(x["entity"] for x in M.entities_of(words, known).collect()) == found
    assert sorted((x["subject"], x["relation"], x["object"]) for x in M.relations_of(words, known).collect()) == linked and linked
    assert shuffled_rows(spark) - before < 20 * len(want)
    for limits in ({"RANGE": 100}, {"BLOCK": 50, "HELD": 20}, {"VOCABULARY": 30, "BLOCK": 50}, {"VOCABULARY": 0}):
        with monkeypatch.context() as m:
            for name, value in limits.items():
                m.setattr(M, name, value)
            assert {(x["a"], x["b"]): (x["n"], x["llr"]) for x in M.collocations(words).collect()} == want
    with monkeypatch.context() as m:
        m.setattr(M, "PAIRS", 0)
        assert sorted(x["entity"] for x in M.entities_of(words, known).collect()) == found
        assert sorted((x["subject"], x["relation"], x["object"]) for x in M.relations_of(words, known).collect()) == linked


def test_words_of_one_hash_are_told_apart(monkeypatch):
    """A hash that two words share is replaced, and a word that isn't known is not taken for one that is."""
    import numpy as np
    import pyarrow as pa

    whole = M.Words._hashes
    monkeypatch.setattr(M.Words, "_hashes", lambda self, words: whole(self, words) if self.seed else np.zeros(len(words), np.uint64))
    assert M.Words(pa.array(["a", "b"])).numbers(pa.array(["b", "c", "a", "b"])).tolist() == [1, -1, 0, 1]
    assert M.Words(pa.array(["a"])).numbers(pa.array(["b", "a"])).tolist() == [-1, 0]

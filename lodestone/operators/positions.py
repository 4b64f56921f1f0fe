"""Re-ranking by where a question's words stand in a text: how many there are, how close together, and in what order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, Config
from lodestone.functions import tokens
from lodestone.functions.batches import each
from lodestone.operators.retrieval import hit_texts, top
from lodestone.sources.tables import bounded


def smallest_window(words: list[str], wanted: set[str]) -> tuple[int, int]:
    """How many of ``wanted`` are among the words, and the length of the shortest stretch that holds them all; (0, 0) for none."""
    here = wanted.intersection(words)
    if not here:
        return 0, 0
    best, last = len(words), {}
    for i, w in enumerate(words):
        if w in here:
            last.pop(w, None)
            last[w] = i  # words by their last place, the earliest first
            if len(last) == len(here):
                best = min(best, i - next(iter(last.values())) + 1)
    return len(here), best


def phrase_hits(words: list[str], question: list[str]) -> int:
    """How many of the question's distinct pairs of neighbouring words stand so in the text."""
    return len(set(zip(question, question[1:], strict=False)).intersection(zip(words, words[1:], strict=False)))


def rerank(hits: DataFrame, questions: DataFrame, docs: DataFrame, n: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """qid, rank, doc_id, matched, stretch, phrases and score of the n best hits (qid, pos, doc_id); ties by position.

    score: the share of the question's distinct words that the text holds, plus half of how dense the shortest stretch with them
    all is, plus half of the share of the question's word pairs that the text has. Questions without words score 0.
    """
    q = questions.select("qid", tokens(F.lower("text")).alias("qt"))
    rows = hit_texts(hits, docs.select("doc_id", "text"), config).join(bounded(q, config.broadcast_rows), "qid").withColumn("dt", tokens(F.lower("text")))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        matched, stretch, phrases, score = [], [], [], []
        for qt, dt in zip(b.column("qt").to_pylist(), b.column("dt").to_pylist(), strict=True):
            qt, dt = qt or [], dt or []
            m, w = smallest_window(dt, set(qt))
            p, pairs = phrase_hits(dt, qt), len(set(zip(qt, qt[1:], strict=False)))
            matched.append(m)
            stretch.append(w)
            phrases.append(p)
            score.append((m / len(set(qt)) if qt else 0.0) + (0.5 * m / w if w else 0.0) + (0.5 * p / pairs if pairs else 0.0))
        made = [pa.array(x, pa.int32()) for x in (matched, stretch, phrases)]
        return pa.RecordBatch.from_arrays([b.column("qid"), b.column("pos"), b.column("doc_id"), *made, pa.array(score, pa.float64())], ["qid", "pos", "doc_id", "matched", "stretch", "phrases", "score"])

    kinds = dict(rows.dtypes)
    scored = rows.select("qid", "pos", "doc_id", "qt", "dt").mapInArrow(each(run, 256), f"qid {kinds['qid']}, pos {kinds['pos']}, doc_id {kinds['doc_id']}, matched int, stretch int, phrases int, score double")
    scored = scored.withColumn("score", F.round("score", 6))
    return top(scored, n or config.rerank_top_n, F.desc("score"), "pos").select("qid", "rank", "doc_id", "matched", "stretch", "phrases", "score")

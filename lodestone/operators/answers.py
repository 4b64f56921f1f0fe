"""The answer flow over batches of questions: retrieval, grading with web fallback, generation, one refinement, synthesis, cache."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, Config
from lodestone.functions.vectors import embed
from lodestone.operators import retrieval
from lodestone.providers import OFFLINE, Offline

SEPARATOR = "\n\n---\n\n"
HITS = "qid, rank, id, url, text, score, retrieval_method"


@dataclass
class Index:
    """Chunks of a namespace: chunks (id, url, text, embedding), postings and stats of their words, and their mean length."""

    chunks: DataFrame
    post: DataFrame
    stats: DataFrame
    mean_length: float


def method(in_dense: Column, hyde: bool, hybrid: bool) -> Column:
    """How a hit was found: by the dense list, alone or fused, or by words alone."""
    dense = "dense" if not hybrid else "hybrid+rrf"
    return F.when(in_dense, dense + ("+hyde" if hyde else "")).otherwise("bm25-only")


def retrieve(index: Index, questions: DataFrame, top_k: int, hyde: bool = True, hybrid: bool = True, config: Config = DEFAULT, provider: Offline = OFFLINE) -> DataFrame:
    """qid, rank, id, url, text, score and retrieval_method of the best chunks for each of questions (qid, text).

    Dense and sparse lists of twice ``top_k`` are fused; a hit of the sparse list alone has a score of 0. Without ``hybrid``
    there is the dense list alone.
    """
    asked = questions.select("qid", (provider.hyde(F.col("text")) if hyde else F.col("text")).alias("text"))
    vectors = index.chunks.select(F.col("id").alias("vec_id"), "embedding")
    dense = retrieval.dense_topk(vectors, embed(asked, "qid", config.embed_dims).withColumnRenamed("embedding", "q"), 2 * top_k, config, others=False)
    dense = dense.select("qid", "rank", F.col("vec_id").alias("id"), "score")
    if hybrid:
        scores = retrieval.bm25_from(index.post, index.stats, index.mean_length, questions, config).withColumn("score", F.round("score", 6))
        sparse = retrieval.top(scores, 2 * top_k, F.desc("score"), "doc_id").select("qid", F.lit(1).alias("list_no"), "rank", F.col("doc_id").alias("id"))
        fused = retrieval.rrf(retrieval.union(dense.select("qid", F.lit(0).alias("list_no"), "rank", "id"), sparse), top_k, config).select("qid", "rank", "id")
    else:
        fused = dense.where(F.col("rank") <= top_k).select("qid", "rank", "id")
    found = fused.join(dense.select("qid", "id", "score"), ["qid", "id"], "left").join(index.chunks.select("id", "url", "text"), "id")
    return found.select("qid", "rank", "id", "url", "text", F.coalesce("score", F.lit(0.0)).alias("score"), method(F.col("score").isNotNull(), hyde, hybrid).alias("retrieval_method"))


def rerank(hits: DataFrame, questions: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The best hits of each question by joint relevance, ties by rank; with their rerank_score."""
    from lodestone.functions import tokens

    both = hits.join(questions.select("qid", tokens(F.lower("text")).alias("qt")), "qid")
    scored = both.withColumn("rerank_score", F.round(retrieval.overlap(F.col("qt"), tokens(F.lower("text"))), 6)).drop("qt").withColumnRenamed("rank", "pos")
    return retrieval.top(scored, config.rerank_top_n, F.desc("rerank_score"), "pos").drop("pos")


def with_web(graded: DataFrame, web: DataFrame) -> DataFrame:
    """Hits (qid, ..., web_fallback) in which those of a question that fell back are replaced by its web results.

    web: qid, rank, id, url, text, score. A question that fell back and has no results has none.
    """
    kept = graded.where(~F.col("web_fallback"))
    asked = graded.where("web_fallback").select("qid").distinct()
    new = web.join(asked, "qid", "left_semi").withColumn("retrieval_method", F.lit("web-fallback")).withColumn("web_fallback", F.lit(True))
    return retrieval.union(kept, new)


def generate(hits: DataFrame, questions: DataFrame, graph: DataFrame | None, config: Config = DEFAULT, provider: Offline = OFFLINE) -> DataFrame:
    """qid, context, answer, sources and retrieval_method of each question; graph (qid, context) stands in front of the hits."""
    part = F.concat(F.lit("[Source: "), F.coalesce("url", F.lit("unknown")), F.lit("]\n"), "text")
    ordered = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"), "url", "text", "retrieval_method")))
    made = hits.groupBy("qid").agg(ordered.alias("h"), F.max(F.coalesce("web_fallback", F.lit(False)) if "web_fallback" in hits.columns else F.lit(False)).alias("web_fallback"))
    rows = questions.select("qid", F.col("text").alias("question")).join(made, "qid", "left")
    context = F.array_join(F.transform("h", lambda x: x["part"]), SEPARATOR)
    if graph is not None:
        rows = rows.join(graph.select("qid", F.col("context").alias("g")), "qid", "left")
        context = F.concat_ws(SEPARATOR, "g", context)
    else:
        context = F.coalesce(context, F.lit(""))
    texts = F.coalesce(F.transform("h", lambda x: x["text"]), F.array().cast("array<string>"))
    sources = F.coalesce(F.transform("h", lambda x: F.struct(F.coalesce(x["url"], F.lit("")).alias("url"), F.substring(x["text"], 1, 300).alias("text"))), F.array().cast("array<struct<url:string,text:string>>"))
    return rows.select("qid", "question", context.alias("context"), provider.answer(F.col("question"), texts, config.rerank_top_n).alias("answer"), sources.alias("sources"), F.coalesce(F.get(F.col("h"), 0)["retrieval_method"], F.lit("hybrid")).alias("retrieval_method"), F.coalesce("web_fallback", F.lit(False)).alias("web_fallback"), texts.alias("texts"))


def judged(answers: DataFrame, config: Config = DEFAULT, provider: Offline = OFFLINE) -> DataFrame:
    """qid, passes and issues of answers, held against the first 400 characters of their first five texts."""
    from lodestone.operators.knowledge import grade_answers

    context = F.array_join(F.transform(F.slice("texts", 1, 5), lambda t: F.substring(t, 1, 400)), "\n\n")
    return grade_answers(answers.select("qid", "question", "answer", context.alias("context")), config, provider)


def refine(answers: DataFrame, again: Callable[[DataFrame], DataFrame], config: Config = DEFAULT, provider: Offline = OFFLINE, keep: Callable[[DataFrame, str], DataFrame] = lambda d, _: d) -> DataFrame:
    """Answers in which those that fail the judge are made anew, once for each of ``max_refinements``.

    again(questions) retrieves for refined questions; the hits are ranked by the question as it was, and the answer is made
    without graph context. Its method gets ``+self-rag``.
    """
    for k in range(config.max_refinements):
        failed = keep(answers.join(judged(answers, config, provider).where(~F.col("passes")).select("qid", "issues"), "qid"), f"failed-{k}")
        asked = failed.select("qid", provider.refine(F.col("question"), F.col("answer"), F.col("issues")).alias("text"))
        own = failed.select("qid", F.col("question").alias("text"))
        made = generate(rerank(again(asked), own, config), own, None, config, provider)
        before = failed.select("qid", F.col("retrieval_method").alias("m"), F.col("web_fallback").alias("w"))
        made = made.drop("retrieval_method", "web_fallback").join(before, "qid").withColumn("retrieval_method", F.concat("m", F.lit("+self-rag"))).withColumnRenamed("w", "web_fallback").drop("m")
        answers = keep(retrieval.union(answers.join(failed.select("qid"), "qid", "left_anti"), made), f"refined-{k}")
    return answers


def fan_out(questions: DataFrame, provider: Offline = OFFLINE) -> DataFrame:
    """sub (an id), qid, part, text and complexity: complex questions in parts, the others whole."""
    rows = questions.withColumn("complexity", provider.complexity(F.col("text")))
    parts = F.when(F.col("complexity") == "complex", provider.decompose(F.col("text"))).otherwise(F.array("text"))
    rows = rows.select("qid", "complexity", F.posexplode(parts).alias("part", "text"))
    return rows.select(F.xxhash64("qid", "part").alias("sub"), "qid", "part", "text", "complexity")


def synthesize(parts: DataFrame, provider: Offline = OFFLINE) -> DataFrame:
    """Answers of parts (qid, part, complexity, answer, sources, retrieval_method, web_fallback, namespace) as one for each question.

    The sources of all parts are kept, in order. A question in parts is ``multi-hop`` and never a fallback.
    """
    ordered = F.array_sort(F.collect_list(F.struct("part", "question", "answer", "sources", "retrieval_method", "web_fallback", "namespace")))
    rows = parts.groupBy("qid", "complexity").agg(ordered.alias("p"))
    many = F.col("complexity") == "complex"
    first = lambda c: F.get(F.col("p"), 0)[c]
    return rows.select(
        "qid",
        F.when(many, provider.synthesize(F.transform("p", lambda x: x["question"]), F.transform("p", lambda x: x["answer"]))).otherwise(first("answer")).alias("answer"),
        F.flatten(F.transform("p", lambda x: x["sources"])).alias("sources"),
        F.when(many, "multi-hop").otherwise(first("retrieval_method")).alias("retrieval_method"),
        (~many & first("web_fallback")).alias("web_fallback"),
        F.when(many, "leaf").otherwise(first("namespace")).alias("namespace"),
        "complexity",
    )


def first_rows(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key: the first in a total order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")

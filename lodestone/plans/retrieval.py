"""Queries of retrieval: all of ``benchmark`` as questions over all of ``documents``, and vectors against all vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import cosine
from lodestone.functions.vectors import embed
from lodestone.operators import positions
from lodestone.operators import retrieval as R
from lodestone.plans.text import BUCKET, SIGN, TOKENS
from lodestone.registry import query
from lodestone.sources.tables import load

_T = TOKENS.format("lower(text)")
BM25 = f"""terms AS (SELECT doc_id, unnest({_T}) AS term FROM documents), post AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
size AS (SELECT doc_id, len({_T}) AS dl FROM documents), world AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM size),
raw AS (SELECT term, count(*) AS df, ln(max(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, world GROUP BY term),
stats AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT qid, term, count(*) AS times FROM (SELECT item_id AS qid, unnest({_T}) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT qid, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) * times), 6) AS score
  FROM asked JOIN post USING (term) JOIN stats USING (term) JOIN size USING (doc_id), world GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores) WHERE rank <= 12)"""
COSINE = "round(list_sum(list_transform(list_zip({0}, {1}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (sqrt(list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform({1}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6)"
CELLS = f"cells AS (SELECT k, id, {BUCKET} AS bucket, CAST(sum({SIGN}) AS BIGINT) AS v FROM (SELECT 'd' AS k, doc_id AS id, unnest({_T}) AS token FROM documents UNION ALL SELECT 'q', item_id, unnest({_T}) FROM benchmark) GROUP BY ALL HAVING sum({SIGN}) <> 0), sq AS (SELECT k, id, sum(v * v) AS s FROM cells GROUP BY ALL)"
DENSE = f"""{CELLS}, near AS (SELECT q.id AS qid, d.id AS doc_id, sum(q.v * d.v) AS dot FROM cells q JOIN cells d ON q.k = 'q' AND d.k = 'd' AND q.bucket = d.bucket GROUP BY ALL),
cos AS (SELECT qid, doc_id, round(dot / (sqrt(CAST(a.s AS DOUBLE)) * sqrt(CAST(b.s AS DOUBLE))), 6) AS score FROM near JOIN sq a ON a.k = 'q' AND a.id = qid JOIN sq b ON b.k = 'd' AND b.id = doc_id),
dense AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM cos) WHERE rank <= 12)"""
FUSED = f"""{BM25}, {DENSE}, lists AS (SELECT qid, 0 AS l, rank, doc_id FROM dense UNION ALL SELECT qid, 1, rank, doc_id FROM sparse),
fused AS (SELECT qid, doc_id, round(sum(1.0 / (60 + CAST(rank AS DOUBLE))), 9) AS score, min(struct_pack(l := l, r := rank)) AS pl FROM lists GROUP BY ALL),
hybrid AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pl, doc_id) AS rank, doc_id, score FROM fused) WHERE rank <= 6)"""
RANKED = f"""{FUSED}, q AS (SELECT item_id AS qid, list_distinct({_T}) AS qt FROM benchmark), d AS (SELECT doc_id, list_distinct({_T}) AS dt FROM documents),
ov AS (SELECT qid, rank AS pos, doc_id, round(CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, dt)) / CAST(len(qt) AS DOUBLE) ELSE 0 END, 6) AS rerank_score FROM hybrid JOIN q USING (qid) JOIN d USING (doc_id)),
ranked AS (SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, pos) AS INTEGER) AS rank, doc_id, rerank_score FROM ov) WHERE rank <= 3)"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def dense_documents(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """Nearest documents of each question by hashed embeddings."""
    asked = embed(questions(spark, sf), "qid").withColumnRenamed("embedding", "q")
    return R.dense_texts_topk(load(spark, sf, "documents").select("doc_id", "text"), asked, k)


def sparse_documents(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """Best documents of each question by its words."""
    return R.bm25_topk(load(spark, sf, "documents").select("doc_id", "text"), questions(spark, sf), k)


def hybrid(spark: SparkSession, sf: str, dense: DataFrame | None = None, sparse: DataFrame | None = None) -> DataFrame:
    """qid, rank, id and score of dense and sparse lists of twelve, fused to six; a list that is there already can be given."""
    dense = dense_documents(spark, sf, 12) if dense is None else dense
    sparse = sparse_documents(spark, sf, 12) if sparse is None else sparse
    lists = [x.select("qid", F.lit(i).alias("list_no"), "rank", F.col("doc_id").alias("id")) for i, x in enumerate((dense, sparse))]
    return R.rrf(R.union(*lists))


def ranked(spark: SparkSession, sf: str, sparse: DataFrame | None = None) -> DataFrame:
    hits = hybrid(spark, sf, sparse=sparse).select("qid", F.col("rank").alias("pos"), F.col("id").alias("doc_id"))
    return R.rerank(hits, questions(spark, sf), load(spark, sf, "documents"))


@query(f"""WITH d AS (SELECT unnest(list_distinct({_T})) AS term FROM documents), c AS (SELECT term, count(*) AS df FROM d GROUP BY term),
raw AS (SELECT term, df, ln((SELECT count(*) FROM documents) - df + 0.5) - ln(df + 0.5) AS raw FROM c), m AS (SELECT avg(raw) AS mean FROM raw)
SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END, 6) AS idf FROM raw, m""")
def bm25_stats(spark: SparkSession, sf: str) -> DataFrame:
    dfs, n, _ = R.corpus_stats(load(spark, sf, "documents"))
    return R.bm25_stats(dfs, n).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {BM25} SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, score FROM sparse WHERE rank <= 6")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.bm25_topk(load(spark, sf, "documents"), questions(spark, sf))


def _vector_sql(where: str, k: int) -> str:
    return f"SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM (SELECT q.vec_id AS qid, r.vec_id, {COSINE.format('q.embedding', 'r.embedding')} AS score FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id {where})) WHERE rank <= {k}"


@query(_vector_sql("", 6))
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = load(spark, sf, "embeddings").select("vec_id", "embedding")
    return R.dense_topk(vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")))


@query(_vector_sql("AND r.label = 3", 6))
def dense_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    vectors = load(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return R.dense_topk(vectors.where("label = 3").select("vec_id", "embedding"), asked)


@query(f"WITH {DENSE} SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, score FROM dense")
def dense_documents_topk(spark: SparkSession, sf: str) -> DataFrame:
    return dense_documents(spark, sf, 12).select("qid", "rank", "doc_id", "score")


@query(f"WITH {FUSED} SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id AS id, score FROM hybrid")
def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid(spark, sf)


@query("""WITH l AS (SELECT l_suppkey AS id, sum(l_quantity) AS q, sum(l_extendedprice) AS p FROM lineitem GROUP BY 1),
r AS (SELECT 0 AS qid, 0 AS l, row_number() OVER (ORDER BY round(q, 2) DESC, id) AS rank, id FROM l UNION ALL SELECT 0, 1, row_number() OVER (ORDER BY round(p, 2) DESC, id), id FROM l)
SELECT CAST(qid AS INTEGER) AS qid, CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT qid, row_number() OVER (ORDER BY score DESC, pl, id) AS rank, id, score FROM (
SELECT qid, id, round(sum(1.0 / (60 + CAST(rank AS DOUBLE))), 9) AS score, min(struct_pack(l := l, r := rank)) AS pl FROM r GROUP BY ALL)) WHERE rank <= 6""")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers by quantity and by price, two complete rankings, fused."""
    sums = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.sum("l_extendedprice"), 2).alias("p")).withColumn("qid", F.lit(0))
    every = 1 << 30
    lists = [R.top(sums, every, F.desc(c), "id").select("qid", F.lit(i).alias("list_no"), "rank", "id") for i, c in enumerate("qp")]
    return R.rrf(lists[0].unionByName(lists[1]))


@query(f"WITH {RANKED} SELECT qid, rank, doc_id, rerank_score FROM ranked")
def rerank_topn(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(spark, sf)


@query(f"""WITH {FUSED}, q AS (SELECT item_id AS qid, {_T} AS qt FROM benchmark), d AS (SELECT doc_id, {_T} AS dt FROM documents),
h AS (SELECT qid, rank AS pos, doc_id, qt, dt, len(list_intersect(list_distinct(qt), dt)) AS matched, list_distinct(list_transform(range(1, len(qt)), lambda i: [qt[i], qt[i + 1]])) AS qp FROM hybrid JOIN q USING (qid) JOIN d USING (doc_id)),
p AS (SELECT qid, doc_id, dt[i] AS word, i FROM (SELECT qid, doc_id, qt, dt, unnest(range(1, len(dt) + 1)) AS i FROM h) WHERE list_contains(qt, dt[i])),
far AS (SELECT p.qid, p.doc_id, p.i, m.word, max(CASE WHEN p.word = m.word THEN p.i END) OVER (PARTITION BY p.qid, p.doc_id, m.word ORDER BY p.i) AS back FROM p JOIN (SELECT DISTINCT qid, doc_id, word FROM p) m USING (qid, doc_id)),
w AS (SELECT qid, doc_id, i, i - min(back) + 1 AS span, count(back) AS words FROM far GROUP BY qid, doc_id, i), spans AS (SELECT qid, doc_id, min(span) AS span FROM w JOIN h USING (qid, doc_id) WHERE words = matched GROUP BY ALL),
f AS (SELECT qid, pos, doc_id, CAST(matched AS INTEGER) AS matched, CAST(coalesce(span, 0) AS INTEGER) AS stretch, CAST(len(list_intersect(qp, list_transform(range(1, len(dt)), lambda i: [dt[i], dt[i + 1]]))) AS INTEGER) AS phrases, len(list_distinct(qt)) AS nq, len(qp) AS np FROM h LEFT JOIN spans USING (qid, doc_id)),
s AS (SELECT *, round(CASE WHEN nq > 0 THEN matched / CAST(nq AS DOUBLE) ELSE 0 END + CASE WHEN stretch > 0 THEN 0.5 * matched / CAST(stretch AS DOUBLE) ELSE 0 END + CASE WHEN np > 0 THEN 0.5 * phrases / CAST(np AS DOUBLE) ELSE 0 END, 6) AS score FROM f)
SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS INTEGER) AS rank, doc_id, matched, stretch, phrases, score FROM s) WHERE rank <= 3""")
def rerank_positions(spark: SparkSession, sf: str) -> DataFrame:
    """The fused hits of each question, ranked by where its words stand."""
    hits = hybrid(spark, sf).select("qid", F.col("rank").alias("pos"), F.col("id").alias("doc_id"))
    return positions.rerank(hits, questions(spark, sf), load(spark, sf, "documents"))


@query(f"""WITH {RANKED}, g AS (SELECT *, NOT max(rerank_score >= 0.3) OVER (PARTITION BY qid) AS web_fallback FROM ranked)
SELECT qid, rank, doc_id, rerank_score, web_fallback FROM g WHERE rerank_score >= 0.3 OR web_fallback""")
def grade_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return R.grade(ranked(spark, sf))


@query(f"""WITH {RANKED}, g AS (SELECT *, NOT max(rerank_score >= 0.3) OVER (PARTITION BY qid) AS web_fallback FROM ranked)
SELECT qid, string_agg('[Source: doc' || g.doc_id || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM g JOIN documents d USING (doc_id) WHERE rerank_score >= 0.3 OR web_fallback GROUP BY qid""")
def context_assembly(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.hit_texts(R.grade(ranked(spark, sf)), load(spark, sf, "documents").select("doc_id", "text"))
    part = F.concat(F.lit("[Source: doc"), F.col("doc_id"), F.lit("]\n"), F.col("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x["part"])
    return rows.groupBy("qid").agg(F.array_join(parts, "\n\n---\n\n").alias("context"))


@query(f"SELECT vec_id, label, {COSINE.format('embedding', 'centre')} AS own FROM embeddings JOIN (SELECT label, list(a ORDER BY i) AS centre FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS a FROM embeddings, range(1, 65) t(i) GROUP BY ALL) GROUP BY label) USING (label)")
def centroid_similarity(spark: SparkSession, sf: str) -> DataFrame:
    vectors = load(spark, sf, "embeddings")
    centres = vectors.groupBy("label").agg(F.array(*(F.avg(F.col("embedding")[i].cast("double")) for i in range(64))).alias("centre"))
    return vectors.join(centres, "label").select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("centre")), 6).alias("own"))

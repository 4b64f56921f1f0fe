"""Queries over stored indexes, which are built from the whole tables; each result is that of comparing everything."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.vectors import embed
from lodestone.operators.inverted_index import InvertedIndex
from lodestone.operators.vector_index import VectorIndex
from lodestone.plans import retrieval as PR
from lodestone.registry import oracle, query
from lodestone.sources.tables import load, shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(oracle("bm25_topk"))
def inverted_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 of an index of two segments: documents in English, then all, of which those that are there are left out."""
    docs, index = load(spark, sf, "documents"), InvertedIndex(spark, _folder(spark, "inverted-index"))
    index.add(docs.where("lang = 'en'"))
    index.add(docs)
    return index.search(PR.questions(spark, sf))


@query(oracle("dense_documents_topk"))
def vector_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest documents by hashed embeddings, from a stored index of cells: exact, and read in part."""
    docs, index = load(spark, sf, "documents"), VectorIndex(spark, _folder(spark, "vector-index"))
    index.add(embed(docs.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id"))
    asked = embed(PR.questions(spark, sf), "qid").withColumnRenamed("embedding", "q")
    return index.search(asked, 12, others=False).withColumnRenamed("vec_id", "doc_id")

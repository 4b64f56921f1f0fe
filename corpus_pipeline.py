"""From raw documents to packed training sequences: five stages, each over all that the one before it kept.

1. toxicity: documents that the classifier predicts toxic go.
2. language: documents in no language that the corpus' profiles know go.
3. line_dedup: lines that an earlier line makes redundant go, and documents that lose all their lines.
4. ngram_join: of each group of near duplicates, the document with the smallest doc_id stays, once; null ids come last.
5. packing: the texts that are left, as pieces in sequences of at most 1024 tokens.

Stages 1 to 4 return the columns of ``documents``. Documents are told apart by (doc_id, text): wholly equal rows fare alike.
Null and empty texts are clean in 1, undetermined, so rejected, in 2 unless their language column and source outweigh that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._shared import stage
from lodestone.llm.language import UND, document_rows, fit_profiles, identify
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.ngram_join import keep_one
from lodestone.llm.packing import best_fit_packing
from lodestone.llm.queries import table, vocabulary
from lodestone.llm.toxicity import fit, keep_clean, training_labels

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Keys, 8 bytes each, up to which rejected documents are broadcast; beyond, it is a shuffled join.
KEYS = 2_000_000


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without those whose key is in ``keys`` (key)."""
    keys = stage(keys, "rejected")
    keys = F.broadcast(keys) if keys.count() <= KEYS else keys
    return docs.withColumn("key", _key()).join(keys, "key", "left_anti").select(COLUMNS)


def _key():
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    return keep_clean(docs.select(COLUMNS), model, 0.3)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = document_rows(docs).withColumn("id", _key_of_rows())
    found = identify(rows, fit_profiles(docs))
    return _without(docs, found.where(F.col("lang") == UND).select(F.col("id").alias("key")).distinct())


def _key_of_rows():
    return F.xxhash64("id", "text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs.select(COLUMNS)).where("n_lines = 0 OR n_kept > 0")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs.select(COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs, vocabulary("byte_bpe_50k.json"), 1024, 2)


STAGES = [("toxicity", toxicity), ("language", language), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("packing", packing)]

#: Tokens, a trained classifier and a packing plan aren't for SQL: the tests hold all stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the ``documents`` under ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

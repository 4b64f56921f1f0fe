"""Semantic chunks, parents and leaves of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, Config
from lodestone.functions import sentences, token_windows, tokens
from lodestone.functions.batches import Tokens, each, rounded, split_sentences

#: Bytes of a slice of texts: a sentence has several vectors of its own, tens of times its length.
SLICE = 1 << 20


def sentence_rows(docs: DataFrame) -> DataFrame:
    """doc_id, pos from 0, sentence."""
    return docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))


def sentence_windows(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, pos, sentence and its window, the sentences around it joined by spaces."""
    frame = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-config.window_before, config.window_after)
    return rows.withColumn("window", F.array_join(F.collect_list("sentence").over(frame), " "))


def _similar(sentences_of: list[list[str]], config: Config) -> tuple[np.ndarray, np.ndarray]:
    """Sentences of each document, and for each sentence the cosine of its window's hashed embedding with the one before it; 0 for the first."""
    n = np.array([len(x) for x in sentences_of], np.int64)
    flat = pa.array([s for x in sentences_of for s in x], pa.string())
    own = Tokens(flat).vectors(config.embed_dims)
    total = np.concatenate((np.zeros((1, own.shape[1]), np.int64), np.cumsum(own, 0)))
    at, first = np.arange(len(flat)), np.repeat(np.cumsum(n) - n, n)
    last = first + np.repeat(n, n)
    window = total[np.minimum(at + config.window_after + 1, last)] - total[np.maximum(at - config.window_before, first)]
    length = np.sqrt((window * window).sum(1).astype(float))
    sim = np.zeros(len(flat))
    if len(flat):
        dot = (window[1:] * window[:-1]).sum(1)
        scale = length[:-1] * length[1:]
        sim[1:] = np.where(scale > 0, dot / np.where(scale > 0, scale, 1), 0)
    sim[at == first] = 0
    return n, rounded(sim)


def adjacent_similarity(docs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, pos from 1, sim: the cosine of each sentence's window with the one before it. Within a document, so without a shuffle."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, sim = _similar([split_sentences(t or "") for t in b.column("text").to_pylist()], config)
        doc, pos = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        some = pos > 0
        return pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc[some])), pa.array(pos[some], pa.int32()), pa.array(sim[some])], ["doc_id", "pos", "sim"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(each(run, most=SLICE), f"doc_id {kind}, pos int, sim double")


def semantic_chunks(docs: DataFrame, config: Config = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, chunk from 0, n_sentences and text: sentences joined until a window's similarity to the one before drops below the threshold.

    A document of at most two sentences is one chunk of its raw text; one of none, or null, has no chunk. A row of ``docs`` is a
    document: all of it is done within its batch, without a shuffle.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column("text").to_pylist()
        split = [split_sentences(t or "") for t in texts]
        n, sim = _similar(split, config)
        start = np.cumsum(n) - n
        doc, chunk, size, out = [], [], [], []
        for i, own in enumerate(split):
            if not own:
                continue
            cuts = [] if len(own) <= 2 else (np.flatnonzero(sim[start[i] + 1 : start[i] + n[i]] < config.breakpoint_threshold) + 1).tolist()
            for k, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(own)], strict=True)):
                doc.append(i)
                chunk.append(k)
                size.append(hi - lo)
                out.append(texts[i] if len(own) <= 2 else " ".join(own[lo:hi]))
        own = [b.column(c).take(pa.array(doc, pa.int64())) for c in ("doc_id", *keep)]
        return pa.RecordBatch.from_arrays([*own, pa.array(chunk, pa.int64()), pa.array(size, pa.int64()), pa.array(out, pa.string())], ["doc_id", *keep, "chunk", "n_sentences", "text"])

    kinds = dict(docs.dtypes)
    given = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *keep))
    return docs.select("doc_id", *keep, "text").mapInArrow(each(run, most=SLICE), f"{given}, chunk long, n_sentences long, text string")


def token_chunks(rows: DataFrame, key: list[str], n: int, name: str, text: Column | None = None) -> DataFrame:
    """Windows of n tokens of each row's text: key, ``name`` (from 0) and text."""
    words = tokens(F.col("text") if text is None else text)
    return rows.select(*key, F.posexplode(token_windows(words, n)).alias(name, "text"))


def parents(docs: DataFrame, config: Config = DEFAULT, key: list[str] | None = None) -> DataFrame:
    """Windows of each row's text. Of semantic chunks, ``key`` is doc_id and chunk."""
    return token_chunks(docs, key or ["doc_id"], config.parent_tokens, "parent")


def leaves(parent_rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, parent, leaf, text, and ids that depend on the place alone, so that ingesting twice changes nothing."""
    rows = token_chunks(parent_rows, ["doc_id", "parent"], config.leaf_tokens, "leaf")
    parent_id = F.sha2(F.concat_ws("|", F.lit("parent"), "doc_id", "parent"), 256)
    return rows.withColumn("parent_id", parent_id).withColumn("leaf_id", F.sha2(F.concat_ws("|", F.lit("leaf"), "doc_id", "parent", "leaf"), 256))


def chunk_parents(chunks: DataFrame, config: Config = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parents of semantic chunks: doc_id, ``keep``, chunk, parent, text and parent_id."""
    rows = token_chunks(chunks, ["doc_id", *keep, "chunk"], config.parent_tokens, "parent")
    return rows.withColumn("parent_id", F.sha2(F.concat_ws("|", F.lit("parent"), "doc_id", "chunk", "parent"), 256))


def chunk_leaves(parent_rows: DataFrame, config: Config = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Leaves of the parents of semantic chunks: doc_id, ``keep``, chunk, parent, parent_id, leaf, text and leaf_id."""
    rows = token_chunks(parent_rows, ["doc_id", *keep, "chunk", "parent", "parent_id"], config.leaf_tokens, "leaf")
    return rows.withColumn("leaf_id", F.sha2(F.concat_ws("|", F.lit("leaf"), "doc_id", "chunk", "parent", "leaf"), 256))


def expand_to_parents(hits: DataFrame, parent_rows: DataFrame) -> DataFrame:
    """Hits on leaves (doc_id, parent, ...) with the text of their parents."""
    return hits.join(parent_rows.select("doc_id", "parent", F.col("text").alias("parent_text")), ["doc_id", "parent"])

"""Queries over documents: sentences, embeddings by hashing, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import collapse_blank_lines, tokens
from lodestone.functions.vectors import text_cells
from lodestone.operators import chunking as C
from lodestone.registry import query
from lodestone.sources.tables import load

SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
TOKENS = r"list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')"
SENTENCE_ROWS = f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS sentence FROM (SELECT doc_id, {SENTENCES} AS s, unnest(range(1, len({SENTENCES}) + 1)) AS i FROM documents)"
BUCKET = "CAST(CAST('0x' || substring(md5(token), 1, 8) AS BIGINT) % 64 AS INTEGER)"
SIGN = "CASE WHEN CAST('0x' || substring(md5(token), 9, 1) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END"
WINDOW_CELLS = f"""s AS ({SENTENCE_ROWS}), w AS (SELECT doc_id, pos, unnest({TOKENS.format("sentence")}) AS token FROM s),
c AS (SELECT doc_id, pos, {BUCKET} AS bucket, CAST(sum({SIGN}) AS BIGINT) AS v FROM w GROUP BY ALL),
l AS (SELECT doc_id, max(pos) AS last FROM s GROUP BY doc_id),
e AS (SELECT doc_id, unnest(range(greatest(0, pos - 2), least(last, pos + 3) + 1)) AS pos, bucket, v FROM c JOIN l USING (doc_id)),
x AS (SELECT doc_id, pos, bucket, CAST(sum(v) AS BIGINT) AS v FROM e GROUP BY ALL HAVING sum(v) <> 0),
q AS (SELECT doc_id, pos, sum(v * v) AS sq FROM x GROUP BY ALL),
d AS (SELECT a.doc_id, b.pos, sum(a.v * b.v) AS dot FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.pos + 1 = b.pos AND a.bucket = b.bucket GROUP BY ALL),
sim AS (SELECT s.doc_id, s.pos, round(coalesce(dot / (sqrt(CAST(a.sq AS DOUBLE)) * sqrt(CAST(b.sq AS DOUBLE))), 0), 6) AS sim FROM s
  LEFT JOIN d ON d.doc_id = s.doc_id AND d.pos = s.pos LEFT JOIN q a ON a.doc_id = s.doc_id AND a.pos = s.pos LEFT JOIN q b ON b.doc_id = s.doc_id AND b.pos = s.pos - 1 WHERE s.pos > 0)"""


@query(SENTENCE_ROWS)
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    return C.sentence_rows(load(spark, sf, "documents"))


@query(f'SELECT doc_id, pos, string_agg(sentence, \' \') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS "window" FROM ({SENTENCE_ROWS})')
def sentence_windows(spark: SparkSession, sf: str) -> DataFrame:
    return C.sentence_windows(C.sentence_rows(load(spark, sf, "documents"))).select("doc_id", "pos", "window")


@query(f"SELECT doc_id, {BUCKET} AS bucket, CAST(sum({SIGN}) AS BIGINT) AS value FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents) GROUP BY ALL HAVING sum({SIGN}) <> 0")
def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    return text_cells(load(spark, sf, "documents"), "doc_id")


@query(f"WITH {WINDOW_CELLS} SELECT doc_id, pos, sim FROM sim")
def adjacent_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return C.adjacent_similarity(load(spark, sf, "documents"))


@query(f"""WITH {WINDOW_CELLS}, i AS (SELECT s.doc_id, s.pos, sentence, CAST(sum(CASE WHEN sim < 0.85 THEN 1 ELSE 0 END) OVER (PARTITION BY s.doc_id ORDER BY s.pos) AS BIGINT) AS chunk
  FROM s LEFT JOIN sim ON sim.doc_id = s.doc_id AND sim.pos = s.pos), short AS (SELECT doc_id, text, len({SENTENCES}) AS n FROM documents WHERE len({SENTENCES}) BETWEEN 1 AND 2)
SELECT doc_id, chunk, count(*) AS n_sentences, string_agg(sentence, ' ' ORDER BY pos) AS text FROM i WHERE doc_id NOT IN (SELECT doc_id FROM short) GROUP BY doc_id, chunk
UNION ALL SELECT doc_id, CAST(0 AS BIGINT), n, text FROM short""")
def semantic_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return C.semantic_chunks(load(spark, sf, "documents"))


def _windows(source: str, key: str, n: int, name: str) -> str:
    t = TOKENS.format("text")
    return f"SELECT {key}, CAST(k AS INTEGER) AS {name}, array_to_string(t[k * {n} + 1 : k * {n} + {n}], ' ') AS text FROM (SELECT {key}, {t} AS t, unnest(range(0, CAST(ceil(len({t}) / {n}.0) AS BIGINT))) AS k FROM {source})"


PARENTS = _windows("documents", "doc_id", 512, "parent")
LEAVES = _windows(f"({PARENTS})", "doc_id, parent", 150, "leaf")


@query(PARENTS)
def parent_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return C.parents(load(spark, sf, "documents"))


@query(f"SELECT *, sha256('parent|' || doc_id || '|' || parent) AS parent_id, sha256('leaf|' || doc_id || '|' || parent || '|' || leaf) AS leaf_id FROM ({LEAVES})")
def leaf_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return C.leaves(C.parents(load(spark, sf, "documents")))


@query(f"SELECT l.doc_id, l.parent, l.leaf, length(l.text) AS leaf_chars, length(p.text) AS parent_chars, contains(p.text, l.text) AS inside FROM ({LEAVES}) l JOIN ({PARENTS}) p USING (doc_id, parent)")
def leaf_parent_expand(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.parents(load(spark, sf, "documents"))
    both = C.expand_to_parents(C.leaves(rows), rows)
    return both.select("doc_id", "parent", "leaf", F.char_length("text").cast("long").alias("leaf_chars"), F.char_length("parent_text").cast("long").alias("parent_chars"), F.contains("parent_text", "text").alias("inside"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t\r\f]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS text FROM documents")
def blank_lines(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", collapse_blank_lines(F.col("text")).alias("text"))


@query("SELECT doc_id, left(text, 500) AS stored, left(text, 300) AS shown, left(text, 200) AS quoted FROM documents")
def truncations(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.substring("text", 1, 500).alias("stored"), F.substring("text", 1, 300).alias("shown"), F.substring("text", 1, 200).alias("quoted"))


@query("SELECT source AS collection, count(*) AS pages, CAST(sum(leaves) AS BIGINT) AS leaves, CAST(sum(parents) AS BIGINT) AS parents FROM (SELECT source, doc_id FROM documents) d LEFT JOIN (SELECT doc_id, count(*) AS leaves, count(DISTINCT parent) AS parents FROM (" + LEAVES + ") GROUP BY doc_id) USING (doc_id) GROUP BY source")
def ingest_summary(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    n = F.size(tokens(F.col("text")))
    # counts follow from the number of tokens: no window has to be made
    full, rest = F.floor(n / 512), n % 512
    made = docs.select("source", F.ceil(n / 512).alias("p"), (full * 4 + F.ceil(rest / 150)).alias("l"))
    return made.groupBy(F.col("source").alias("collection")).agg(F.count("*").alias("pages"), F.sum("l").cast("long").alias("leaves"), F.sum("p").cast("long").alias("parents"))

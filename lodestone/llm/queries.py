"""The operators over whole tables, as thin queries; SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file; only its path goes to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree import score_texts

    return score_texts(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 != 1)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k, quantised

    rows = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return exact_top_k(rows, rows.where(F.col("id") % 50 == 0), 5)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 1024, 2)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit_profiles, identify, page_rows

    profiles = fit_profiles(table(spark, sf_dir, "documents"))
    return identify(page_rows(table(spark, sf_dir, "pages")), profiles).withColumnRenamed("id", "page_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_kept", "text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score, training_labels

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    out = score(docs, model, 0.3)
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score", "predicted")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import integers, whiten

    return whiten(integers(table(spark, sf_dir, "embeddings")), 8)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"), 100, 5, 2000, 100)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import document_fingerprints

    return document_fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


OP2_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""


#: Lines within one edit agree in their first or in their last half, which spares most distances. DuckDB's distance is in
#: bytes; the lengths compared here are in characters, and so is the alignment of what follows the first difference.
OP8_SQL = """
WITH lines AS (
  SELECT doc_id, i - 1 AS line_no, l[i] AS raw, trim(l[i], ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), firsts AS (
  SELECT line, min(struct_pack(d := doc_id, n := line_no)) AS place, length(line) AS n FROM lines WHERE line <> '' GROUP BY line
), near AS (
  SELECT DISTINCT b.place FROM firsts a JOIN firsts b
  ON a.n BETWEEN b.n - 1 AND b.n + 1 AND a.place < b.place
  AND (left(a.line, least(a.n, b.n) // 2) = left(b.line, least(a.n, b.n) // 2) OR right(a.line, least(a.n, b.n) - least(a.n, b.n) // 2) = right(b.line, least(a.n, b.n) - least(a.n, b.n) // 2))
  WHERE len(list_filter(range(0, CAST(greatest(a.n, b.n) AS BIGINT)), lambda p:
    left(a.line, p) = left(b.line, p) AND CASE
      WHEN a.n = b.n THEN substring(a.line, p + 2) = substring(b.line, p + 2)
      WHEN a.n < b.n THEN substring(a.line, p + 1) = substring(b.line, p + 2)
      ELSE substring(a.line, p + 2) = substring(b.line, p + 1) END)) > 0
), stays AS (
  SELECT l.doc_id, l.line_no, l.raw, l.line = '' AS blank, l.line = '' OR (f.place IS NOT NULL AND n.place IS NULL) AS stay
  FROM lines l LEFT JOIN firsts f ON f.place = struct_pack(d := l.doc_id, n := l.line_no) LEFT JOIN near n ON n.place = f.place
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_kept, 0) AS BIGINT) AS n_kept, CASE WHEN d.text IS NOT NULL THEN coalesce(s.text, '') END AS text
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) FILTER (WHERE NOT blank) AS n_lines, count(*) FILTER (WHERE stay AND NOT blank) AS n_kept, string_agg(raw, chr(10) ORDER BY line_no) FILTER (WHERE stay) AS text
  FROM stays GROUP BY doc_id
) s USING (doc_id)
"""


#: DuckDB's order of texts is that of their UTF-8 bytes.
OP12_SQL = """
WITH p AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL)
), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k AS size, phrase, count(*) AS c FROM g GROUP BY ALL HAVING count(*) >= 100),
x AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
inside AS (
  SELECT lang, phrase, max(c) AS longer FROM (
    SELECT lang, c, array_to_string(w[i : i + m - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM x))
  ) GROUP BY lang, phrase
), cuts AS (
  SELECT x.lang, x.phrase, x.size, x.c AS a, k, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 : x.size], ' ') AS rp
  FROM (SELECT *, unnest(range(1, size)) AS k FROM x) x LEFT JOIN inside i ON i.lang = x.lang AND i.phrase = x.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 100 * x.c
), s AS (
  SELECT cuts.lang, cuts.phrase, a, l.c AS l, r.c AS r, n.n, k, CAST((CAST(1000 AS HUGEINT) * a * n.n) // (CAST(l.c AS HUGEINT) * r.c) AS BIGINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = lp JOIN f r ON r.lang = cuts.lang AND r.phrase = rp JOIN n ON n.lang = cuts.lang
), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_top_k": OP2_SQL, "op8_line_dedup": OP8_SQL, "op12_phrases": OP12_SQL}

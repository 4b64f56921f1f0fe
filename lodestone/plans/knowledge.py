"""Queries of propositions, graph, routing, cache, tree and grading."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT
from lodestone.functions import tokens
from lodestone.operators import chunking as C
from lodestone.operators import knowledge as K
from lodestone.operators import mining as M
from lodestone.plans.retrieval import COSINE
from lodestone.plans.text import BUCKET, LEAVES, SENTENCE_ROWS, SENTENCES, SIGN, TOKENS
from lodestone.providers import OFFLINE, ROUTE_WORDS, ROUTES
from lodestone.registry import query
from lodestone.sources.tables import cut, load

_PUNCT = r"""[!-/:-@\[-`{-~]"""
RELATIONS = rf"""rel AS (SELECT doc_id, pos, t[1] AS subject, t[2] AS relation, t[3] AS object FROM (
  SELECT doc_id, pos, list_filter(list_transform({TOKENS.format("lower(sentence)")}[1:3], lambda w: regexp_replace(w, '^{_PUNCT}+|{_PUNCT}+$', '', 'g')), lambda w: w <> '') AS t FROM ({SENTENCE_ROWS})) WHERE len(t) = 3),
adj AS (SELECT DISTINCT node, neighbour FROM (SELECT subject AS node, object AS neighbour FROM rel UNION ALL SELECT object, subject FROM rel))"""
_Q = TOKENS.format("lower(text)")


def _relations(spark: SparkSession, sf: str) -> DataFrame:
    return K.relations(load(spark, sf, "documents"))


@query(f"SELECT doc_id, parent, leaf, CAST(i - 1 AS INTEGER) AS ord, s[i] AS text FROM (SELECT doc_id, parent, leaf, {SENTENCES} AS s, unnest(range(1, len({SENTENCES}) + 1)) AS i FROM ({LEAVES}))")
def propositions(spark: SparkSession, sf: str) -> DataFrame:
    return K.propositions(C.leaves(C.parents(load(spark, sf, "documents"))))


@query(f"WITH {RELATIONS} SELECT doc_id, pos, subject, relation, object FROM rel")
def triples(spark: SparkSession, sf: str) -> DataFrame:
    return _relations(spark, sf)


@query(f"WITH {RELATIONS} SELECT DISTINCT entity, doc_id FROM (SELECT subject AS entity, doc_id FROM rel UNION ALL SELECT object, doc_id FROM rel)")
def entity_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The sources of each entity, a row each: those of a common word are too many for one row."""
    return K.entity_sources(_relations(spark, sf))


@query(f"WITH {RELATIONS} SELECT node, neighbour FROM adj")
def adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return K.adjacency(_relations(spark, sf))


@query("""WITH e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), adj AS (SELECT a AS node, b AS neighbour FROM e UNION SELECT b, a FROM e),
seed AS (SELECT CAST(n_nationkey AS BIGINT) AS qid, 's' || min(s_suppkey) AS node FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
h1 AS (SELECT qid, node FROM seed UNION SELECT qid, neighbour FROM seed JOIN adj USING (node)), h2 AS (SELECT qid, node FROM h1 UNION SELECT qid, neighbour FROM h1 JOIN adj USING (node))
SELECT qid, count(*) AS reached, count(*) FILTER (WHERE node LIKE 's%') AS suppliers FROM h2 GROUP BY qid""")
def graph_2hop(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and parts within two hops of each nation's first supplier."""
    edges = load(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("subject"), F.concat(F.lit("p"), "l_partkey").alias("object")).distinct()
    supplier = load(spark, sf, "supplier").join(load(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey")), "s_nationkey")
    seeds = supplier.groupBy(F.col("s_nationkey").cast("long").alias("qid")).agg(F.concat(F.lit("s"), F.min("s_suppkey")).alias("node"))
    near = K.reach(K.adjacency(edges), seeds, 2, inclusive=True)
    return near.groupBy("qid").agg(F.count("*").alias("reached"), F.count(F.when(F.col("node").startswith("s"), 1)).alias("suppliers"))


@query(f"""WITH {RELATIONS}, seed AS (SELECT DISTINCT qid, node FROM (SELECT item_id AS qid, unnest({_Q}) AS node FROM benchmark) WHERE node IN (SELECT node FROM adj)),
near AS (SELECT qid, node FROM seed UNION SELECT qid, neighbour FROM seed JOIN adj USING (node)),
ind AS (SELECT s.qid, rel.*, row_number() OVER (PARTITION BY s.qid ORDER BY doc_id, pos) AS k FROM rel JOIN near s ON s.node = subject JOIN near o ON o.node = object AND o.qid = s.qid)
SELECT qid, 'Knowledge graph context:' || chr(10) || string_agg(subject || ' → ' || relation || ' → ' || object, chr(10) ORDER BY k) AS context FROM ind WHERE k <= 20 GROUP BY qid""")
def graph_context(spark: SparkSession, sf: str) -> DataFrame:
    """Relations around the words of each question that are nodes of the graph."""
    words = load(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.explode(tokens(F.lower("text"))).alias("node"))
    return K.graph_context(_relations(spark, sf), words)  # a word that is no node touches no relation


_ROUTES = ", ".join(f"({i}, '{label}', '{space}', '{ROUTE_WORDS[label]}')" for i, (label, space) in enumerate(ROUTES))


@query(f"""WITH routes(ord, label, namespace, text) AS (VALUES {_ROUTES}),
q AS (SELECT id AS qid, {BUCKET} AS bucket, sum({SIGN}) AS v FROM (SELECT item_id AS id, unnest({_Q}) AS token FROM benchmark) GROUP BY ALL),
r AS (SELECT ord, {BUCKET} AS bucket, sum({SIGN}) AS w FROM (SELECT ord, unnest({TOKENS.format("lower(text)")}) AS token FROM routes) GROUP BY ALL),
dots AS (SELECT qid, ord, sum(v * w) AS dot FROM q JOIN r USING (bucket) GROUP BY ALL), len AS (SELECT ord, sqrt(CAST(sum(w * w) AS DOUBLE)) AS len FROM r GROUP BY ord)
SELECT qid, label, namespace FROM (SELECT item_id AS qid, label, namespace, row_number() OVER (PARTITION BY item_id ORDER BY round(coalesce(dot / len, 0), 6) DESC, routes.ord) AS k
FROM benchmark CROSS JOIN routes JOIN len USING (ord) LEFT JOIN dots ON dots.qid = item_id AND dots.ord = routes.ord) WHERE k = 1""")
def semantic_route(spark: SparkSession, sf: str) -> DataFrame:
    return K.semantic_route(load(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text"))


@query("""SELECT event_id AS qid, CASE event_type WHEN 'view' THEN 'props' WHEN 'click' THEN 'parent' ELSE 'leaf' END AS namespace FROM events""")
def route_default(spark: SparkSession, sf: str) -> DataFrame:
    """Event types stand for labels that a model gave; most aren't labels of routes."""
    label = F.when(F.col("event_type") == "view", "technical").when(F.col("event_type") == "click", "howto").otherwise(F.col("event_type"))
    return K.route_by_label(load(spark, sf, "events").select(F.col("event_id").alias("qid"), label.alias("label")))


@query(f"SELECT conv_id, turn, CASE WHEN n <= 8 THEN 'simple' WHEN n <= 24 THEN 'moderate' ELSE 'complex' END AS complexity FROM (SELECT conv_id, turn, len({TOKENS.format('text')}) AS n FROM conversations WHERE role = 'user')")
def classify_complexity(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", OFFLINE.complexity(F.col("text")).alias("complexity"))


@query(f"SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS part, p[i] AS question FROM (SELECT conv_id, turn, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT conv_id, turn, CASE WHEN len({SENTENCES}) > 0 THEN {SENTENCES} ELSE [text] END AS p FROM conversations WHERE role = 'user'))")
def decompose_explode(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.posexplode(OFFLINE.decompose(F.col("text"))).alias("part", "question"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def sub_answer_concat(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return load(spark, sf, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.array_join(parts, "\n\n").alias("answer"))


@query(f"""SELECT qid, arg_max(entry, (similarity, -entry)) AS entry, max(similarity) AS similarity FROM (
SELECT q.vec_id AS qid, e.vec_id AS entry, round({COSINE.format('q.embedding', 'e.embedding')}, 4) AS similarity FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id
WHERE q.vec_id % 100 = 0 AND e.vec_id * 60 > 3600) WHERE similarity >= 0.3 GROUP BY qid""")
def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as cached questions, a minute apart; labels as collections; a threshold that these vectors can meet."""
    v = load(spark, sf, "embeddings")
    entries = v.select(F.col("vec_id").alias("entry"), F.col("label").alias("collection"), "embedding", (F.col("vec_id") * 60).alias("expires_at"))
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("collection"), F.col("embedding").alias("q"))
    return K.cache_lookup(asked, entries, F.lit(3600), replace(DEFAULT, cache_similarity=0.3), others=True)


@query("""SELECT user_id, count(*) AS entries, count(*) FILTER (WHERE nxt IS NOT NULL AND nxt < ts + INTERVAL 3600 SECOND) AS hits FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) GROUP BY user_id""")
def cache_ttl(spark: SparkSession, sf: str) -> DataFrame:
    """Events as questions of users: how often the next comes before the last one's entry expires."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = load(spark, sf, "events").withColumn("nxt", F.lead("ts").over(w))
    live = F.col("nxt") < F.col("ts") + F.expr("INTERVAL 3600 SECOND")
    return rows.groupBy("user_id").agg(F.count("*").alias("entries"), F.count(F.when(live, 1)).alias("hits"))


@query("SELECT count(*) AS size, 0.95 AS threshold, 3600 AS ttl_seconds FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND".replace("0.95", "CAST(0.95 AS DOUBLE)"))
def cache_stats(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    live = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).where(F.col("ts") > F.col("now") - F.expr("INTERVAL 3600 SECOND"))  # one row
    return live.agg(F.count("*").alias("size")).select("size", F.lit(0.95).alias("threshold"), F.lit(3600).alias("ttl_seconds"))


@query("SELECT source, n, CAST(greatest(2, least(floor(sqrt(n)), n // 5)) AS BIGINT) AS k FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def cluster_k(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("k", K.cluster_count(F.col("n")))


@query(f"""WITH c AS (SELECT label AS centre, list(a ORDER BY i) AS c FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS a FROM embeddings, range(1, 65) t(i) GROUP BY ALL) GROUP BY label)
SELECT vec_id, arg_max(centre, (s, -centre)) AS centre FROM (SELECT vec_id, centre, {COSINE.format('embedding', 'c')} AS s FROM embeddings, c) GROUP BY vec_id""")
def nearest_centroid(spark: SparkSession, sf: str) -> DataFrame:
    v = load(spark, sf, "embeddings")
    centres = v.groupBy(F.col("label").alias("centre")).agg(F.array(*(F.avg(F.col("embedding")[i].cast("double")) for i in range(64))).alias("c"))
    return K.nearest(v.select("vec_id", "embedding"), centres)


@query()
def summary_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Levels of the tree over all vectors; K-means has no SQL, so the tests hold its invariants."""
    v = load(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("ord"), F.concat(F.lit("Node "), "vec_id", F.lit(".")).alias("text"), "embedding")
    levels = K.summary_tree(v)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select("id", "level", "text", F.size("child_ids").alias("children"))


_PAIRS = "pairs AS (SELECT conv_id, turn, text AS question, lead(text) OVER w AS answer, lead(role) OVER w AS r, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))"
_SHARE = "round(CASE WHEN len(list_distinct({a})) > 0 THEN len(list_intersect(list_distinct({a}), list_distinct({b}))) / CAST(len(list_distinct({a})) AS DOUBLE) ELSE 0 END, 4)"
_A, _QW = TOKENS.format("lower(answer)"), TOKENS.format("lower(question)")
EVAL = f"WITH {_PAIRS}, s AS (SELECT conv_id, turn, {_SHARE.format(a=_A, b=_QW)} AS faithfulness, {_SHARE.format(a=_QW, b=_A)} AS relevance FROM pairs WHERE role = 'user' AND r = 'assistant')"


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """User turns and the assistant turns that follow them; the question stands for the context."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = load(spark, sf, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("r", F.lead("role").over(w)).where("role = 'user' AND r = 'assistant'")
    return rows.select(F.struct("conv_id", "turn").alias("qid"), F.col("text").alias("question"), "answer", F.col("text").alias("context"))


@query(EVAL + " SELECT conv_id, turn, faithfulness, relevance, faithfulness >= 0.7 AND relevance >= 0.7 AS passes FROM s")
def self_grade(spark: SparkSession, sf: str) -> DataFrame:
    return K.grade_answers(_answers(spark, sf)).select("qid.conv_id", "qid.turn", "faithfulness", "relevance", "passes")


@query(EVAL + " SELECT count(*) AS n, round(avg(faithfulness), 4) AS faithfulness, round(avg(relevance), 4) AS relevance, count(*) FILTER (WHERE faithfulness >= 0.7 AND relevance >= 0.7) AS passing FROM s")
def eval_scores(spark: SparkSession, sf: str) -> DataFrame:
    g = K.grade_answers(_answers(spark, sf))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("faithfulness"), 4).alias("faithfulness"), F.round(F.avg("relevance"), 4).alias("relevance"), F.count(F.when(F.col("passes"), 1)).alias("passing"))


@query("SELECT c_custkey AS id, round(c_acctbal, 2) AS value, 'stored' AS origin FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, round(sum(o_totalprice), 2), 'new' FROM orders GROUP BY o_custkey")
def upsert_by_key(spark: SparkSession, sf: str) -> DataFrame:
    stored = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.round("c_acctbal", 2).alias("value"), F.lit("stored").alias("origin"))
    new = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"), F.lit("new").alias("origin"))
    return K.upsert(stored, new, "id")


_PLAIN = rf"list_filter(list_transform({TOKENS.format('lower(sentence)')}, lambda w: regexp_replace(w, '^{_PUNCT}+|{_PUNCT}+$', '', 'g')), lambda w: w <> '')"
#: Collocations of the documents, and the runs of their sentences.
_MINED = f"""sw AS (SELECT doc_id, pos, {_PLAIN} AS w FROM ({SENTENCE_ROWS})),
pairs AS (SELECT a, b, count(*) AS n FROM (SELECT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM sw)) GROUP BY ALL),
rs AS (SELECT a, sum(n) AS r FROM pairs GROUP BY a), cs AS (SELECT b, sum(n) AS c FROM pairs GROUP BY b), world AS (SELECT sum(n) AS t FROM pairs),
k AS (SELECT a, b, CAST(n AS DOUBLE) AS n, CAST(r AS DOUBLE) AS r, CAST(c AS DOUBLE) AS c, CAST(t AS DOUBLE) AS t FROM pairs JOIN rs USING (a) JOIN cs USING (b), world WHERE n >= 5),
known AS (SELECT a, b, CAST(n AS BIGINT) AS n, llr FROM (SELECT *, round(2 * (n * ln(n / (r * c / t)) + CASE WHEN r > n THEN (r - n) * ln((r - n) / (r * (t - c) / t)) ELSE 0 END
  + CASE WHEN c > n THEN (c - n) * ln((c - n) / ((t - r) * c / t)) ELSE 0 END + CASE WHEN t - r - c + n > 0 THEN (t - r - c + n) * ln((t - r - c + n) / ((t - r) * (t - c) / t)) ELSE 0 END), 6) AS llr FROM k)
  WHERE llr >= 10.83 AND n * t > r * c),
wr AS (SELECT doc_id, pos, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS before FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM sw)),
runs AS (SELECT doc_id, pos, seg, CAST(min(i) - 1 AS INTEGER) AS start, count(*) AS size, string_agg(word, ' ' ORDER BY i) AS text FROM (
  SELECT wr.*, sum(CASE WHEN known.a IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pos ORDER BY i) AS seg FROM wr LEFT JOIN known ON before = a AND word = b) GROUP BY ALL)"""


def _mined(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The words of all documents' sentences, and their collocations."""
    words = M.sentence_words(load(spark, sf, "documents"))
    return words, cut(M.collocations(words))


@query(f"WITH {_MINED} SELECT a, b, n, llr FROM known")
def mined_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return _mined(spark, sf)[1]


@query(f"WITH {_MINED} SELECT doc_id, pos, start, text AS entity FROM runs WHERE size > 1")
def mined_entities(spark: SparkSession, sf: str) -> DataFrame:
    return M.entities_of(*_mined(spark, sf))


@query(f"""WITH {_MINED}, e AS (SELECT *, lead(seg) OVER w AS next, lead(text) OVER w AS object FROM runs WHERE size > 1 WINDOW w AS (PARTITION BY doc_id, pos ORDER BY seg))
SELECT e.doc_id, e.pos, e.text AS subject, string_agg(m.text, ' ' ORDER BY m.seg) AS relation, object FROM e JOIN runs m ON m.doc_id = e.doc_id AND m.pos = e.pos AND m.seg > e.seg AND m.seg < next
WHERE next - e.seg BETWEEN 2 AND 6 GROUP BY e.doc_id, e.pos, e.seg, e.text, object""")
def mined_relations(spark: SparkSession, sf: str) -> DataFrame:
    return M.relations_of(*_mined(spark, sf))

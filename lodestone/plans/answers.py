"""Queries of the answer flow: retrieval with methods, web results, generation, refinement, parts, cache and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.replies import decode_strings
from lodestone.functions.text import once
from lodestone.operators import answers as A
from lodestone.operators import chunking as C
from lodestone.operators import knowledge as K
from lodestone.operators import retrieval as R
from lodestone.plans import knowledge as PK
from lodestone.plans import retrieval as PR
from lodestone.plans.knowledge import _PUNCT
from lodestone.plans.retrieval import DENSE, FUSED, RANKED
from lodestone.plans.text import SENTENCES, TOKENS, WINDOW_CELLS, _windows
from lodestone.providers import OFFLINE, ROUTES
from lodestone.registry import oracle, query
from lodestone.sources.tables import cut, load, or_else

GRADED = f"{RANKED}, graded AS (SELECT *, NOT max(rerank_score >= 0.3) OVER (PARTITION BY qid) AS web_fallback FROM ranked), kept AS (SELECT * FROM graded WHERE NOT web_fallback AND rerank_score >= 0.3)"
#: Hits, with web results in place of those of questions without a relevant one.
WEB = f"""{GRADED}, hits AS (SELECT qid, rank, 'doc' || k.doc_id AS url, d.text, 'hybrid+rrf' AS retrieval_method, FALSE AS web_fallback FROM kept k JOIN documents d USING (doc_id)
UNION ALL SELECT qid, CAST(rank AS INTEGER), 'doc' || s.doc_id, d.text, 'web-fallback', TRUE FROM sparse s JOIN documents d USING (doc_id) WHERE rank <= 4 AND qid NOT IN (SELECT qid FROM kept))"""
ANSWERS = f"""{WEB}, said AS (SELECT item_id AS qid, b.text AS question, coalesce(string_agg(a.first, ' ' ORDER BY a.rank) FILTER (WHERE a.first IS NOT NULL AND a.rank <= 3), '') AS answer, coalesce(max(retrieval_method), 'hybrid') AS retrieval_method, coalesce(bool_or(web_fallback), FALSE) AS web_fallback,
coalesce(string_agg(a.short, chr(10) || chr(10) ORDER BY a.rank) FILTER (WHERE a.rank <= 5), '') AS seen FROM benchmark b LEFT JOIN (SELECT qid, rank, retrieval_method, web_fallback, left(text, 400) AS short, {SENTENCES}[1] AS first FROM hits) a ON a.qid = b.item_id GROUP BY ALL)"""
_SHARE = "round(CASE WHEN len(list_distinct({a})) > 0 THEN len(list_intersect(list_distinct({a}), list_distinct({b}))) / CAST(len(list_distinct({a})) AS DOUBLE) ELSE 0 END, 4)"
_LQ, _LA, _LS = (TOKENS.format(f"lower({c})") for c in ("question", "answer", "seen"))
JUDGED = f"{ANSWERS}, judged AS (SELECT *, {_SHARE.format(a=_LA, b=_LS)} AS faithfulness, {_SHARE.format(a=_LQ, b=_LA)} AS relevance FROM said)"


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("url"), "text")


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """Graded hits of all questions, with web results where nothing is relevant; offline, the web is the documents by words."""
    asked, sparse = PR.questions(spark, sf), cut(PR.sparse_documents(spark, sf, 12))
    # made once, a few rows a question; the texts come last
    graded = cut(R.grade(PR.ranked(spark, sf, sparse))).withColumn("retrieval_method", F.lit("hybrid+rrf"))
    graded = graded.select("qid", "rank", "doc_id", "retrieval_method", "web_fallback").where(~F.col("web_fallback"))
    lost = asked.select("qid").join(graded.select("qid").distinct(), "qid", "left_anti")
    web = sparse.where(F.col("rank") <= 4).select("qid", "rank", "doc_id")
    rows = A.with_web(R.union(graded, lost.withColumn("web_fallback", F.lit(True))), web)
    return R.hit_texts(rows, _texts(spark, sf)).select("qid", "rank", "url", "text", "retrieval_method", "web_fallback")


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    return cut(A.generate(_hits(spark, sf), PR.questions(spark, sf), None))


@query(f"""WITH {FUSED} SELECT h.qid, CAST(h.rank AS INTEGER) AS rank, h.doc_id AS id, coalesce(d.score, 0) AS score, CASE WHEN d.score IS NULL THEN 'bm25-only' ELSE 'hybrid+rrf+hyde' END AS retrieval_method
FROM hybrid h LEFT JOIN dense d ON d.qid = h.qid AND d.doc_id = h.doc_id""")
def retrieve_methods(spark: SparkSession, sf: str) -> DataFrame:
    """Fused hits with their dense score, 0 for those that words alone found, and how they were found."""
    dense = cut(PR.dense_documents(spark, sf, 12))
    rows = PR.hybrid(spark, sf, dense).drop("score").join(dense.select("qid", F.col("doc_id").alias("id"), "score"), ["qid", "id"], "left")
    return rows.select("qid", "rank", "id", F.coalesce("score", F.lit(0.0)).alias("score"), A.method(F.col("score").isNotNull(), True, True).alias("retrieval_method"))


@query(f"WITH {DENSE} SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id AS id, 'dense' AS retrieval_method FROM dense WHERE rank <= 6")
def retrieve_dense_only(spark: SparkSession, sf: str) -> DataFrame:
    """Without fusion: the first of the dense list."""
    rows = PR.dense_documents(spark, sf, 12).where(F.col("rank") <= 6)
    return rows.select("qid", "rank", F.col("doc_id").alias("id"), A.method(F.lit(True), False, False).alias("retrieval_method"))


@query(f"WITH {WEB} SELECT qid, rank, url, retrieval_method, web_fallback FROM hits")
def web_results(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).select("qid", "rank", "url", "retrieval_method", "web_fallback")


@query(f"WITH {ANSWERS} SELECT qid, answer, retrieval_method, web_fallback FROM said")
def generated_answers(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("qid", "answer", "retrieval_method", "web_fallback")


@query(f"WITH {JUDGED} SELECT qid, faithfulness, relevance, faithfulness >= 0.7 AND relevance >= 0.7 AS passes, concat_ws(',', CASE WHEN faithfulness < 0.7 THEN 'unsupported' END, CASE WHEN relevance < 0.7 THEN 'beside the question' END) AS issues FROM judged")
def judged_answers(spark: SparkSession, sf: str) -> DataFrame:
    return A.judged(_answers(spark, sf)).select("qid", "faithfulness", "relevance", "passes", "issues")


@query(f"""WITH {JUDGED}, m AS (SELECT qid, question, {TOKENS.format('lower(question)')} AS q, {_LA} AS a FROM judged WHERE faithfulness < 0.7 OR relevance < 0.7),
w AS (SELECT qid, question, unnest(range(1, len(q) + 1)) AS i, q, a FROM m), f AS (SELECT qid, question, q[i] AS w, min(i) AS i FROM w WHERE NOT list_contains(a, q[i]) GROUP BY ALL)
SELECT m.qid, coalesce(string_agg(f.w, ' ' ORDER BY f.i), m.question) AS refined FROM m LEFT JOIN f ON f.qid = m.qid GROUP BY m.qid, m.question""")
def refined_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The query that a failing answer is sought with once more."""
    rows = _answers(spark, sf)
    failed = rows.join(A.judged(rows).where(~F.col("passes")).select("qid", "issues"), "qid")
    return failed.select("qid", OFFLINE.refine(F.col("question"), F.col("answer"), F.col("issues")).alias("refined"))


_PARTS = f"""parts AS (SELECT conv_id, turn, c, CAST(i - 1 AS INTEGER) AS part, p[i] AS q FROM (SELECT conv_id, turn, c, p, unnest(range(1, len(p) + 1)) AS i FROM (
SELECT conv_id, turn, c, CASE WHEN c = 'complex' AND len(s) > 0 THEN s ELSE [text] END AS p FROM (
SELECT conv_id, turn, text, {SENTENCES} AS s, CASE WHEN len({TOKENS.format('text')}) <= 8 THEN 'simple' WHEN len({TOKENS.format('text')}) <= 24 THEN 'moderate' ELSE 'complex' END AS c FROM conversations WHERE role = 'user'))))"""


@query(f"""WITH {_PARTS} SELECT conv_id, turn, c AS complexity, CASE WHEN c = 'complex' THEN 'multi-hop' ELSE 'dense' END AS retrieval_method, string_agg('> ' || q, chr(10) || chr(10) ORDER BY part) AS answer, string_agg(left(q, 300), '|' ORDER BY part) AS sources FROM parts GROUP BY conv_id, turn, c""")
def multi_hop(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as questions; a part's answer is its text, quoted, and its source the part."""
    asked = load(spark, sf, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("qid"), "text")
    source = F.array(F.struct(F.lit("").alias("url"), F.substring("text", 1, 300).alias("text")))
    parts = A.fan_out(asked).select("qid", "part", "complexity", F.col("text").alias("question"), F.concat(F.lit("> "), "text").alias("answer"), source.alias("sources"), F.lit("dense").alias("retrieval_method"), F.lit(False).alias("web_fallback"), F.lit("leaf").alias("namespace"))
    out = A.synthesize(parts)
    return out.select("qid.conv_id", "qid.turn", "complexity", "retrieval_method", "answer", F.array_join(F.transform("sources", lambda s: s["text"]), "|").alias("sources"))


@query("""SELECT user_id AS entry, max(ts) + INTERVAL 3600 SECOND AS expires_at FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 3600 SECOND > (SELECT max(ts) FROM events) - INTERVAL 12 HOUR""")
def cache_put(spark: SparkSession, sf: str) -> DataFrame:
    """Events as entries that users' later events replace; what expired twelve hours before the last event goes."""
    e = load(spark, sf, "events").select(F.col("user_id").alias("entry"), "ts", (F.col("ts") + F.expr("INTERVAL 3600 SECOND")).alias("expires_at"))
    now = e.agg(F.max("ts") - F.expr("INTERVAL 12 HOUR")).first()[0]
    early = F.dayofmonth("ts") <= 15
    return K.cache_put(e.where(early).drop("ts"), e.where(~early).drop("ts"), F.lit(now))


@query(f"SELECT DISTINCT qid, w AS entity FROM (SELECT item_id AS qid, unnest(list_transform({TOKENS.format('lower(text)')}, lambda w: regexp_replace(w, '^{_PUNCT}+|{_PUNCT}+$', '', 'g'))) AS w FROM benchmark) WHERE w <> ''")
def question_entities(spark: SparkSession, sf: str) -> DataFrame:
    return PR.questions(spark, sf).select("qid", F.explode(OFFLINE.entities(F.col("text"))).alias("entity"))


_LABEL = r"CASE WHEN regexp_matches(lower(text), '^how (to|do|can)\b') THEN 'parent' WHEN regexp_matches(lower(text), '^(what is|why|compare)\b') THEN 'raptor-l2' WHEN regexp_matches(lower(text), 'error|\(\)|parameter|option') THEN 'props' ELSE 'leaf' END"


@query(f"SELECT conv_id, turn, {_LABEL} AS namespace FROM conversations WHERE role = 'user'")
def route_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("qid"), OFFLINE.label(F.col("text")).alias("label"))
    return K.route_by_label(rows).select("qid.conv_id", "qid.turn", "namespace")


_LT, _LC = TOKENS.format("lower(truth)"), TOKENS.format("lower(context)")
_PAIRS = "pairs AS (SELECT conv_id, turn, question, CASE WHEN r = 'assistant' THEN nxt END AS answer, question AS context, CASE WHEN turn % 2 = 0 THEN nxt END AS truth FROM (SELECT conv_id, turn, role, text AS question, lead(text) OVER w AS nxt, lead(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) WHERE role = 'user')"


@query(f"""WITH {_PAIRS} SELECT conv_id, turn, CASE WHEN answer IS NULL THEN -1 ELSE {_SHARE.format(a=_LA, b=_LC)} END AS faithfulness, CASE WHEN answer IS NULL THEN -1 ELSE {_SHARE.format(a=_LQ, b=_LA)} END AS answer_relevancy,
CASE WHEN answer IS NULL THEN -1 ELSE {_SHARE.format(a=_LQ, b=_LC)} END AS context_precision, CASE WHEN truth IS NULL THEN NULL WHEN answer IS NULL THEN -1 ELSE {_SHARE.format(a=_LT, b=_LC)} END AS context_recall FROM pairs""")
def evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """All user turns with the turn after them; without an answer nothing can be judged."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = load(spark, sf, "conversations").withColumn("nxt", F.lead("text").over(w)).withColumn("r", F.lead("role").over(w)).where("role = 'user'")
    rows = rows.select(F.struct("conv_id", "turn").alias("qid"), F.col("text").alias("question"), F.when(F.col("r") == "assistant", F.col("nxt")).alias("answer"), F.array("text").alias("contexts"), F.when(F.col("turn") % 2 == 0, F.col("nxt")).alias("ground_truth"))
    return K.evaluate(rows).select("qid.conv_id", "qid.turn", "faithfulness", "answer_relevancy", "context_precision", "context_recall")


_CHUNKS = f"""WITH {WINDOW_CELLS}, i AS (SELECT s.doc_id, s.pos, sentence, CAST(sum(CASE WHEN sim < 0.85 THEN 1 ELSE 0 END) OVER (PARTITION BY s.doc_id ORDER BY s.pos) AS BIGINT) AS chunk
  FROM s LEFT JOIN sim ON sim.doc_id = s.doc_id AND sim.pos = s.pos), short AS (SELECT doc_id, text, len({SENTENCES}) AS n FROM documents WHERE len({SENTENCES}) BETWEEN 1 AND 2)
SELECT doc_id, chunk, string_agg(sentence, ' ' ORDER BY pos) AS text FROM i WHERE doc_id NOT IN (SELECT doc_id FROM short) GROUP BY doc_id, chunk UNION ALL SELECT doc_id, CAST(0 AS BIGINT), text FROM short"""
_CHUNK_PARENTS = _windows(f"({_CHUNKS})", "doc_id, chunk", 512, "parent")
_CHUNK_LEAVES = _windows(f"({_CHUNK_PARENTS})", "doc_id, chunk, parent", 150, "leaf")


@query(f"SELECT *, sha256('leaf|' || doc_id || '|' || chunk || '|' || parent || '|' || leaf) AS leaf_id, sha256('parent|' || doc_id || '|' || chunk || '|' || parent) AS parent_id FROM ({_CHUNK_LEAVES})")
def semantic_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves of parents of semantic chunks, as the engine ingests them."""
    return C.chunk_leaves(C.chunk_parents(C.semantic_chunks(load(spark, sf, "documents"))))


@query(f"SELECT d.source AS collection, count(DISTINCT d.doc_id) AS pages, count(leaf) AS leaves, count(DISTINCT (d.doc_id, chunk, parent)) FILTER (WHERE leaf IS NOT NULL) AS parents FROM documents d LEFT JOIN ({_CHUNK_LEAVES}) l USING (doc_id) GROUP BY d.source")
def hierarchy_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Pages, leaves and parents of each source, counted from their rows."""
    docs = load(spark, sf, "documents")
    rows = docs.select("doc_id", "source").join(C.chunk_leaves(C.chunk_parents(C.semantic_chunks(docs))), "doc_id", "left")
    each = rows.groupBy("source", "doc_id").agg(F.count("leaf").alias("l"), F.count_distinct("parent_id").alias("p"))
    return each.groupBy(F.col("source").alias("collection")).agg(F.count("*").alias("pages"), F.sum("l").alias("leaves"), F.sum("p").alias("parents"))


@query("SELECT doc_id, 'none' AS wanted FROM documents UNION ALL SELECT doc_id, 'some' FROM documents WHERE source = (SELECT min(source) FROM documents)")
def corpus_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """A collection's documents; all documents where it has none."""
    docs = load(spark, sf, "documents").select("doc_id", "source")
    first = docs.agg(F.min("source")).first()[0]
    none = or_else(docs.where(F.col("source") == "no such collection"), docs).select("doc_id", F.lit("none").alias("wanted"))
    return none.unionByName(or_else(docs.where(F.col("source") == first), docs).select("doc_id", F.lit("some").alias("wanted")))


@query("SELECT event_id, event_type AS kind, coalesce(json_extract_string(props, '$.k'), 'none') AS k, 'event' AS chunk_type FROM events")
def metadata_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata of a row, over which that of its kind is laid; defaults fill what neither has."""
    own = F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))
    kind = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("chunk_type"), F.lit("event"))
    defaults = F.create_map(F.lit("k"), F.lit("none"), F.lit("kind"), F.lit("none"), F.lit("chunk_type"), F.lit("none"))
    over = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)
    merged = once(over(defaults, over(own, kind)), lambda m: m)
    return load(spark, sf, "events").select("event_id", merged.alias("m")).select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["k"].alias("k"), F.col("m")["chunk_type"].alias("chunk_type"))


_SPACES = ", ".join(f"'{space}'" for _, space in ROUTES)


@query(rf"SELECT DISTINCT source || '-' || s AS ns, regexp_replace(source || '-' || s, '-[^-]*$', '') AS collection FROM documents, (SELECT unnest([{_SPACES}]) AS s)")
def namespace_collection(spark: SparkSession, sf: str) -> DataFrame:
    """The namespaces of each source's documents, and their names without the last part: of a namespace that has a dash itself, not the source."""
    spaces = F.explode(F.array(*(F.lit(space) for _, space in ROUTES))).alias("s")
    rows = load(spark, sf, "documents").select("source").distinct().select("source", spaces)
    ns = F.concat("source", F.lit("-"), "s")
    return rows.select(ns.alias("ns"), F.regexp_replace(ns, "-[^-]*$", "").alias("collection"))


#: What a model might have replied of each turn: well-formed, cut off, without the key, of another type, of mixed elements, or no JSON.
_REPLIES = """SELECT conv_id, turn, text, CASE (conv_id * 7 + turn) % 6
WHEN 0 THEN CAST(to_json({{'statements': [text, 'and more']}}) AS VARCHAR) WHEN 1 THEN left(CAST(to_json({{'statements': [text]}}) AS VARCHAR), 15 + length(text) // 2)
WHEN 2 THEN CAST(to_json({{'other': [text]}}) AS VARCHAR) WHEN 3 THEN CAST(to_json({{'statements': text}}) AS VARCHAR)
WHEN 4 THEN '{{"statements": [3, null, ' || CAST(to_json(text) AS VARCHAR) || ', ["x"], true]}}' ELSE text END AS reply FROM conversations""".replace("{{", "{").replace("}}", "}")


@query(rf"""WITH r AS ({_REPLIES}), d AS (SELECT conv_id, turn, text, CASE WHEN json_valid(reply) THEN CASE WHEN json_type(reply, '$.statements') = 'ARRAY' THEN
list_transform(list_filter(CAST(json_extract(reply, '$.statements') AS JSON[]), lambda x: json_type(x) = 'VARCHAR'), lambda x: x ->> '$') END END AS found FROM r)
SELECT conv_id, turn, CAST(coalesce(nullif(len(found), 0), 1) AS INTEGER) AS n, CASE WHEN len(found) > 0 THEN found[1] ELSE text END AS first FROM d""")
def decoded_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Statements in recorded replies; where a reply gives none, the turn's own text is the one."""
    text = F.col("text")
    whole = F.to_json(F.struct(F.array(text, F.lit("and more")).alias("statements")))
    cut = F.substring(F.to_json(F.struct(F.array(text).alias("statements"))), F.lit(1), 15 + F.floor(F.char_length(text) / 2).cast("int"))
    listed = F.to_json(F.array(text))
    mixed = F.concat(F.lit('{"statements": [3, null, '), F.substring(listed, F.lit(2), F.char_length(listed) - 2), F.lit(', ["x"], true]}'))
    case = (F.col("conv_id") * 7 + F.col("turn")) % 6
    reply = F.when(case == 0, whole).when(case == 1, cut).when(case == 2, F.to_json(F.struct(F.array(text).alias("other")))).when(case == 3, F.to_json(F.struct(text.alias("statements")))).when(case == 4, mixed).otherwise(text)
    found = decode_strings(F.col("reply"), "statements", F.array("text"))
    rows = load(spark, sf, "conversations").select("conv_id", "turn", "text", reply.alias("reply")).select("conv_id", "turn", found.alias("f"))
    return rows.select("conv_id", "turn", F.size("f").alias("n"), F.col("f")[0].alias("first"))


@query(f"WITH c AS ({oracle('context_assembly')}), g AS ({oracle('graph_context')}) SELECT c.qid, concat_ws(chr(10) || chr(10) || '---' || chr(10) || chr(10), g.context, c.context) AS context FROM c LEFT JOIN g USING (qid)")
def context_with_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The context of a question with its graph context in front."""
    graph = PK.graph_context(spark, sf).withColumnRenamed("context", "g")
    return PR.context_assembly(spark, sf).join(graph, "qid", "left").select("qid", F.concat_ws(A.SEPARATOR, "g", "context").alias("context"))

"""Propositions, the entity graph, routing, the semantic cache, the summary tree and grading."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, Config
from lodestone.functions import cosine, sentences, tokens
from lodestone.functions.vectors import hash_cells
from lodestone.providers import DEFAULT_ROUTE, OFFLINE, ROUTE_WORDS, ROUTES, Offline
from lodestone.operators.retrieval import dense_topk
from lodestone.sources.sinks import latest
from lodestone.sources.tables import bounded, cut


#: Fixed value: what stands before the relations of a question.
GRAPH_HEADER = "Knowledge graph context:\n"


def propositions(leaf_rows: DataFrame, provider: Offline = OFFLINE, key: list[str] | None = None) -> DataFrame:
    """key (doc_id, parent and leaf), ord and text of the statements of each leaf."""
    return leaf_rows.select(*(key or ["doc_id", "parent", "leaf"]), F.posexplode(provider.propositions(F.col("text"))).alias("ord", "text"))


def relations(docs: DataFrame, provider: Offline = OFFLINE) -> DataFrame:
    """doc_id, pos, subject, relation and object; repeats are kept. A malformed triple is left out."""
    rows = docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "s"))
    # a triple or none is exploded, so that it is made once
    rows = rows.select("doc_id", "pos", F.explode(F.filter(F.array(provider.triples(F.col("s"))), lambda t: F.size(t) == 3)).alias("t"))
    return rows.select("doc_id", "pos", F.col("t")[0].alias("subject"), F.col("t")[1].alias("relation"), F.col("t")[2].alias("object"))


def adjacency(edges: DataFrame) -> DataFrame:
    """node and neighbour, both ways, each once."""
    there = edges.select(F.col("subject").alias("node"), F.col("object").alias("neighbour"))
    back = edges.select(F.col("object").alias("node"), F.col("subject").alias("neighbour"))
    return there.unionByName(back).distinct()


def entity_sources(relations: DataFrame) -> DataFrame:
    """entity and doc_id of each document that relates it, once."""
    return relations.select(F.explode(F.array("subject", "object")).alias("entity"), "doc_id").distinct()


def reach(adjacent: DataFrame, seeds: DataFrame, hops: int = 2, inclusive: bool = False) -> DataFrame:
    """qid and node within reach of seeds (qid, node): distance below ``hops``, or up to it if ``inclusive``.

    One join a hop: the frontier's neighbours less what was visited.
    """
    seen = front = seeds.distinct()
    for _ in range(hops if inclusive else hops - 1):
        new = front.join(adjacent, "node").select("qid", F.col("neighbour").alias("node")).distinct()
        front = new.join(seen, ["qid", "node"], "left_anti")
        seen = seen.unionByName(front)
    return seen


def _spread(edges: DataFrame, near: DataFrame, config: Config) -> DataFrame:
    """near (word, node, bits) and the neighbours of its nodes: sets of questions are added up within tasks before they are shuffled."""
    own = bounded(near, config.broadcast_rows)
    found = [edges.select(F.col(a).alias("node"), F.col(b).alias("to")).join(own, "node").select("word", F.col("to").alias("node"), "bits") for a, b in (("subject", "object"), ("object", "subject"))]
    return near.unionByName(found[0]).unionByName(found[1]).groupBy("word", "node").agg(F.bit_or("bits").alias("bits"))


def _until(edges: DataFrame, seeds: DataFrame, config: Config) -> DataFrame:
    """qid and until: where its last relation can stand at most, the place of the last of the first ones that touch a seed; null if these are too few.

    Both ends of such a relation are within reach from two hops on, so what comes after is never among the first. The first
    relations of a question are among the first of its seeds: each seed's are found once, however many questions have it.
    """
    nodes, k = bounded(seeds.select("node").distinct(), config.broadcast_rows), config.graph_relations

    def firsts(end: str) -> DataFrame:
        rows = edges.select(F.col(end).alias("node"), "doc_id", "pos", "subject").join(nodes, "node", "left_semi")
        return rows.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("doc_id", "pos"))).where(F.col("k") <= k).join(seeds, "node")

    twice = firsts("object").join(seeds.withColumnRenamed("node", "subject"), ["qid", "subject"], "left_anti")  # one with two seeds counts by its subject
    touched = firsts("subject").select("qid", "doc_id", "pos").unionByName(twice.select("qid", "doc_id", "pos"))
    last = touched.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("doc_id", "pos"))).where(F.col("k") == k)
    return seeds.select("qid").distinct().join(last.select("qid", F.struct("doc_id", "pos").alias("until")), "qid", "left")


def graph_context(edges: DataFrame, seeds: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """qid and context: a header, then the first relations, by (doc_id, pos), with both ends within reach, a line each.

    Edges are checkpointed: each is made once, however many steps read it. The questions that reach a node are a set of bits, 64 to
    a word, so common words, which all questions reach, cost a few numbers a node and no row a question. A question meets the
    edges up to its ``_until`` alone; a question without one has few edges at its seeds, so little is within its reach.
    """
    edges, seeds = cut(edges), cut(seeds.select("qid", "node").distinct())
    until = _until(edges, seeds, config) if config.graph_hops > 1 else seeds.select("qid", F.lit(None).cast("struct<doc_id:string,pos:int>").alias("until")).distinct()
    # questions that end near each other share words; those without an end have words of their own
    parts = seeds.select("qid").distinct().count() // 4096 + 1
    ordered = until.orderBy(F.asc_nulls_last("until"), "qid").coalesce(parts).withColumn("n", F.monotonically_increasing_id())
    word = F.when(F.col("until").isNull(), -1 - F.shiftright("n", 6)).otherwise(F.shiftright("n", 6))
    asked = cut(ordered.select("qid", "until", word.alias("word"), F.expr("shiftleft(1L, CAST(n & 63 AS INT))").alias("bit")))
    near = seeds.join(asked.select("qid", "word", "bit"), "qid").groupBy("word", "node").agg(F.bit_or("bit").alias("bits"))
    for _ in range(config.graph_hops - 1):
        near = _spread(edges, near, config)
    near = cut(near)
    place = F.struct("doc_id", "pos")
    within = lambda end: F.col(end).isNull() | (place <= F.col(end)) if config.graph_hops > 1 else F.lit(True)
    ends = asked.groupBy("word").agg(F.max("until").alias("end"))
    begun = near.join(bounded(ends, config.broadcast_rows), "word").select("word", "end", F.col("node").alias("subject"), "bits")
    left = edges.join(begun, "subject").where(within("end")).drop("end")
    inner = left.join(near.select("word", F.col("node").alias("object"), F.col("bits").alias("b")), ["word", "object"]).withColumn("bits", F.col("bits").bitwiseAND(F.col("b"))).where("bits <> 0")
    each = inner.join(bounded(asked, config.broadcast_rows), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0).where(within("until"))
    first = each.select("qid", "doc_id", "pos", "subject", "relation", "object").withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("doc_id", "pos"))).where(F.col("k") <= config.graph_relations)
    line = F.concat_ws(" → ", "subject", "relation", "object")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"])
    return first.groupBy("qid").agg(F.concat(F.lit(GRAPH_HEADER), F.array_join(lines, "\n")).alias("context"))


def semantic_route(questions: DataFrame) -> DataFrame:
    """qid, label and namespace of the route whose words are nearest by hashed embeddings; the first label wins ties."""
    spark = questions.sparkSession
    routes = spark.createDataFrame([(i, label, space, ROUTE_WORDS[label]) for i, (label, space) in enumerate(ROUTES)], "ord int, label string, namespace string, text string")
    q = hash_cells(questions.select("qid", F.explode(tokens(F.lower("text"))).alias("token")), ["qid"])
    r = hash_cells(routes.select("ord", F.explode(tokens(F.lower("text"))).alias("token")), ["ord"])
    dots = q.join(F.broadcast(r.withColumnRenamed("value", "w")), "bucket").groupBy("qid", "ord").agg(F.sum(F.col("value") * F.col("w")).alias("dot"))  # four routes
    length = r.groupBy("ord").agg(F.sqrt(F.sum(F.col("value") * F.col("value")).cast("double")).alias("len"))
    every = questions.select("qid").crossJoin(F.broadcast(routes.select("ord", "label", "namespace").join(length, "ord")))
    scored = every.join(dots, ["qid", "ord"], "left").withColumn("score", F.round(F.coalesce(F.col("dot") / F.col("len"), F.lit(0.0)), 6))
    first = Window.partitionBy("qid").orderBy(F.desc("score"), "ord")
    return scored.withColumn("k", F.row_number().over(first)).where("k = 1").select("qid", "label", "namespace")


def route_by_label(labelled: DataFrame) -> DataFrame:
    """Of qid and a label that a model gave: the route's namespace; unknown and null labels fall to the default route."""
    routes = labelled.sparkSession.createDataFrame(list(ROUTES), "label string, namespace string")
    fallback = dict(ROUTES)[DEFAULT_ROUTE]
    return labelled.join(F.broadcast(routes), "label", "left").select("qid", F.coalesce("namespace", F.lit(fallback)).alias("namespace"))  # four routes


def cache_lookup(asked: DataFrame, entries: DataFrame, now, config: Config = DEFAULT, others: bool = False) -> DataFrame:
    """qid, entry and similarity of the best live entry of the same collection at or above the threshold; the oldest wins ties.

    asked: qid, collection, q; entries: entry, collection, embedding, expires_at. ``others``: a question's own entry, of its
    qid, is no hit.
    """
    live = entries.where(F.col("expires_at") > now).select(F.col("entry").alias("vec_id"), "collection", "embedding")
    best = dense_topk(live, asked, 1, config, others=others, by="collection", digits=4)
    hit = (F.col("score") >= config.cache_similarity) & (F.col("score") > 0)
    return best.where(hit).select("qid", F.col("vec_id").alias("entry"), F.col("score").alias("similarity"))


def newest(entries: DataFrame) -> DataFrame:
    """Of one entry, the row that lives longest."""
    return latest(entries, ["entry"], "expires_at")


def cache_put(stored: DataFrame, new: DataFrame, now) -> DataFrame:
    """The live entries of both (entry, ..., expires_at); of one entry, the one that lives longest."""
    return newest(stored.unionByName(new).where(F.col("expires_at") > now))


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert or replace by key: a stored row stays unless a new one has its key."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def cluster_count(n):
    """Clusters of n nodes: max(2, min(floor(sqrt n), n div 5))."""
    return F.greatest(F.lit(2), F.least(F.floor(F.sqrt(n)), F.floor(n / 5))).cast("long")


def nearest(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """vec_id and centre of greatest cosine, the smaller centre in ties; centres are at most a few hundred rows."""
    pairs = vectors.crossJoin(bounded(centres, 1000)).select("vec_id", "centre", F.round(cosine(F.col("embedding"), F.col("c")), 6).alias("s"))
    return pairs.groupBy("vec_id").agg(F.max_by("centre", F.struct("s", -F.col("centre"))).alias("centre"))


def summary_tree(nodes: DataFrame, config: Config = DEFAULT, provider: Offline = OFFLINE) -> list[DataFrame]:
    """Levels of a tree over nodes (id, ord, text, embedding): each clusters the one before; a level stops below the least count.

    The driver sees counts, and the centres of each round, of which there are the root of the nodes: K-means compares blocks of
    vectors with all centres, where its row form has a task a centre and round for distances between centres. A cluster's summary
    takes its first members; child_ids keeps all.
    """
    levels, here = [], nodes
    for level in range(1, config.tree_levels + 1):
        n = here.count()
        if n < config.tree_min_nodes:
            break
        k = max(2, min(int(n**0.5), n // 5))
        data = here.withColumn("features", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
        placed = KMeans(k=k, seed=42, solver="block", featuresCol="features", predictionCol="cluster").fit(data).transform(data)
        nth = F.row_number().over(Window.partitionBy("cluster").orderBy("ord"))
        first = placed.withColumn("nth", nth)
        text = F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= config.texts_per_summary, F.struct("nth", "text")))), lambda x: x["text"])
        dims = len(here.select("embedding").first()[0])
        mean = F.array(*(F.avg(F.col("embedding")[i].cast("double")) for i in range(dims)))
        here = first.groupBy("cluster").agg(F.collect_list("id").alias("child_ids"), provider.summary(text, config.texts_per_summary).alias("text"), mean.alias("embedding"))
        here = here.select(F.sha2(F.concat_ws("|", F.lit("tree"), F.lit(level), "cluster"), 256).alias("id"), F.col("cluster").alias("ord"), F.lit(level).alias("level"), "text", "embedding", "child_ids")
        here = cut(here)
        levels.append(here)
    return levels


def grade_answers(rows: DataFrame, config: Config = DEFAULT, provider: Offline = OFFLINE) -> DataFrame:
    """Of qid, question, answer, context: faithfulness, relevance, supported, issues and whether it passes.

    Where a text is null the judge fails, and a failed judge lets pass: both scores are 1, without issues.
    """
    judged = F.col("question").isNotNull() & F.col("answer").isNotNull() & F.col("context").isNotNull()
    score = lambda a, b: F.when(judged, F.round(provider.containment(F.col(a), F.col(b)), 4)).otherwise(1.0)
    scored = rows.select("qid", score("answer", "context").alias("faithfulness"), score("question", "answer").alias("relevance"))
    faithful, relevant = F.col("faithfulness") >= config.faithfulness_pass, F.col("relevance") >= config.relevance_pass
    issues = F.concat_ws(",", F.when(~faithful, "unsupported"), F.when(~relevant, "beside the question"))
    return scored.withColumns({"supported": faithful, "issues": issues, "passes": faithful & relevant})


def evaluate(rows: DataFrame, provider: Offline = OFFLINE) -> DataFrame:
    """Of qid, question, answer, contexts (an array) and ground_truth: faithfulness, answer_relevancy, context_precision and context_recall.

    Scores are from 0 to 1, of four digits; context_recall is null without a ground truth. Where the question, the answer or
    the contexts are null there is nothing to judge, and each score is -1.
    """
    judged = F.col("question").isNotNull() & F.col("answer").isNotNull() & F.col("contexts").isNotNull()
    rows = rows.withColumn("context", F.array_join("contexts", "\n\n"))
    score = lambda a, b: F.when(judged, F.round(provider.containment(F.col(a), F.col(b)), 4)).otherwise(-1.0)
    recall = F.when(F.col("ground_truth").isNotNull(), score("ground_truth", "context"))
    return rows.select("qid", score("answer", "context").alias("faithfulness"), score("question", "answer").alias("answer_relevancy"), score("question", "context").alias("context_precision"), recall.alias("context_recall"))

"""The library's surface: ingest pages or a site, answer batches of questions, grade answers.

Collections are Parquet tables under one folder, which driver and executors share. An ingest writes tables of a new version and
then commits it, in one file that names them: until then, and if it fails, all see the version before. Calls read the version
that is the last when they begin. Each step of a batch of questions is written to a folder of its own and read back, so no plan
grows with the flow and a lost executor costs a step; the steps are deleted when the answers are written.

A collection that nothing was ingested into is empty: questions get answers without sources.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.config import DEFAULT, Config
from lodestone.functions import clean_html, normal_url, origin, slug
from lodestone.functions.vectors import embed
from lodestone.operators import answers as A
from lodestone.operators import chunking, knowledge, retrieval
from lodestone.providers import OFFLINE, Offline
from lodestone.sources import web as W
from lodestone.sources.commits import Commits
from lodestone.sources.sinks import server_sent_events

CACHE = "entry long, question string, embedding array<long>, answer string, sources array<struct<url:string,text:string>>, retrieval_method string, web_fallback boolean, namespace string, complexity string, expires_at timestamp"
#: Tables of a collection, with their schemas.
SCHEMAS = {
    "pages": "doc_id long, url string, slug string, text string",
    "parents": "doc_id long, url string, chunk long, parent int, text string, parent_id string",
    "leaves": "doc_id long, url string, chunk long, parent int, parent_id string, leaf int, text string, leaf_id string",
    "propositions": "leaf_id string, doc_id long, url string, ord int, text string",
    "relations": "leaf_id string, pos int, subject string, relation string, object string",
    "chunks": "ns string, id string, url string, text string, embedding array<long>",
    "tree": "id string, ord int, level int, text string, embedding array<double>, child_ids array<string>",
    "postings": "ns string, id string, term string, tf long, dl long",
    "terms": "ns string, term string, df long, idf double",
}
COUNTED = ("pages", "parents", "leaves", "propositions", "relations")
VERSION = "1.0.0"


class IngestRunning(RuntimeError):
    """Another ingest into the collection hasn't ended."""


class NothingToIngest(ValueError):
    """A start URL under which no page was found."""


@dataclass
class Pinned:
    """A version of a collection: what it says of itself, and its tables."""

    spark: SparkSession
    collection: str
    version: int
    state: dict

    def table(self, name: str) -> DataFrame:
        found = self.state.get("tables", {}).get(name)
        if not found:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(StructType.fromJson(json.loads(found["schema"]))).parquet(found["path"])

    def index(self, ns: str) -> A.Index:
        own = F.col("ns") == ns
        post = self.table("postings").where(own).select(F.col("id").alias("doc_id"), "term", "tf", "dl")
        return A.Index(self.table("chunks").where(own), post, self.table("terms").where(own).select("term", "df", "idf"), self.state["mean_length"][ns])

    @property
    def namespaces(self) -> list[str]:
        """Those that have chunks."""
        return self.state.get("namespaces", [])


class Steps:
    """A folder for the steps of one call."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.run = spark, uuid.uuid4().hex
        self.path = f"{folder}/{self.run}"

    def keep(self, rows: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def forget(self) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Engine:
    """Collections of pages under a folder, each a sequence of versions."""

    def __init__(self, spark: SparkSession, folder: str, config: Config = DEFAULT, provider: Offline = OFFLINE):
        self.spark, self.folder, self.config, self.provider = spark, folder.rstrip("/"), config, provider

    # --- versions

    def _log(self, collection: str) -> Commits:
        return Commits(self.spark, f"{self.folder}/collections/{quote(collection, safe='')}")

    def pin(self, collection: str, version: int | None = None) -> Pinned:
        """A version of a collection, the last by default; version 0 is empty."""
        log = self._log(collection)
        at, state = log.last() if version is None else (version, log.read(version))
        return Pinned(self.spark, collection, at, state)

    def vacuum(self, collection: str, keep: int = 2) -> None:
        """Delete the files of versions before the last ``keep``; not while an ingest runs."""
        if self.ingest_status(collection) == "running":
            raise IngestRunning(collection)
        self._log(collection).vacuum(keep)

    def _steps(self) -> Steps:
        return Steps(self.spark, f"{self.folder}/_steps")

    # --- ingest

    def ingest(self, pages: DataFrame, collection: str, replace: bool = True) -> DataFrame:
        """Clean, chunk, embed, index and link pages (url, html), as a new version of the collection. Gives its counts.

        The pages replace the collection's, or, without ``replace``, are added to them: one whose URL is there takes its place.
        Ingesting twice is ingesting once. Pages without text, and such without a URL, are left out. Leaves and parents are cut
        from semantic chunks; every leaf gives statements, relations and a node of the summary tree. The status is ``running``,
        then ``done`` or ``error``; ``IngestRunning`` if it is running already.
        """
        log = self._log(collection)
        self._enter(log, collection)
        steps = self._steps()
        try:
            before = self.pin(collection)
            state = self._ingest(pages, None if replace else before, log.new_folder(), steps)
            log.commit(before.version + 1, state)
        except Exception as e:
            log.put("status.json", json.dumps({"status": "error", "message": str(e)[:500]}))
            raise
        else:
            log.put("status.json", json.dumps({"status": "done", "message": ""}))
        finally:
            log.delete("running.json")
            steps.forget()
        return self.summary(collection)

    def _enter(self, log: Commits, collection: str) -> None:
        now = time.time()
        while not log.create("running.json", json.dumps({"at": now})):
            found = log.get("running.json")
            if found is None or now - json.loads(found)["at"] < self.config.ingest_timeout_seconds:
                raise IngestRunning(collection)
            log.delete("running.json")

    def ingest_site(self, start: str, fetched: DataFrame, collection: str, replace: bool = True, max_pages: int | None = None) -> DataFrame:
        """Ingest the pages under a start URL, of ``fetched`` (source, status, body): robots files, sitemaps and pages as they came.

        Pages are those of the site's sitemap, or, if it has none, those that links reach. ``NothingToIngest`` if there are
        none with status 200, and the collection stays as it is.
        """
        good = fetched.where((F.col("status") == 200) & F.col("body").isNotNull())
        robots = good.where(F.col("source").endswith("/robots.txt")).select(origin(F.col("source")).alias("origin"), "body")
        links = W.page_links(good.select(F.col("source").alias("url"), F.col("body").alias("html")))
        found = W.discover_site(start, robots, fetched, links, max_pages)
        urls = found.select("url", normal_url(F.col("url")).alias("key"))
        bodies = good.select(normal_url(F.col("source")).alias("key"), F.col("body").alias("html")).dropDuplicates(["key"])
        pages = urls.join(bodies, "key").select("url", "html")
        steps = self._steps()
        try:
            pages = steps.keep(pages, "site")
            if pages.isEmpty():
                self._log(collection).put("status.json", json.dumps({"status": "error", "message": f"no pages under {start}"}))
                raise NothingToIngest(f"no pages under {start}")
            return self.ingest(pages, collection, replace)
        finally:
            steps.forget()

    def _ingest(self, pages: DataFrame, before: Pinned | None, folder: str, steps: Steps) -> dict:
        """Write the tables of a version; what its commit says."""
        tables: dict[str, dict] = {}

        def write(rows: DataFrame, name: str, *more) -> DataFrame:
            """Counts are taken by the job that writes."""
            seen, path = Observation(), f"{folder}/{name}"
            rows.observe(seen, F.count(F.lit(1)).alias("rows"), *more).write.parquet(path)
            tables[name] = {"path": path, "schema": rows.schema.json(), **seen.get}
            return self.spark.read.schema(rows.schema).parquet(path)

        clean = pages.where("url IS NOT NULL").dropDuplicates(["url"]).select(F.xxhash64("url").alias("doc_id"), "url", slug(F.col("url")).alias("slug"), clean_html(F.col("html")).alias("text")).where("text <> ''")
        new = steps.keep(clean, "new-pages")
        kept = lambda name, key="doc_id", gone=None: before.table(name).join(new.select("doc_id") if gone is None else gone, key, "left_anti")
        both = lambda rows, name, **how: rows if before is None else rows.unionByName(kept(name, **how))
        docs = write(both(new, "pages"), "pages")
        own_parents = steps.keep(chunking.chunk_parents(chunking.semantic_chunks(new, self.config, ("url",)), self.config, ("url",)), "new-parents")
        parents = write(both(own_parents, "parents"), "parents")
        own_leaves = steps.keep(chunking.chunk_leaves(own_parents, self.config, ("url",)), "new-leaves")
        leaves = write(both(own_leaves, "leaves"), "leaves")
        own_props = knowledge.propositions(own_leaves, self.provider, ["leaf_id", "doc_id", "url"])
        props = write(both(own_props, "propositions"), "propositions")
        own_relations = knowledge.relations(own_leaves.select(F.col("leaf_id").alias("doc_id"), "text"), self.provider).withColumnRenamed("doc_id", "leaf_id")
        gone = None if before is None else before.table("leaves").join(new.select("doc_id"), "doc_id", "left_semi").select("leaf_id")
        write(both(own_relations, "relations", key="leaf_id", gone=gone), "relations")

        named = [
            leaves.select(F.lit("leaf").alias("ns"), F.col("leaf_id").alias("id"), "url", "text"),
            parents.select(F.lit("parent").alias("ns"), F.col("parent_id").alias("id"), "url", "text"),
            props.select(F.lit("props").alias("ns"), F.sha2(F.concat_ws("|", F.lit("prop"), "leaf_id", "ord"), 256).alias("id"), "url", "text"),
        ]
        keep = ("ns", "url", "text")
        base = steps.keep(embed(reduce(DataFrame.unionByName, named), "id", self.config.embed_dims, keep), "chunks")
        nodes = base.where("ns = 'leaf'").select("id", F.xxhash64("id").alias("ord"), "text", "embedding")
        levels = knowledge.summary_tree(nodes, self.config, self.provider)
        tree = reduce(DataFrame.unionByName, levels) if levels else self.spark.createDataFrame([], SCHEMAS["tree"])
        tree = write(tree, "tree", F.coalesce(F.max("level"), F.lit(0)).alias("levels"))
        upper = tree.select(F.concat(F.lit("raptor-l"), "level").alias("ns"), "id", F.lit("").alias("url"), "text")
        every = base.unionByName(embed(upper, "id", self.config.embed_dims, keep))
        spaces = ["leaf", "parent", "props", *(f"raptor-l{k + 1}" for k in range(self.config.tree_levels))]
        chunks = write(every.select("ns", "id", "url", "text", "embedding"), "chunks", *(F.count(F.when(F.col("ns") == x, 1)).alias(x) for x in spaces))

        # pages are indexed too, for what stands in for the web. Files are ranges of terms, in which a question reads few row groups
        texts = chunks.select("ns", "id", "text").unionByName(docs.select(F.lit("page").alias("ns"), F.col("doc_id").cast("string").alias("id"), "text"))
        words = [F.coalesce(F.sum(F.when(F.col("ns") == x, F.col("tf"))), F.lit(0)).alias(x) for x in (*spaces, "page")]
        post = retrieval.postings(texts, "id", keep=("ns",)).select("ns", "id", "term", "tf", "dl")
        post = write(post.repartitionByRange("ns", "term", "id").sortWithinPartitions("ns", "term", "id"), "postings", *words)
        n = {x: tables["chunks"][x] for x in spaces} | {"page": tables["pages"]["rows"]}
        mean_length = {x: tables["postings"][x] / n[x] if n[x] else 0.0 for x in n}
        df = steps.keep(post.groupBy("ns", "term").agg(F.count("*").alias("df")), "frequencies")
        stats = [retrieval.bm25_stats(df.where(F.col("ns") == x).select("term", "df"), n[x], self.config).select(F.lit(x).alias("ns"), "term", "df", "idf") for x in n]
        write(reduce(DataFrame.unionByName, stats).repartitionByRange("ns", "term").sortWithinPartitions("ns", "term"), "terms")
        return {"tables": tables, "namespaces": [x for x in spaces if n[x]], "mean_length": mean_length}

    def summary(self, collection: str) -> DataFrame:
        """One row: pages, parents, leaves, propositions and relations of a collection, levels and nodes of its tree; as they were counted when written."""
        t = self.pin(collection).state.get("tables", {})
        row = [t.get(n, {}).get("rows", 0) for n in COUNTED] + [t.get("tree", {}).get("levels", 0), t.get("tree", {}).get("rows", 0)]
        return self.spark.createDataFrame([tuple(row)], ", ".join([*(f"{n} long" for n in COUNTED), "tree_levels int", "tree_nodes long"]))

    def ingest_status(self, collection: str) -> str:
        """not_started, running, done or error."""
        log = self._log(collection)
        if log.get("running.json") is not None:
            return "running"
        found = log.get("status.json")
        return json.loads(found)["status"] if found else "not_started"

    # --- steps of a batch

    def retrieve(self, questions: DataFrame, collection: str | Pinned, top_k: int | None = None, use_hyde: bool = True, use_hybrid: bool = True) -> DataFrame:
        """Hits of each of questions (qid, text, namespace) in its namespace; one that the collection doesn't have falls to leaves."""
        pinned = collection if isinstance(collection, Pinned) else self.pin(collection)
        questions = self._there(questions, pinned)
        out = self.spark.createDataFrame([], f"qid {dict(questions.dtypes)['qid']}, rank int, id string, url string, text string, score double, retrieval_method string")
        for ns in pinned.namespaces:  # five at most
            hits = A.retrieve(pinned.index(ns), questions.where(F.col("namespace") == ns), top_k or self.config.top_k, use_hyde, use_hybrid, self.config, self.provider)
            out = out.unionByName(hits)
        return out

    @staticmethod
    def _there(questions: DataFrame, pinned: Pinned) -> DataFrame:
        """Questions with the namespace that they read: leaves where the collection doesn't have their own."""
        return questions.withColumn("namespace", F.when(F.col("namespace").isin(pinned.namespaces), F.col("namespace")).otherwise("leaf"))

    def route(self, questions: DataFrame, strategy: str = "llm") -> DataFrame:
        """qid and namespace: by the nearest description, or by the provider's label, the default for unknown ones."""
        if strategy == "semantic":
            return knowledge.semantic_route(questions).select("qid", "namespace")
        return knowledge.route_by_label(questions.select("qid", self.provider.label(F.col("text")).alias("label")))

    def graph_context(self, questions: DataFrame, collection: str | Pinned) -> DataFrame:
        """qid and context by the collection's relations, for questions that have any."""
        pinned = collection if isinstance(collection, Pinned) else self.pin(collection)
        edges = pinned.table("relations").select(F.col("leaf_id").alias("doc_id"), "pos", "subject", "relation", "object")
        seeds = questions.select("qid", F.explode(self.provider.entities(F.col("text"))).alias("node"))
        return knowledge.graph_context(edges, seeds.join(knowledge.adjacency(edges).select("node").distinct(), "node", "left_semi").select("qid", "node"), self.config)

    def web(self, questions: DataFrame, collection: str | Pinned) -> DataFrame:
        """qid, rank, id, url, text and score of web results; offline, the pages with most of the question's rarest words."""
        pinned = collection if isinstance(collection, Pinned) else self.pin(collection)
        pages = pinned.table("pages").select(F.col("doc_id").cast("string").alias("doc_id"), "url", "text")
        if not pinned.version:
            return questions.limit(0).select("qid", F.lit(1).alias("rank"), F.lit("").alias("id"), F.lit("").alias("url"), F.lit("").alias("text"), F.lit(1.0).alias("score"))
        index = pinned.index("page")
        scores = retrieval.bm25_from(index.post, index.stats, index.mean_length, questions, self.config).withColumn("score", F.round("score", 6))
        hits = retrieval.top(scores, self.config.web_results, F.desc("score"), F.col("doc_id").cast("long")).join(pages, "doc_id")
        return hits.select("qid", "rank", F.concat(F.lit("web-"), F.col("rank") - 1).alias("id"), "url", "text", F.lit(1.0).alias("score"))

    def _single(self, steps: Steps, questions: DataFrame, pinned: Pinned, top_k: int, strategy: str, hyde: bool, hybrid: bool) -> DataFrame:
        """Of questions (qid, text): routed, retrieved, graded, answered and, where the judge fails an answer, answered once more."""
        keep = steps.keep
        routed = keep(self._there(questions.join(self.route(questions, strategy), "qid"), pinned), "routed")
        hits = keep(self.retrieve(routed, pinned, top_k, hyde, hybrid), "hits")
        graded = keep(retrieval.grade(A.rerank(hits, questions, self.config), self.config), "graded")
        # a question without any hit falls back too
        alone = questions.join(graded.where(~F.col("web_fallback")).select("qid").distinct(), "qid", "left_anti")
        web = keep(self.web(keep(alone, "to-web"), pinned), "web")
        asked = retrieval.union(graded, alone.select("qid").withColumn("web_fallback", F.lit(True)))
        answered = A.generate(A.with_web(asked, web), questions, self.graph_context(questions, pinned), self.config, self.provider)
        fell = alone.select("qid", F.lit(True).alias("fell"))
        answered = answered.join(fell, "qid", "left").withColumn("web_fallback", F.coalesce("fell", F.lit(False))).drop("fell")
        answered = answered.withColumn("retrieval_method", F.when(F.col("web_fallback"), "web-fallback").otherwise(F.col("retrieval_method")))
        again = lambda refined: self.retrieve(keep(refined.join(routed.select("qid", "namespace"), "qid"), "refined-questions"), pinned, top_k, hyde, hybrid)
        done = A.refine(keep(answered, "answered"), again, self.config, self.provider, keep)
        return keep(done.join(routed.select("qid", "namespace"), "qid"), "single")

    def query_batch(self, questions: DataFrame, collection: str, top_k: int | None = None, routing: str = "llm", use_hyde: bool = True, use_hybrid: bool = True, now=None) -> DataFrame:
        """qid, answer, sources, retrieval_method, web_fallback, namespace, complexity, cache_hit and cache_similarity of questions (qid, text).

        A question near a live entry of the collection's cache gets that entry's answer. Of the others, complex ones are
        answered in parts, and all answers go to the cache. Null and empty questions find nothing. The namespace is the one
        that was read. Several batches can run at once.
        """
        steps, pinned = self._steps(), self.pin(collection)
        now = F.current_timestamp() if now is None else now
        asked = steps.keep(questions.select("qid", F.coalesce("text", F.lit("")).alias("text")), "questions")
        vectors = steps.keep(embed(asked, "qid", self.config.embed_dims), "question-vectors")
        hits = steps.keep(self.cache_get(vectors, collection, now), "cache-hits")
        missed = steps.keep(asked.join(hits.select("qid"), "qid", "left_anti"), "missed")
        parts = steps.keep(A.fan_out(missed, self.provider), "parts")
        single = self._single(steps, parts.select(F.col("sub").alias("qid"), "text"), pinned, top_k or self.config.top_k, routing, use_hyde, use_hybrid)
        both = parts.join(single.drop("question").withColumnRenamed("qid", "sub"), "sub").withColumnRenamed("text", "question")
        made = steps.keep(A.synthesize(both, self.provider), "made")
        self.cache_set(made.join(missed, "qid").join(vectors, "qid"), collection, now)
        out = made.withColumns({"cache_hit": F.lit(False), "cache_similarity": F.lit(None).cast("double")})
        out = retrieval.union(out, hits)
        path = f"{self.folder}/answers/{steps.run}"
        out.write.parquet(path)
        steps.forget()
        return self.spark.read.schema(out.schema).parquet(path)

    def query(self, question: str, collection: str, top_k: int | None = None, **switches) -> dict:
        """One question: at least three characters, top_k from 1 to 20."""
        self._valid(question, top_k)
        return self.query_batch(self.spark.createDataFrame([(0, question)], "qid long, text string"), collection, top_k, **switches).first().asDict(recursive=True)

    def _valid(self, question: str, top_k: int | None) -> None:
        if len(question) < 3 or not 1 <= (self.config.top_k if top_k is None else top_k) <= 20:
            raise ValueError("a question has three characters or more, and top_k is from 1 to 20")

    def query_stream(self, question: str, collection: str, top_k: int | None = None, routing: str = "llm") -> Iterator[str]:
        """Server-sent events of an answer: routed, retrieved and ranked, without cache, grading, graph and refinement."""
        self._valid(question, top_k)
        steps, pinned = self._steps(), self.pin(collection)
        one = self.spark.createDataFrame([(0, question)], "qid long, text string")
        routed = steps.keep(one.join(self.route(one, routing), "qid"), "routed")
        hits = A.rerank(self.retrieve(routed, pinned, top_k), one, self.config)
        text = A.generate(hits, one, None, self.config, self.provider).first()["answer"]
        steps.forget()
        yield from server_sent_events(self.provider.stream(text))

    # --- cache: each batch adds a folder, and of one entry the latest counts

    def _caches(self, collection: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/cache/{quote(collection, safe='')}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self, collection: str) -> list[str]:
        """Folders of batches that were written to their end."""
        p, files = self._caches(collection)
        found = [f.getPath().toString() for f in files.listStatus(p)] if files.exists(p) else []
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(f for f in found if files.exists(done(f"{f}/_SUCCESS")))

    def _cache(self, collection: str) -> DataFrame:
        found = self._batches(collection)
        if not found:
            return self.spark.createDataFrame([], CACHE)
        return knowledge.newest(self.spark.read.schema(CACHE).parquet(*found))

    def cache_get(self, vectors: DataFrame, collection: str, now) -> DataFrame:
        """The answers of the best live entries for questions (qid, embedding), at or above the threshold."""
        entries = self._cache(collection)
        one = F.lit("").alias("collection")
        best = knowledge.cache_lookup(vectors.select("qid", F.col("embedding").alias("q"), one), entries.select("*", one), now, self.config)
        rows = best.join(entries, "entry")
        return rows.select("qid", "answer", "sources", "retrieval_method", "web_fallback", "namespace", "complexity", F.lit(True).alias("cache_hit"), F.col("similarity").alias("cache_similarity"))

    def cache_set(self, rows: DataFrame, collection: str, now) -> None:
        """Add answers (with text and embedding) for the time-to-live; of equal questions the last one to expire counts."""
        expires = (now + F.expr(f"INTERVAL {self.config.cache_ttl_seconds} SECONDS")).cast("timestamp")
        new = rows.select(F.xxhash64("text").alias("entry"), F.col("text").alias("question"), "embedding", "answer", "sources", "retrieval_method", "web_fallback", "namespace", "complexity", expires.alias("expires_at"))
        self._add_batch(new, collection)

    def _add_batch(self, rows: DataFrame, collection: str) -> None:
        p, _ = self._caches(collection)
        rows.write.parquet(f"{p.toString()}/{uuid.uuid4().hex}")

    def cache_evict(self, collection: str, now=None) -> None:
        """Put all live entries into one batch and drop those before it, expired entries with them."""
        now = F.current_timestamp() if now is None else now
        before = self._batches(collection)
        if before:
            self._add_batch(self._cache(collection).where(F.col("expires_at") > now), collection)
        _, files = self._caches(collection)
        for f in before:  # batches added meanwhile stay
            files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f), True)

    def cache_stats(self, collection: str, now=None) -> dict:
        now = F.current_timestamp() if now is None else now
        return {"size": self._cache(collection).where(F.col("expires_at") > now).count(), "threshold": self.config.cache_similarity, "ttl_seconds": self.config.cache_ttl_seconds}

    def cache_clear(self, collection: str) -> None:
        p, files = self._caches(collection)
        files.delete(p, True)

    # --- grading

    def evaluate(self, rows: DataFrame) -> DataFrame:
        """Four scores of rows (qid, question, answer, contexts, ground_truth)."""
        return knowledge.evaluate(rows, self.provider)

    @staticmethod
    def health() -> dict:
        return {"status": "ok", "version": VERSION}

"""Versions of collections: what an ingest that fails, runs, adds or finds nothing does, and what others see meanwhile."""

import threading

import pytest
from pyspark.sql import functions as F

from lodestone.engine import Engine, IngestRunning, NothingToIngest

PAGE = "<p>Page {0} tells of topic{0} now. It is long. It ends.</p>"


def some_pages(spark, *numbers):
    return spark.createDataFrame([(f"https://h/{i}", PAGE.format(i)) for i in numbers], "url string, html string")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")))
    e.ingest(some_pages(spark, 0, 1, 2), "c")
    return e


def urls(engine, collection, version=None):
    return sorted(r["url"] for r in engine.pin(collection, version).table("pages").select("url").collect())


def test_an_unknown_or_empty_collection_answers_without_sources(spark, engine):
    r = engine.query("What is topic1 about?", "nobody knows it")
    assert r["sources"] == [] and r["web_fallback"] and not r["cache_hit"] and r["namespace"] == "leaf"
    assert engine.summary("nobody").first().asDict() == dict.fromkeys(("pages", "parents", "leaves", "propositions", "relations", "tree_levels", "tree_nodes"), 0)
    assert engine.graph_context(spark.createDataFrame([(1, "topic1")], "qid long, text string"), "nobody").count() == 0


@pytest.mark.parametrize("html", [["<p> </p>", None, ""], ["<p>Hi there.</p>"], []])
def test_blank_and_tiny_pages(spark, engine, html):
    pages = spark.createDataFrame([(f"https://t/{i}", h) for i, h in enumerate(html)], "url string, html string")
    n = engine.ingest(pages, "tiny").first()
    assert (n["pages"], n["relations"], n["tree_nodes"]) == (int("Hi" in str(html)), 0, 0) and engine.ingest_status("tiny") == "done"
    engine.cache_clear("tiny")
    assert len(engine.query("Hi there you", "tiny", use_hyde=False)["sources"]) == n["pages"]


def test_a_failed_ingest_leaves_the_collection_as_it_was(spark, engine):
    engine.ingest(some_pages(spark, 0, 1), "kept")
    bad = some_pages(spark, 7).withColumn("html", F.expr("raise_error('broken page')").cast("string"))
    with pytest.raises(Exception, match="broken page"):
        engine.ingest(bad, "kept")
    assert engine.ingest_status("kept") == "error" and urls(engine, "kept") == ["https://h/0", "https://h/1"]
    assert engine.query("Page 1 tells topic1", "kept", use_hyde=False)["sources"]
    engine.ingest(some_pages(spark, 2), "kept")
    assert engine.ingest_status("kept") == "done" and urls(engine, "kept") == ["https://h/2"]


def test_a_second_ingest_is_refused_while_one_runs(spark, engine):
    log = engine._log("busy")
    engine._enter(log, "busy")
    assert engine.ingest_status("busy") == "running"
    with pytest.raises(IngestRunning):
        engine.ingest(some_pages(spark, 1), "busy")
    with pytest.raises(IngestRunning):
        engine.vacuum("busy")
    assert engine.ingest_status("busy") == "running"
    log.delete("running.json")
    log.create("running.json", '{"at": 0}')  # one that never ended
    engine.ingest(some_pages(spark, 1), "busy")
    assert engine.ingest_status("busy") == "done"


def test_readers_keep_their_version(spark, engine):
    engine.ingest(some_pages(spark, 0, 1), "moving")
    pinned = engine.pin("moving")
    engine.ingest(some_pages(spark, 5), "moving")
    assert pinned.table("pages").count() == 2 and engine.pin("moving").table("pages").count() == 1
    asked = spark.createDataFrame([(1, "Page 0 tells topic0", "leaf")], "qid long, text string, namespace string")
    assert {r["url"] for r in engine.retrieve(asked, pinned).collect()} == {"https://h/0", "https://h/1"}
    engine.ingest(some_pages(spark, 6), "moving")
    engine.vacuum("moving", 1)
    assert urls(engine, "moving") == ["https://h/6"]
    with pytest.raises(Exception):
        pinned.table("pages").count()


def test_pages_are_added_and_replaced_by_url(spark, engine):
    engine.ingest(some_pages(spark, 0, 1, 2), "grows")
    new = spark.createDataFrame([("https://h/1", "<p>Quite another text now. Nothing else stands here.</p>"), ("https://h/9", PAGE.format(9))], "url string, html string")
    n = engine.ingest(new, "grows", replace=False).first().asDict()
    e = Engine(spark, engine.folder)
    whole = some_pages(spark, 0, 2, 9).unionByName(new.where("url LIKE '%/1'"))
    assert n == e.ingest(whole, "grows-whole").first().asDict() == engine.ingest(new, "grows", replace=False).first().asDict()
    for name in ("pages", "leaves", "relations", "propositions", "postings", "terms", "tree"):
        rows = lambda c, name=name: sorted(map(str, e.pin(c).table(name).select([x for x in e.pin(c).table(name).columns if x != "idf"]).collect()))
        assert rows("grows") == rows("grows-whole"), name


def test_two_batches_at_once_and_a_cache_that_is_added_to(spark, engine):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    engine.cache_clear("c")
    out, asked = {}, {k: spark.createDataFrame([(k, f"Page {k} tells of topic{k} now.")], "qid long, text string") for k in (0, 1)}
    threads = [threading.Thread(target=lambda k=k: out.update({k: engine.query_batch(asked[k], "c", now=now, use_hyde=False).collect()})) for k in asked]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {k: [(r["qid"], r["cache_hit"]) for r in v] for k, v in out.items()} == {0: [(0, False)], 1: [(1, False)]}
    assert engine.cache_stats("c", now)["size"] == 2 and len(engine._batches("c")) == 2
    engine.cache_evict("c", now)
    assert engine.cache_stats("c", now)["size"] == 2 and len(engine._batches("c")) == 1


def test_the_answer_names_the_namespace_that_was_read(spark, engine):
    pages = spark.createDataFrame([("https://one/1", "<p>Only one short page about widgets.</p>")], "url string, html string")
    engine.ingest(pages, "one")
    assert "raptor-l2" not in engine.pin("one").namespaces
    asked = spark.createDataFrame([(1, "What is the overview and architecture of widgets?")], "qid long, text string")
    routed = engine.route(asked, "semantic").first()["namespace"]
    r = engine.query_batch(asked, "one", routing="semantic").first()
    assert routed == "raptor-l2" and r["namespace"] == "leaf"


def test_ingest_from_a_start_url(spark, engine):
    site = [
        ("https://s/robots.txt", 200, "Sitemap: https://s/map.xml"),
        ("https://s/map.xml", 200, "<urlset><url><loc>https://s/docs/a/</loc></url><url><loc>https://s/docs/b</loc></url><url><loc>https://s/blog/c</loc></url></urlset>"),
        ("https://s/docs/a", 200, PAGE.format(1)),
        ("https://s/docs/b", 404, PAGE.format(2)),
        ("https://s/blog/c", 200, PAGE.format(3)),
        ("https://l/docs", 200, '<p>Start here now. It is long.</p><a href="/docs/x#top">x</a><a href="https://else/docs/y">y</a>'),
        ("https://l/docs/x", 200, PAGE.format(4)),
    ]
    fetched = spark.createDataFrame(site, "source string, status int, body string")
    assert engine.ingest_site("https://s/docs", fetched, "site").first()["pages"] == 1
    assert [u.rstrip("/") for u in urls(engine, "site")] == ["https://s/docs/a"]
    engine.ingest_site("https://l/docs", fetched, "site", replace=False)
    assert [u.rstrip("/") for u in urls(engine, "site")] == ["https://l/docs", "https://l/docs/x", "https://s/docs/a"]
    with pytest.raises(NothingToIngest):
        engine.ingest_site("https://s/nowhere", fetched, "site")
    assert engine.ingest_status("site") == "error" and len(urls(engine, "site")) == 3

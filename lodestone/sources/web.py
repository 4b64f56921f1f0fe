"""Pages to fetch: sitemaps, discovery, link crawling over a table of links, and the idempotent fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import has_asset_suffix, hrefs, is_page, normal_url, origin, slug, url_path
from lodestone.sources.tables import cut


def sitemap_locations(xml: DataFrame) -> DataFrame:
    """Of sitemap bodies (source, body): source and loc, in order. An index's own entries are told by its root element.

    Bodies are read by patterns, so one that isn't well-formed gives what it has, and no error.
    """
    found = F.regexp_extract_all("body", F.lit(r"(?is)<(?:\w+:)?loc\s*>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</(?:\w+:)?loc\s*>"), 1)
    loc = F.posexplode(F.transform(found, lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))).alias("ord", "loc")
    return xml.select("source", F.col("body").rlike(r"(?is)<(?:\w+:)?sitemapindex\b").alias("is_index"), loc)


def resolve_sitemaps(bodies: DataFrame, roots: DataFrame) -> DataFrame:
    """Locations of all pages under ``roots`` (source): indexes are followed to any depth, each file once.

    Each round is checkpointed, so plans don't grow with the depth.
    """
    locations = sitemap_locations(bodies)
    seen = front = roots.select("source").distinct()
    pages = locations.select("loc").limit(0)
    while True:
        here = cut(locations.join(front, "source", "left_semi"))
        pages = pages.unionByName(here.where(~F.col("is_index")).select("loc"))
        front = cut(here.where("is_index").select(F.col("loc").alias("source")).distinct().join(seen, "source", "left_anti"))
        if front.isEmpty():
            return pages.distinct()
        seen = seen.unionByName(front)


def discover(urls: DataFrame, base: str, scope: str | None = None) -> DataFrame:
    """Of urls (ord, url): pages of the same origin under a path, each once by its URL without trailing slashes, the first form kept."""
    url = F.col("url")
    kept = urls.where((origin(url) == base) & ~has_asset_suffix(url))
    if scope and scope != "/":
        kept = kept.where(url_path(url).startswith(scope))
    first = Window.partitionBy(normal_url(url)).orderBy("ord")
    return kept.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("url")


def crawl(links: DataFrame, start: str, max_pages: int | None = None) -> DataFrame:
    """Breadth-first over links (src, dst): url and depth of all pages of the start's origin, or the first ``max_pages`` by depth, then URL.

    One join a round from the frontier, until it is empty; visited pages are left out by an anti-join.
    """
    spark = links.sparkSession
    base = spark.range(1).select(origin(F.lit(start))).first()[0]
    links = links.select(normal_url(F.col("src")).alias("src"), normal_url(F.regexp_replace("dst", "#.*$", "")).alias("dst"))
    links = links.where(is_page(F.col("dst"), F.lit(base))).distinct()
    seen = spark.createDataFrame([(start.rstrip("/"), 0)], "url string, depth int")
    front = seen
    d = 0
    while True:
        d += 1
        new = links.join(front.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        front = cut(new.join(seen, "url", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty() or max_pages and seen.count() >= max_pages:
            break
        seen = seen.unionByName(front)
    return seen.orderBy("depth", "url").limit(max_pages) if max_pages else seen.orderBy("depth", "url")


def resolved(base: Column, href: Column) -> Column:
    """A link of the page ``base`` as a whole URL, without fragment; relative ones are taken from the origin."""
    bare = F.regexp_replace(href, "#.*$", "")
    whole = F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), bare)
    return whole.when(bare.startswith("/"), F.concat(origin(base), bare)).otherwise(F.concat(origin(base), F.lit("/"), bare))


def page_links(pages: DataFrame) -> DataFrame:
    """src and dst of all links of pages (url, html)."""
    links = pages.select("url", F.explode(hrefs(F.col("html"))).alias("href"))
    return links.select(F.col("url").alias("src"), resolved(F.col("url"), F.col("href")).alias("dst"))


def pending(urls: DataFrame, fetched: DataFrame) -> DataFrame:
    """Of urls (url), those whose normal form isn't among ``fetched`` (url)."""
    key = normal_url(F.col("url")).alias("key")
    return urls.withColumn("key", normal_url(F.col("url"))).join(fetched.select(key).distinct(), "key", "left_anti").drop("key")


#: Where sitemaps are looked for if robots.txt names none, in this order.
SITEMAPS = ("/sitemap.xml", "/sitemap-0.xml", "/sitemap_index.xml")


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """Of robots files (origin, body): origin, priority (the line) and url of each sitemap that they name, in any case."""
    lines = robots.select("origin", F.posexplode(F.split("body", r"\r?\n")).alias("priority", "line"))
    return lines.where(F.lower("line").startswith("sitemap:")).select("origin", "priority", F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("url"))


def first_sitemap(robots: DataFrame, fetched: DataFrame) -> DataFrame:
    """origin and source of the sitemap to use of each origin in ``robots`` (origin, body).

    fetched (source, status, body): what is there. Sitemaps that robots.txt names come before the fixed places; the first with
    status 200 that holds entries of pages or of an index is taken. An origin without one has no row.
    """
    fixed = robots.select("origin", F.posexplode(F.array(*(F.lit(p) for p in SITEMAPS))).alias("k", "path"))
    fixed = fixed.select("origin", (F.col("k") + 1_000_000).alias("priority"), F.concat("origin", "path").alias("url"))
    good = fetched.where((F.col("status") == 200) & (F.contains("body", F.lit("<url")) | F.contains("body", F.lit("<sitemap"))))
    found = robots_sitemaps(robots).unionByName(fixed).join(good.select(F.col("source").alias("url")).distinct(), "url", "left_semi")
    return found.groupBy("origin").agg(F.min_by("url", "priority").alias("source"))


def discover_site(start: str, robots: DataFrame, fetched: DataFrame, links: DataFrame, max_pages: int | None = None) -> DataFrame:
    """The pages of a site under the path of ``start``, by its sitemap; by a crawl over ``links`` only if it has none.

    An empty sitemap gives no pages and no crawl, as a site says so.
    """
    spark = fetched.sparkSession
    base, path = spark.range(1).select(origin(F.lit(start)), url_path(F.lit(start))).first()
    root = cut(first_sitemap(robots.where(F.col("origin") == base), fetched))
    if root.isEmpty():
        urls = crawl(links, start, max_pages).select("url")
    else:
        urls = resolve_sitemaps(fetched.select("source", "body"), root.select("source")).select(F.col("loc").alias("url"))
    return discover(urls.select(F.col("url").alias("ord"), "url"), base, path or None).orderBy("url")

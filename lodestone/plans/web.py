"""Queries over pages: URLs, discovery, fetching, cleaning, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import clean_html, hrefs, is_page, normal_url, origin, slug, url_path
from lodestone.registry import query
from lodestone.sources.tables import load
from lodestone.sources.web import discover, page_links, pending

ORIGIN = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
ASSET = rf"lower(regexp_extract({PATH}, '\.([A-Za-z0-9]+)$', 1)) IN ('png','jpg','jpeg','gif','svg','webp','mp4','pdf','zip')"
SLUG = rf"coalesce(nullif(replace(trim({PATH}, '/'), '/', '--'), ''), 'index')"
BASE = f"(SELECT {ORIGIN} FROM pages ORDER BY page_id LIMIT 1)"


def base_origin(pages: DataFrame) -> str:
    """The site to look at: the origin of the first page."""
    return pages.orderBy("page_id").select(origin(F.col("url"))).first()[0]


@query(f"SELECT page_id, {ORIGIN} AS origin, {PATH} AS path, {SLUG} AS slug FROM pages")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return load(spark, sf, "pages").select("page_id", origin(url).alias("origin"), url_path(url).alias("path"), slug(url).alias("slug"))


@query(f"SELECT page_id, ({ORIGIN} = {BASE} OR {ORIGIN} = '') AND NOT {ASSET} AS is_page FROM pages")
def url_is_page(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages")
    return pages.select("page_id", is_page(F.col("url"), F.lit(base_origin(pages))).alias("is_page"))


@query(f"SELECT {SLUG} AS slug, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1 HAVING count(*) > 1")
def url_slug_collisions(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "pages").groupBy(slug(F.col("url")).alias("slug")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))
    return n.where("n > 1")


@query(f"""SELECT url FROM (SELECT url, row_number() OVER (PARTITION BY rtrim(url, '/') ORDER BY page_id) AS k FROM pages
WHERE {ORIGIN} = {BASE} AND NOT {ASSET} AND starts_with({PATH}, '/')) WHERE k = 1""")
def url_discover(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages")
    return discover(pages.select(F.col("page_id").alias("ord"), "url"), base_origin(pages), "/").orderBy("url")


@query("SELECT page_id, url FROM pages WHERE url LIKE 'https:%' AND rtrim(replace(url, 'https://', 'http://'), '/') NOT IN (SELECT rtrim(url, '/') FROM pages WHERE url LIKE 'http:%')")
def fetch_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Secure pages that weren't fetched in the clear already: an anti-join on the normal URL."""
    pages = load(spark, sf, "pages")
    fetched = pages.where(F.col("url").startswith("http:")).select("url")
    want = pages.where(F.col("url").startswith("https:")).select("page_id", F.col("url").alias("own"), F.replace(F.col("url"), F.lit("https://"), F.lit("http://")).alias("url"))
    return pending(want, fetched).select("page_id", F.col("own").alias("url"))


_STRIP = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _tag in ("script", "style", "nav", "footer", "header", "aside", "noscript"):
    _STRIP = rf"regexp_replace({_STRIP}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}\s*>', '', 'g')"
_PLAIN = f"replace(replace(replace(replace(regexp_replace({_STRIP}, '<[^>]*>', chr(10), 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


def _collapse(text: str) -> str:
    trimmed = rf"regexp_replace({text}, '[ \t\r\f]+(\n|$)', '\1', 'g')"
    return rf"regexp_replace(regexp_replace({trimmed}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')"


@query(f"SELECT page_id, {_collapse(_PLAIN)} AS text FROM pages")
def html_clean(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", clean_html(F.col("html")).alias("text"))


@query(r"""SELECT page_id, CAST(i - 1 AS INTEGER) AS ord, regexp_replace(l[i], '#.*$', '') AS href FROM (
SELECT page_id, regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1) AS l, unnest(range(1, len(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1)) + 1)) AS i FROM pages)""")
def html_links(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", F.posexplode(hrefs(F.col("html"))).alias("ord", "href"))


@query(rf"""SELECT target, count(*) AS n FROM (
SELECT CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN starts_with(h, '/') THEN {ORIGIN} || h ELSE {ORIGIN} || '/' || h END AS target
FROM (SELECT url, regexp_replace(unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1)), '#.*$', '') AS h FROM pages))
WHERE rtrim(target, '/') NOT IN (SELECT rtrim(url, '/') FROM pages) GROUP BY target""")
def crawl_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """Links of all pages, resolved, that aren't pages yet: the next round of a crawl."""
    pages = load(spark, sf, "pages")
    links = page_links(pages).groupBy(F.col("dst").alias("target")).agg(F.count("*").alias("n"))
    seen = pages.select(normal_url(F.col("url")).alias("key")).distinct()
    return links.withColumn("key", normal_url(F.col("target"))).join(seen, "key", "left_anti").select("target", "n")


@query()
def html_main_text(spark: SparkSession, sf: str) -> DataFrame:
    """The text of each page's main element; a parser has no SQL, so the tests hold it against pages made by hand."""
    from lodestone.sources.html import main_texts

    return main_texts(load(spark, sf, "pages"))

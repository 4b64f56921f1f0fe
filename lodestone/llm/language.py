"""Language ID (operator 6): Bayesian fusion of a text's likelihood with what its page and its host say.

- Text: likelihoods of hashed byte trigrams, letters only, under a profile of each language, counted by a grouped
  aggregation over labelled texts, for every label (its language, so en-US and en-GB are one). What a text can say is limited to ``evidence`` trigrams, since trigrams aren't independent.
- Markup: the declared language, through the probability that pages in a language declare it, estimated by a grouped
  aggregation with a prior that favours the truth.
- Address: the prior of a host is its pages' languages, smoothed towards its address suffix's, and that towards all
  pages'; grouped sums of the posteriors by text and markup, without the page's own.

One more language, ``und``, has a flat profile: what fits no profile at all is of undetermined language. So is a text
without letters, null or empty, unless markup or host settle it. Nulls in declared and host are no evidence. Repeated
rows count and are returned each. Without labelled texts all are ``und``. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import in_arrow, stage
from ._text import LOWER, Slice, ragged, slices

BUCKETS = 1 << 16
#: Languages that a task counts in whole arrays before it gives them out; likelihoods that are expanded at once.
AT_ONCE, EXPANDED = 64, 1 << 20
#: Declarations, the most frequent, that go out to all tasks; the others, the rare ones, are joined.
FREQUENT = 1024
#: Hosts, with two numbers a language each, up to which their sums are broadcast; beyond, they are joined by a shuffle.
HOSTS = 50_000
UND = "und"
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[65:91] = _LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def _trigrams(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the trigrams of a slice that hold a letter in the middle."""
    b = _LETTERS[LOWER[part.data]].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(part.n), np.diff(part.offsets))
    ok = (b[1:-1] != 32) & (owner[:-2] == owner[2:])
    t = ((b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return owner[:-2][ok], t[ok].astype(np.int64)


@dataclass
class Profiles:
    """Languages, ``und`` last, with sparse log probabilities of buckets.

    base: of each language, of a bucket that it doesn't have; gain: what those that it has add to that, by bucket, from
    starts[bucket] on, each with the place of its language.
    """

    languages: list[str]
    base: np.ndarray
    starts: np.ndarray
    language: np.ndarray
    gain: np.ndarray

    def likelihoods(self, part: Slice, evidence: int) -> np.ndarray:
        """Log likelihood of each text under each language, scaled to at most ``evidence`` trigrams."""
        doc, t = _trigrams(part)
        n, k = np.bincount(doc, minlength=part.n), len(self.languages)
        out = n[:, None] * self.base
        size = self.starts[t + 1] - self.starts[t]
        # blocks of whole trigrams, so that what they expand to stays bounded
        cuts = np.searchsorted(np.cumsum(size), np.arange(EXPANDED, size.sum() + EXPANDED, EXPANDED), "right")
        for lo, hi in zip(np.concatenate(([0], cuts)), np.append(cuts, len(t)), strict=True):
            if lo < hi:
                at, first, last = ragged(self.starts[t[lo:hi]], size[lo:hi]), doc[lo], doc[hi - 1] + 1
                cell = np.repeat(doc[lo:hi] - first, size[lo:hi]) * k + self.language[at]
                out[first:last] += np.bincount(cell, weights=self.gain[at], minlength=(last - first) * k).reshape(-1, k)
        return out * (np.minimum(n, evidence) / np.maximum(n, 1))[:, None]


def primary(tag):
    """The language of a tag, lower-cased, without region or script; tags of another form are kept whole. Null for blank ones."""
    letters = F.regexp_extract(tag, r"^\s*([A-Za-z]+)", 1)
    name = F.lower(F.when(letters != "", letters).otherwise(F.trim(tag)))
    return F.when(name != "", name)


def fit_profiles(labelled: DataFrame) -> Profiles:
    """Profiles of all languages of ``labelled`` (text, lang); each's distinct trigrams, at most 65,536 counts, reach the driver."""
    named = labelled.select("text", primary(F.col("lang")).alias("lang")).where("lang IS NOT NULL")
    languages = sorted(r["lang"] for r in named.select("lang").distinct().collect())
    place = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}

        def out() -> Iterator[pa.RecordBatch]:
            for i, n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at + i * BUCKETS), pa.array(n[at])], ["at", "n"])
            total.clear()

        for b in batches:
            of = np.array([place[x] for x in b.column("lang").to_pylist()], np.int64)
            for part in slices(b.column("text")):
                doc, t = _trigrams(part)
                here, own = np.unique(of[part.lo : part.hi], return_inverse=True)
                own = own[doc]
                for lo in range(0, len(here), AT_ONCE):
                    some = slice(None) if len(here) <= AT_ONCE else (own >= lo) & (own < lo + AT_ONCE)
                    group = here[lo : lo + AT_ONCE]
                    n = np.bincount((own[some] - lo) * BUCKETS + t[some], minlength=len(group) * BUCKETS).reshape(-1, BUCKETS)
                    for i, x in zip(group.tolist(), n, strict=True):
                        total[i] = total[i] + x if i in total else x.copy()
                    if len(total) > AT_ONCE:
                        yield from out()
        yield from out()

    at, n = np.zeros(0, np.int64), np.zeros(0)
    if languages:
        got = named.transform(in_arrow, run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        at, n = got["at"].to_numpy(np.int64), got["n"].to_numpy(float)
    order = np.lexsort((at // BUCKETS, at % BUCKETS))
    at, n = at[order], n[order]
    total = np.bincount(at // BUCKETS, weights=n, minlength=len(languages)) + 0.01 * BUCKETS
    base = np.append(np.log(0.01 / total), -np.log(BUCKETS))
    starts = np.concatenate(([0], np.cumsum(np.bincount(at % BUCKETS, minlength=BUCKETS))))
    return Profiles([*languages, UND], base, starts, at // BUCKETS, np.log((n + 0.01) / 0.01))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def identify(rows: DataFrame, profiles: Profiles, evidence: int = 60, trust: float = 20.0, weight: float = 20.0, und_prior: float = 1e-3) -> DataFrame:
    """id, host, suffix, declared, text_lang, lang and confidence of ``rows``: id, text, declared, host.

    ``trust`` and ``weight`` are the pseudo-counts of the prior on declarations and of each level of the host priors.
    """
    names, k = profiles.languages, len(profiles.languages)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(profiles)

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b.column("text")):
                z = shared.value.likelihoods(part, evidence)
                z[:, -1] += np.log(und_prior)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(part.lo, part.n) for c in ("id", "declared", "host")), pa.array(list(z), pa.list_(pa.float64()))], ["id", "declared", "host", "z"])

    declared = primary(F.col("declared"))
    host = F.regexp_replace(F.lower("host"), r":\d*$", "")
    given = rows.select("id", "text", declared.alias("declared"), F.when(host != "", host).alias("host"))
    kind = dict(given.dtypes)["id"]
    seen = stage(given.transform(in_arrow, text, f"id {kind}, declared string, host string, z array<double>"), "text-likelihoods")
    seen = seen.withColumn("suffix", F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)))

    def posterior(z):
        """Probabilities from logarithms, within Spark's expressions."""
        e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))

    # declarations: soft counts of (language by text, declared)
    soft = seen.where("declared IS NOT NULL").withColumn("p", posterior(F.col("z")))
    counts = soft.groupBy("declared").agg(F.count("*").alias("n"), *(F.sum(F.col("p")[i]).alias(f"c{i}") for i in range(k)))
    counts = stage(counts.select("declared", "n", F.array(*(F.col(f"c{i}") for i in range(k))).alias("c")), "declarations")
    kinds, *whole = counts.agg(F.count("*"), *(F.coalesce(F.sum(F.col("c")[i]), F.lit(0.0)) for i in range(k))).first()
    whole = np.array(whole)

    def said(labels: list[str], n: np.ndarray) -> np.ndarray:
        """Of each declaration: the log probability that pages in each language give it."""
        prior = 0.1 / kinds + 0.9 * np.array([[float(d == x) for x in names] for d in labels]).reshape(n.shape)
        prior[:, -1] = 1 / kinds
        return np.log((n + trust * prior) / (whole + trust))

    top = {r["declared"]: r["c"] for r in counts.orderBy(F.desc("n"), "declared").limit(FREQUENT).collect()}
    spoken = dict(zip(top, said(list(top), np.array(list(top.values()))).tolist(), strict=True)) if top else {}
    seen = seen.withColumn("said", F.lit(None).cast("array<double>"))
    if kinds > FREQUENT:

        def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                labels = b.column("declared").to_pylist()
                if labels:
                    n = b.column("c").flatten().to_numpy().reshape(-1, k)
                    yield pa.RecordBatch.from_arrays([b.column("declared"), pa.array(list(said(labels, n)), pa.list_(pa.float64()))], ["declared", "said"])

        is_rare = F.coalesce(~F.col("declared").isin(list(top)), F.lit(False))
        others = counts.where(is_rare).select("declared", "c").transform(in_arrow, rare, "declared string, said array<double>")
        seen = seen.where(~is_rare).unionByName(seen.where(is_rare).drop("said").join(others, "declared", "left"))

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = b.column("z").flatten().to_numpy().reshape(-1, k)
            none = [0.0] * k
            z = z + np.array([x or spoken.get(d, none) for d, x in zip(b.column("declared").to_pylist(), b.column("said").to_pylist(), strict=True)]).reshape(-1, k)
            keep = [c for c in ("id", "declared", "host", "suffix", "z")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(list(z), pa.list_(pa.float64())), pa.array(list(_softmax(z)), pa.list_(pa.float64()))], [*keep, "y", "p"])

    page = seen.select("id", "declared", "host", "suffix", "z", "said").transform(in_arrow, fuse, f"id {kind}, declared string, host string, suffix string, z array<double>, y array<double>, p array<double>")
    page = stage(page, "page-posteriors")
    sums = lambda tag: [F.sum(F.col("p")[i]).alias(f"{tag}{i}") for i in range(k)]
    vector = lambda tag: F.array(*(F.col(f"{tag}{i}") for i in range(k)))
    world = page.agg(*(F.coalesce(x, F.lit(0.0)) for x in sums("w"))).first()
    world = [(x + 1.0) / (sum(world) + k) for x in world]
    hosts = page.where("host IS NOT NULL").groupBy("host", "suffix").agg(F.count("*").alias("nh"), *sums("h"))
    suffixes = hosts.where("suffix IS NOT NULL").groupBy("suffix").agg(F.sum("nh").alias("ns"), *(F.sum(f"h{i}").alias(f"s{i}") for i in range(k)))
    known = hosts.join(suffixes, "suffix", "left").select("host", "nh", vector("h").alias("h"), "ns", vector("s").alias("s"))
    known = stage(known, "hosts")
    known = F.broadcast(known) if known.count() <= HOSTS else known
    # nothing here is null where a host is: a host without a suffix falls to the world's prior. Null hosts aren't dealt out
    with_host = page.where("host IS NOT NULL").join(known, "host", "left").unionByName(page.where("host IS NULL"), allowMissingColumns=True)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(world)
        for b in batches:
            arr = lambda c, b=b: np.array([x if x is not None else [0.0] * k for x in b.column(c).to_pylist()]).reshape(-1, k)
            num = lambda c, b=b: b.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(float)[:, None]
            null = lambda c, b=b: np.array(b.column(c).is_null())[:, None]
            own, p = ~null("host"), arr("p")
            in_suffix = own & ~null("ns")
            s = np.where(in_suffix, arr("s") - p, 0).clip(0)
            ns = np.where(in_suffix, num("ns") - 1, 0)
            by_suffix = (np.where(np.isnan(s), 0, s) + weight * whole) / (ns + weight)
            h = np.where(own, arr("h") - p, 0).clip(0)
            by_host = (h + weight * by_suffix) / (np.where(own, num("nh") - 1, 0) + weight)
            final = _softmax(arr("y") + np.log(by_host))
            best, by_text = final.argmax(1), arr("z").argmax(1)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("host"), b.column("suffix"), b.column("declared"), pa.array([names[i] for i in by_text], pa.string()), pa.array([names[i] for i in best], pa.string()), pa.array(np.round(final.max(1), 6))],
                ["id", "host", "suffix", "declared", "text_lang", "lang", "confidence"],
            )

    cols = with_host.select("id", "host", "suffix", "declared", "z", "y", "p", "nh", "h", "ns", F.when(F.col("ns").isNotNull(), F.col("s")).alias("s"))
    return cols.transform(in_arrow, settle, f"id {kind}, host string, suffix string, declared string, text_lang string, lang string, confidence double")


def page_rows(pages: DataFrame) -> DataFrame:
    """id, text, declared and host of web pages (page_id, url, html): text between tags, without scripts, styles and comments."""
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    return pages.select(
        F.col("page_id").cast("long").alias("id"),
        bare.alias("text"),
        F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("declared"),
        F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1).alias("host"),
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """id, text, declared and host of documents: their language column is the declaration, their source the host."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))

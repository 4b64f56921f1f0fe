"""Toxicity (operator 9): a counterfactual-regularised logistic classifier of whole texts.

Features of a text are the distinct words in it, runs of letters with A-Z lower-cased, and the first 4, 5 and 6 bytes of
longer words; the text alone is read. The classifier is fitted on at most ``max_rows`` labelled rows, those of least
hash. Features are counted by a grouped aggregation over these; the ``max_features`` with the greatest likelihood ratio
between the classes are kept, so what reaches the driver is bounded at any size of input.

Counterfactuals: where a labelled text mentions an identity term, each other term of its group is swapped in for it, and
the square of the change in score is penalised with weight ``swap_penalty``. What the classifier would learn from group
mentions alone thereby cancels, and neutral mentions aren't taken for toxic.

Null and empty texts have no features: their score is the intercept's. Labels that are null take no part. Without labels
of both classes every score is the smoothed rate of the labels there are (0.5 without any). Repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import in_arrow, stage
from ._text import LOWER, U64, Slice, mix, slices

#: Identity terms by group; a term is swapped for others of its own group and language.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "queer"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "autistic"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("cristianos", "musulmanes", "judíos", "hindúes"),
)
PREFIXES = (4, 5, 6)
_INSIDE = np.zeros(256, bool)
_INSIDE[97:123] = _INSIDE[128:] = True


def features(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of a slice; a feature may come more than once."""
    part = Slice(part.lo, part.hi, LOWER[part.data], part.offsets)
    starts, ends = part.runs(_INSIDE[part.data])
    sums, doc = part.sums(), part.owner(starts)
    docs, out = [doc], [part.hashes(starts, ends, sums)]
    for k in PREFIXES:
        long = ends - starts > k
        docs.append(doc[long])
        out.append(mix(part.hashes(starts[long], starts[long] + k, sums) ^ U64(k)))
    return np.concatenate(docs), np.concatenate(out).view(np.int64)


def _of_words(words: list[str]) -> list[np.ndarray]:
    """Features of each of some words."""
    out: list[np.ndarray] = []
    for part in slices(pa.array(words)):
        doc, f = features(part)
        out += [f[doc == i] for i in range(part.n)]
    return out


@dataclass
class Model:
    """Hashes of features, ascending, their weights, and the intercept."""

    names: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, part: Slice) -> np.ndarray:
        z = np.full(part.n, self.intercept)
        if len(self.names):
            doc, f = features(part)
            at = np.minimum(np.searchsorted(self.names, f), len(self.names) - 1)
            hit = self.names[at] == f
            each = np.unique(doc[hit] * len(self.names) + at[hit])
            z += np.bincount(each // len(self.names), weights=self.weights[each % len(self.names)], minlength=part.n)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _feature_rows(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b.column("text")):
                doc, f = features(part)
                order = np.lexsort((f, doc))
                doc, f = doc[order], f[order]
                new = np.ones(len(f), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (f[1:] != f[:-1])
                ends = np.cumsum(np.bincount(doc[new], minlength=part.n))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(f[new]))
                yield pa.RecordBatch.from_arrays([b.column("label").slice(part.lo, part.n), lists], ["label", "features"])

    return sample.select("label", "text").transform(in_arrow, run, "label int, features array<long>")


def _swaps(mentions: dict[int, int], names: np.ndarray) -> np.ndarray:
    """Changes of the kept features, a row for each swap of an identity term that ``mentions`` (term, texts) has: (swaps, features)."""
    place = {int(x): i for i, x in enumerate(names)}
    terms = [t for group in IDENTITY for t in group]
    own = dict(zip(terms, _of_words(terms), strict=True))
    vector = {}
    for t in terms:
        vector[t] = np.zeros(len(names))
        vector[t][[place[int(x)] for x in own[t] if int(x) in place]] = 1
    counts = {(t, other): n for group in IDENTITY for t in group if (n := mentions.get(int(own[t][0]))) for other in group if other != t}
    changes = [np.sqrt(n) * (vector[a] - vector[b]) for (a, b), n in counts.items() if (vector[a] != vector[b]).any()]
    return np.array(changes).reshape(-1, len(names))


def _descend(row: np.ndarray, col: np.ndarray, y: np.ndarray, n_features: int, changes: np.ndarray, ridge: float, swap_penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of the least penalised loss, by gradient steps with moments."""
    w = np.zeros(n_features + 1)
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(row, weights=w[col], minlength=len(y))
        r = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / len(y)
        g = np.append(np.bincount(col, weights=r[row], minlength=n_features), r.sum())
        g[:-1] += ridge * w[:-1]
        if len(changes):
            g[:-1] += 2 * swap_penalty / len(y) * (changes.T @ (changes @ w[:-1]))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_features: int = 4096, least_ratio: float = 11.0, ridge: float = 1e-5, swap_penalty: float = 1.0) -> Model:
    """A model of ``docs`` (doc_id, text) by ``labels`` (doc_id, label: 0 or 1). doc_id only picks the sample and joins.

    The sample is drawn from the labels alone, so no text is sorted or moved for it; its at most ``max_rows`` rows are
    broadcast to the documents.
    """
    rows = labels.where("label IN (0, 1)").select(F.col("doc_id").cast("long"), F.col("label").cast("int").alias("label"))
    sample = stage(rows.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "label").limit(max_rows), "labelled-sample")
    sample = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")
    sample = stage(_feature_rows(sample), "labelled-features")
    n, pos = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < pos < n:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((pos + 0.5) / (n - pos + 0.5))))
    counts = sample.select("label", F.explode("features").alias("f")).groupBy("f").agg(F.sum("label").cast("double").alias("a"), F.count("*").cast("double").alias("c"))
    part = lambda k, e: F.when(F.expr(k) > 0, F.expr(f"({k}) * ln(({k}) / ({e}))")).otherwise(0.0)
    ratio = 2 * (part("a", f"c * {pos / n}") + part("c - a", f"c * {1 - pos / n}"))
    kept = counts.withColumn("ratio", ratio).where(F.col("ratio") >= least_ratio).orderBy(F.desc("ratio"), "f").limit(max_features)
    names = np.sort(np.array([r["f"] for r in kept.select("f").collect()], np.int64))
    terms = np.unique(np.concatenate([x[:1] for x in _of_words([t for g in IDENTITY for t in g])]))
    wanted = np.union1d(names, terms)

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.intersect1d(np.array(x, np.int64), wanted) for x in b.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(lists, pa.list_(pa.int64()))], ["label", "features"])

    got = sample.transform(in_arrow, only, "label int, features array<long>").toArrow()  # at most max_rows, of wanted features alone
    lists = got.column("features").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    mentions = dict(zip(*(x.tolist() for x in np.unique(flat[np.isin(flat, terms)], return_counts=True)), strict=True))
    kept = np.isin(flat, names)
    row, col = owner[kept], np.searchsorted(names, flat[kept])
    weights, intercept = _descend(row, col, got.column("label").to_numpy().astype(float), len(names), _swaps(mentions, names), ridge, swap_penalty)
    return Model(names, weights, intercept)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b.column("text")):
                s = model.scores(part)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(part.lo, part.n), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(in_arrow, run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text scores below ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b.column("text")):
                yield b.slice(part.lo, part.n).filter(pa.array(model.scores(part) < threshold))

    return docs.transform(in_arrow, run, docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels to learn from: those of rows whose crc32(doc_id as text) mod 4 isn't 2."""
    return labels.select(F.col("doc_id").cast("long"), F.col("toxic").alias("label")).where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)

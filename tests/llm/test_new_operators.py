"""Whitening, phrases and fingerprints against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import phrases as P
from lodestone.llm import fingerprints as FP
from lodestone.llm import queries as Q
from lodestone.llm.phrases import collocations, frequent_ngrams
from lodestone.llm.whitening import Fit, integers, whiten

from .test_brute import FOLDER, TABLES
from .test_texts import LOWER, frame

# --- whitening

VECTORS = "vec_id long, embedding array<float>, n long, x string, component int, w double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x", 3, 0.5) for i, v in rows], VECTORS)


def brute_whitening(x, k):
    n, s = len(x), x.sum(0)
    deviation = [sum(int(v) ** 2 for v in row) for row in n * x.astype(object) - s.astype(object)]
    y = x - s / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return n, deviation, (y @ u[:, :k]) / np.sqrt(e[:k]), e[:k] / e.sum()


def hold(rows, x, ids, k):
    n, deviation, whitened, explained = brute_whitening(x, k)
    assert len(rows) == n * k
    got = {(r["vec_id"], r["component"]): r for r in rows}
    mine = np.array([[got[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    assert np.abs(whitened - mine * np.sign((whitened * mine).sum(0))).max() < 1e-8
    for at, i in enumerate(ids):
        for c in range(k):
            r = got[i, c + 1]
            assert r["n"] == n and r["deviation"] == min(deviation[at], 2**63 - 1)
            assert r["explained"] == pytest.approx(explained[c], rel=1e-9)
            assert 0 <= r["identity_error"] < 1e-9


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * 0.2
    rows = [(i, [float(c) for c in v.astype(np.float32)]) for i, v in enumerate(base)]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [])]
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in rows])
    out = whiten(integers(vectors(spark, rows + bad)), 8).collect()
    hold(out, x, [i for i, _ in rows], 6)
    assert out[0].__fields__ == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_far_numbers_several_lengths_and_little_variance(spark):
    rng = np.random.default_rng(6)
    wide = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(40, 3)).astype(np.float32) * np.float32(1e12))]
    flat = [(100 + i, [float(i % 2), 1.0]) for i in range(10)]
    out = whiten(integers(vectors(spark, wide + flat)), 8).collect()
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in wide], object)
    far = [r for r in out if r["vec_id"] < 100]
    assert {r["deviation"] for r in far} == {2**63 - 1} and len(far) == 120 and {r["n"] for r in far} == {40}
    _, _, whitened, _ = brute_whitening(x.astype(float), 3)
    mine = np.array([[r["whitened"] for r in sorted((r for r in far if r["vec_id"] == i), key=lambda r: r["component"])] for i in range(40)])
    assert np.abs(whitened - mine * np.sign((whitened * mine).sum(0))).max() < 1e-6
    near = {(r["vec_id"], r["component"]): r for r in out if r["vec_id"] >= 100}
    assert len(near) == 20 and near[100, 2]["whitened"] is None and abs(near[100, 1]["whitened"]) == pytest.approx(1)
    assert near[101, 1]["explained"] == pytest.approx(1) and near[101, 1]["identity_error"] < 1e-9
    one = whiten(integers(vectors(spark, [(None, [0.5, 0.25])])), 8).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(None, c, 1, 0, None, None, None) for c in (1, 2)]
    assert whiten(integers(vectors(spark, [])), 8).collect() == []


def test_whitening_takes_several_aggregations_alike(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = integers(vectors(spark, [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(50, 5)))]))
    one = Fit(rows, 5).covariance
    monkeypatch.setattr("lodestone.llm.whitening.MOST", 4)
    assert (Fit(rows, 5).covariance == one).all()


@TABLES
def test_whitening_query(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in r["embedding"]] for r in table])
    hold(Q.queries()["op11_whitening"](spark, FOLDER).collect(), x, [r["vec_id"] for r in table], 8)


# --- phrases


def brute_phrases(rows, least, top=2000, longest=5, share=100):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {(g, p): c for (g, p), c in f.items() if len(p) > 1 and c >= least}
    inside = set()
    for (g, p), c in found.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p) and 100 * c >= share * f[g, p[i:j]]:
                    inside.add((g, p[i:j]))
    out = {}
    for (g, p), a in found.items():
        if (g, p) not in inside:
            cuts = [(1000 * a * n[g] // (f[g, p[:k]] * f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            out.setdefault(g, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((g, i + 1, p.decode(), -a, left, right, n[g], -s) for g, v in out.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:top]))


def found_phrases(docs, *args):
    return sorted(tuple(r) for r in collocations(docs, *args).collect())


LANGS = "doc_id long, text string, lang string, phrase string, key long, n long, block int, size int, source string"


def lang_frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "p", 1, 2, 3, 4, "s") for i, (g, t) in enumerate(rows)], LANGS)


def test_phrases_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = ["The", "old", "clock", "Straße", "é", "x-ray", "\xa0", "in", "of", "tower", "NINE", "b\x0c", "c\td", "e  f"]
    texts = []
    for _ in range(300):
        texts.append((rng.choice(["en", "de", None, "und", ""]), " ".join(rng.choices(vocabulary, [9, 8, 7, 3, 2, 2, 1, 6, 6, 2, 1, 1, 1, 1], k=rng.randint(0, 60))) + rng.choice([".", "! the old clock tower in,", "\n\n", " "])))
    texts += [("en", None), (None, ""), ("fr", "one two"), ("de", "The old clock tower. " * 3000), ("de", "The old clock tower. " * 3000)]
    rows = lang_frame(spark, texts).repartition(5)
    for least in (2, 5, 40, 300):
        assert found_phrases(rows, least, 5, 2000) == brute_phrases(texts, least)
    assert found_phrases(rows, 5, 4, 7, 60) == brute_phrases(texts, 5, 7, 4, 60)
    monkeypatch.setattr(P, "HELD", 20)  # a task gives its rows out many times
    assert found_phrases(rows, 5, 5, 2000) == brute_phrases(texts, 5)


def test_phrases_of_nothing(spark):
    assert found_phrases(lang_frame(spark, [])) == []
    assert found_phrases(lang_frame(spark, [("en", None), (None, " .\n")]), 1) == []
    assert found_phrases(lang_frame(spark, [("en", "word " * 99)])) == []


def test_few_ngrams_are_counted(spark):
    """Buckets and Apriori leave out almost all pairs of rare words."""
    rng = random.Random(4)
    texts = [("en", " ".join(rng.choices([f"w{i}" for i in range(4000)], k=200)) + " new york city") for _ in range(120)]
    got = {r["phrase"]: r["n"] for r in frequent_ngrams(lang_frame(spark, texts), 100, 3).where("size > 1").collect()}
    assert got == {"new york": 120, "york city": 120, "new york city": 120}


@TABLES
def test_phrases_query(spark):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in Q.queries()["op12_phrases"](spark, FOLDER).collect()) == brute_phrases(rows, 100)


# --- fingerprints

M64 = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(*values):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v if isinstance(v, bytes) else (v & M64).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


def xx_int(*values):
    """Spark hashes an int by its four bytes."""
    seed = 42
    for v, size in values:
        seed = xxhash.xxh64_intdigest((v & (1 << 8 * size) - 1).to_bytes(size, "little"), seed)
    return signed(seed)


def brute_fingerprint(text):
    h = [xx(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))]
    each = [xx(*h[i : i + 5]) for i in range(len(h) - 4)] if len(h) >= 5 else [xx(*h)]
    bins = [None] * 256
    for v in each:
        b = (v >> 56) + 128
        bins[b] = v if bins[b] is None else min(v, bins[b])
    out = []
    for i, v in enumerate(bins):
        if v is None:
            donor = next((d for t in range(1, 17) if (d := bins[xx_int((i, 4), (t, 4)) & 255]) is not None), None)
            if donor is not None:
                v = xx_int((donor, 8), (i, 4))
            else:
                v = min((xx_int((i, 4), (j, 4)) & ~15) | (xx_int((d, 8), (i, 4)) & 15) for j, d in enumerate(bins) if d is not None)
        out.append(f"{v & 15:x}")
    return "".join(out)


def brute_likeness(a, b):
    return max((sum(x == y for x, y in zip(a, b, strict=True)) / 256 - 1 / 16) / (1 - 1 / 16), 0.0)


def brute_documents(rows):
    """rows: (doc_id, text) with doc_ids of their own."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0]), reverse=True)
    out = {}
    for at, (i, t) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        half = len(t) // 2
        edit = t[: len(t) - half] + after[:half]
        own, other, follows = brute_fingerprint(t), brute_fingerprint(edit), brute_fingerprint(after)
        out[i] = (len(t), hashlib.sha256(edit.encode()).hexdigest(), own, other, brute_likeness(own, other), brute_likeness(own, follows))
    return out


def hold_documents(got, rows):
    want = brute_documents(rows)
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:5] == want[r["doc_id"]][:4]
        assert tuple(r)[5:] == pytest.approx(want[r["doc_id"]][4:])


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "STRASSE", "\x0b", "😀x", "\xa0"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice((0, 1, 3, 4, 5, 6, 12, 40, 300, 900)))) for _ in range(80)]
    texts += ["", None, " \t\r\n", "A b C d E", "a B c D e", "long " * 30_000, "".join(chr(0x1F600 + i % 60) for i in range(99))]
    rows = [(i * 7 - 100, t) for i, t in enumerate(texts)] + [(None, "a text without an id")]
    docs = spark.createDataFrame([(i, t, "part", 3, True) for i, t in rows], "doc_id long, text string, part string, h long, guest boolean").repartition(6)
    hold_documents(FP.document_fingerprints(docs).collect(), rows)


def test_fingerprints_of_repeated_null_and_single_ids(spark):
    """Rows of one id follow each other, each row once; the row after the last is the first."""
    rows = [(5, f"text {i} of one id") for i in range(40)] + [(None, f"none {i}") for i in range(40)] + [(5, "text 0 of one id"), (9, "nine"), (1, "one")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    got = FP.followed(docs, F.length).select("doc_id", "text", "made", "next_text", "next_made").collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows) and Counter(r["next_text"] for r in got) == Counter(t for _, t in rows)
    follows = {r["text"]: r for r in got}
    assert follows["nine"]["next_text"].startswith("text") and follows["one"]["next_text"].startswith("none")
    assert all(r["made"] == len(r["text"]) and r["next_made"] == len(r["next_text"]) for r in got)
    assert [r["text"] for r in got if r["next_text"] == "nine"][0].startswith("none")
    assert FP.document_fingerprints(docs.where("false")).collect() == []
    one = FP.document_fingerprints(docs.where("doc_id = 1")).collect()[0]
    assert one["near_next"] == 1 and one["n_chars"] == 3


def test_likeness_estimates_similarity(spark):
    rng = random.Random(2)
    rows, want = [], []
    for i in range(60):
        a = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((1, 4, 9, 60, 400)))]
        b = [w if rng.random() > 0.01 * (i % 9) else "other" for w in a]
        sets = [{tuple(x[j : j + 5]) for j in range(max(len(x) - 4, 1))} for x in (a, b)]
        rows.append((" ".join(a), " ".join(b)))
        want.append(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(FP.likeness(FP.fingerprint(F.col("a")), FP.fingerprint(F.col("b")))).collect()]
    errors = [abs(g - w) for g, w in zip(got, want, strict=True)]
    assert max(errors) < 0.17 and sum(errors) / len(errors) < 0.03


def test_fingerprints_without_python_workers(spark):
    plan = FP.document_fingerprints(frame(spark, ["a b c d e f", "x"]).cache())._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@TABLES
def test_fingerprints_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    hold_documents(Q.queries()["op13_fingerprints"](spark, FOLDER).collect(), rows)

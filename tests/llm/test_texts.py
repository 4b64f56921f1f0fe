"""Text operators against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm.language import document_rows, fit_profiles, identify, page_rows
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.media import chunks, cuts, media_columns
from lodestone.llm.ngram_join import keep_one, ngram_components
from lodestone.llm.partenum import signatures
from lodestone.llm.suffix_tree import score_texts
from lodestone.llm import topk
from lodestone.llm.topk import exact_top_k, quantised
from lodestone.llm.toxicity import IDENTITY, fit, keep_clean, score

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
DOCS = "doc_id long, text string, row string, n long, fp string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def corpus(n, seed, spread=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(spread)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.4:
            w = words(rng.choice(out))
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choices(vocabulary, k=rng.choice((1, 3, 5, 9, 40, 150, 300)))))
    return out


def frame(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "c", 1, "d") for i, t in enumerate(texts)], DOCS)


# --- n-gram Jaccard join


def brute_components(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = words(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in range(len(texts))}


def test_ngram_components(spark):
    texts = [*corpus(260, 5), "", None, "  ", "One", "one", "ONE two", "a b c d", "A B C D", "x " * 50]
    base = [f"v{i}" for i in range(150)]
    rng = random.Random(3)
    for _ in range(60):  # near copies of one text, some of them not near each other
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(150)] = f"z{rng.random()}"
        texts.append(" ".join(w))
    texts += [" ".join(base)] * 20
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_components(frame(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_ngram_components_of_long_texts_and_short_sets(spark):
    """Coarser parts, so that signatures are long and some sets short; texts of over 1,000 words."""
    rng = random.Random(17)
    base = [" ".join(rng.choices([f"w{i}" for i in range(900)], k=n)) for n in (1300, 1300, 520, 60, 60, 30, 14, 8)]
    texts = list(base)
    for _ in range(150):
        w = words(rng.choice(base))
        for _ in range(rng.randint(0, len(w) // 20 + 1)):
            at = rng.randrange(len(w))
            w[at : at + rng.choice((0, 1, 1, 2))] = [f"n{rng.random()}"] * rng.choice((0, 1))
            w = w or ["x"]
        texts.append(" ".join(w))
    want = brute_components(texts)
    for coarse in (0, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_components(frame(spark, texts), coarse=coarse).collect()}
        assert got == want, coarse


def test_partenum_signatures():
    """Linked sets share a signature unless one is short; contents of subsets are never empty."""
    rng = np.random.default_rng(1)
    linked = 0
    for _ in range(1500):
        a = int(rng.choice([1, 2, 3, 4, 5, 7, 8, 12, 16, 31, 32, 33, 64, 127, 128, 200, 255, 256, 900]))
        one = np.unique(rng.integers(0, 2**64, a, dtype=np.uint64))
        two = np.unique(np.concatenate((rng.permutation(one)[: a - rng.integers(0, a // 4 + 1)], rng.integers(0, 2**64, rng.integers(0, a // 3 + 1), dtype=np.uint64))))
        both = len(np.intersect1d(one, two))
        for coarse in (0, 2):
            own, sig, short = signatures(np.concatenate((one, two)), np.array([0, len(one)]), np.array([len(one), len(two)]), coarse=coarse)
            assert coarse or not short.any()
            if 100 * both >= 75 * (len(one) + len(two) - both) and not short.any():
                linked += 1
                assert len(np.intersect1d(sig[own == 0], sig[own == 1]))
    assert linked > 500


def test_keep_one_of_each_component(spark):
    a, near, b = "one two three four five six seven eight nine ten eleven twelve", "one two three four five six seven eight nine ten eleven twelve thirteen", "another text of its own that has nothing in common with the first"
    rows = [(5, near, 1), (3, a, 2), (3, a, 3), (3, b, 4), (None, b, 5), (None, "texts without an id stay if they are alone there is no doubt", 6), (None, "", 7), (8, None, 8), (None, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = sorted(((r["doc_id"], r["text"]) for r in keep_one(df).collect()), key=str)
    assert got == sorted([(3, a), (3, b), (None, rows[5][1]), (None, ""), (None, ""), (8, None)], key=str)
    assert keep_one(df).columns == df.columns
    assert keep_one(df.limit(0)).count() == 0


def test_null_ids_link_others(spark):
    w = [f"w{i}" for i in range(60)]
    texts = [" ".join(w), " ".join(w[:50]), " ".join(w[:42])]  # the first and the last aren't near
    got = ngram_components(spark.createDataFrame([(1, texts[0]), (None, texts[1]), (2, texts[2])], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (None, 1), (2, 1)}


def test_ngram_components_of_nothing(spark):
    assert ngram_components(frame(spark, [])).count() == 0


def test_ngram_components_with_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "q r s"), (7, None)]
    got = sorted(ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter([(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 1, None), (7, 0, 7)])


# --- line dedup


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_lines(texts):
    seen, out = [], []
    for t in texts:
        kept, n, k = [], 0, 0
        for raw in (t or "").split("\n"):
            line = raw.strip(" \t\r")
            if not line:
                kept.append(raw)
                continue
            n += 1
            gone = line in seen or any(one_edit(s, line) for s in seen)
            if line not in seen:
                seen.append(line)
            if not gone:
                kept.append(raw)
                k += 1
        out.append((0, 0, None) if t is None else (n, k, "\n".join(kept)))
    return out


def test_line_dedup(spark):
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdeé ", k=rng.choice((1, 2, 3, 5, 15, 16, 17, 40, 90)))).strip() or "z" for _ in range(40)]
    lines = list(base)
    for _ in range(150):
        s = rng.choice(base)
        i, c = rng.randrange(len(s) + 1), rng.choice("abcé")
        lines.append(rng.choice((s, s[:i] + c + s[i:], s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :], s[:i] + c + s[i:] + c, " " + s + "\t")))
    rng.shuffle(lines)
    texts = ["\n".join(rng.choices(["", *lines], k=rng.randint(1, 9))) for _ in range(80)]
    texts += [None, "", "\n\n", "same line of twenty\n" * 3 + "\r\nsame line of twenty!"]
    got = {r["doc_id"]: (r["n_lines"], r["n_kept"], r["text"]) for r in dedup_lines(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts)


def test_line_dedup_keeps_columns_and_takes_no_rows(spark):
    rows = frame(spark, ["one line that is long\nx"]).withColumn("n_kept", F.lit("old"))
    out = dedup_lines(rows)
    assert set(out.columns) == {"doc_id", "text", "row", "n", "fp", "n_lines", "n_kept"} and out.first()["n_kept"] == 2
    assert dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_of_any_kind_of_id(spark):
    """Ids of another width hash as longs do; a template of many lines has one key."""
    texts = ["first line of this text\nb", "second, another line\nfirst line of this text", None] + [f"page number {i} of this book" for i in range(3000, 3400)]
    want = brute_lines(texts)
    for kind in ("int", "string", "long"):
        rows = frame(spark, texts).withColumn("doc_id", F.col("doc_id").cast(kind))
        got = {int(r["doc_id"]): (r["n_lines"], r["n_kept"], r["text"]) for r in dedup_lines(rows).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_line_dedup_uses_no_python(spark):
    plan = dedup_lines(frame(spark, ["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- media


def test_media_columns(spark):
    passage = " ".join(corpus(1, 4, 90)[0].split() * 60)
    texts = ["", None, "a", "é" * 95, "x" * 192, passage, passage, "head " + passage + " tail", passage[700:], "z" * 30_000]
    got = {r["doc_id"]: r for r in media_columns(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]), len(full) + 44)
    assert got[5][2:] == got[6][2:] and got[0][2:] == got[1][2:]


def test_media_of_null_ids_and_nothing(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "b"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert Counter(r["doc_id"] for r in media_columns(rows).collect()) == {None: 2, 1: 2}
    assert media_columns(frame(spark, [])).count() == 0


def test_cuts_follow_content():
    data = np.random.default_rng(0).integers(97, 123, 60_000, np.uint8).tobytes()
    a, b = chunks(data), chunks(b"some other words before it " + data)
    assert b"".join(a) == data and max(map(len, a)) <= 8192 and cuts(data) == np.cumsum([len(x) for x in a]).tolist()
    assert len(set(a) & set(b)) > 0.9 * len(a)


# --- suffix tree


def test_suffix_tree_scores(spark):
    phrase = "the old harbour clock struck nine and nobody looked up"
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["a", "b", "Cc", "d"], k=12)) + " " + phrase for _ in range(60)] + ["", None, "unknown words only", phrase, phrase]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "b b")], "doc_id long, text string")
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    got = score_texts(docs, train).collect()
    assert len(got) == len(texts) + 2
    learnt = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1] + ([texts[3]] if zlib.crc32(b"3") % 5 != 1 else []) + ["b b"]
    c = Counter(w for t in learnt for w in words(t))
    ends, total = len(learnt), sum(c.values()) + len(learnt)
    scale = total + 0.5 * (len(c) + 2)
    for r in got:
        t = "b b" if r["doc_id"] is None else texts[r["doc_id"]]
        w = words(t)
        base = sum(math.log10((c[x] + 0.5) / scale) for x in w) + math.log10((ends + 0.5) / scale)
        assert r["base_score"] == pytest.approx(base, abs=1e-9) and r["train_tokens"] == total
        assert (r["n_tokens"], r["n_known"]) == (len(w) + 1, 1 + sum(c[x] > 0 for x in w))
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        if phrase in (t or ""):
            assert r["score"] > r["base_score"] + 5


def test_suffix_tree_distributions_sum_to_one(spark):
    from lodestone.llm.suffix_tree import word_counts

    from ._tree import grow

    rng = random.Random(1)
    texts = frame(spark, [" ".join(rng.choices("abcd", k=1)) + " " + " ".join(x for _ in range(6) for x in rng.choice(("e f g", "f e g", "h a"),).split()) for _ in range(80)])
    counts = word_counts(texts)
    total = int(counts.agg(F.sum("n")).first()[0]) + 80
    kinds = counts.count() + 1
    tree = grow(texts, counts, 80, total, total + 0.5 * (kinds + 1))
    assert any(k.any() for k in tree.kept)
    root = 10**tree.root[:-1]  # the start is no symbol
    for d, keys in enumerate(tree.grams):
        for context in np.flatnonzero(tree.kept[d]):
            p = root.copy() if d == 0 else None
            if d == 0:
                own = keys >> 22 == context
                word = (keys & ((1 << 22) - 1))[own]
                p *= 10 ** tree.rest[0][context]
                p[word] = 10 ** (tree.gain[0][own] + tree.root[word])
                unseen = 1 - root.sum()
                assert p.sum() + unseen * 10 ** tree.rest[0][context] == pytest.approx(1, abs=1e-6)


def test_suffix_tree_table_equals_tree_in_memory(spark):
    from lodestone.llm._text import slices
    from lodestone.llm.suffix_tree import pair_keys, word_counts

    from ._tree import grow

    ab = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, (2, 50))
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in ab.T], "a long, b long")
    assert [r[0] for r in pairs.select(F.xxhash64("a", "b")).collect()] == pair_keys(ab[0].copy(), ab[1].copy()).tolist()
    rng = random.Random(5)
    parts = ["the old harbour clock", "clock struck nine", "nine and nobody looked up", "up the hill", "x", "y z"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(300)] + [""]
    docs = frame(spark, texts)
    counts = word_counts(docs)
    total, kinds = counts.agg(F.sum("n"), F.count("*")).first()
    total, kinds = total + len(texts), kinds + 1
    tree = grow(docs, counts, len(texts), total, total + 0.5 * (kinds + 1))
    assert all(k.any() for k in tree.kept) and len(tree.kept) == 3
    import pyarrow as pa

    want = np.concatenate([tree.gains(part) for part in slices(pa.array(texts))])
    for common in (0, 20, 262_144):
        got = {r["doc_id"]: r["score"] - r["base_score"] for r in score_texts(docs, F.lit(True), common).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx(want.tolist(), abs=1e-9)


def test_suffix_tree_keeps_contexts_of_large_inputs(spark):
    """A phrase of ten times keeps its states among 12 million other words."""
    filler = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.concat(F.lit("f"), (i + F.col("id")) % 7)))
    docs = spark.range(600).select("id", filler.alias("text")).unionByName(spark.range(1000, 1010).select("id", F.lit("zinc yarrow xylem").alias("text"))).withColumnRenamed("id", "doc_id")
    got = score_texts(docs, F.lit(True)).where("doc_id = 1000").first()
    assert got["score"] > got["base_score"] + 5


def test_suffix_tree_of_nothing(spark):
    assert score_texts(frame(spark, []), F.lit(True)).count() == 0
    assert score_texts(frame(spark, ["a b"]), F.lit(False)).first()["n_known"] == 0


# --- exact top k


def test_exact_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(700, 24)).astype("float32"))]
    rows += [(1000 + i, rows[50][1]) for i in range(30)]  # one very common vector: ties
    rows += [(2000, None), (2001, [None] + [0.0] * 23), (2002, [float("nan")] * 24), (2003, [float("inf")] * 24), (2004, []), (2050, [1.0, 2.0]), (None, [0.5] * 24)]
    data = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {}
    for r in exact_top_k(data, data.where("id % 50 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.floor(256 * np.array(v, "float32").astype(float)).astype(int) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    for q in [i for i in good if i % 50 == 0]:
        s = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, i, -x) for k, (x, i) in enumerate(s)]


def test_exact_top_k_asks_all_rows_of_a_repeated_id(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-9, 9, 8).astype(float).tolist()) for i in range(120)]
    rows += [(50, rng.integers(-9, 9, 8).astype(float).tolist()) for _ in range(6)] + [rows[100]]
    data = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), scale=1)
    got = sorted(tuple(r) for r in exact_top_k(data, data.where("id % 50 = 0"), 5).collect())
    want = []
    for q in (0, 50, 100):
        s = sorted((-int(np.dot(a, b)), j) for i, a in rows if i == q for j, b in rows if j != q)[:5]
        want += [(q, k + 1, j, -x) for k, (x, j) in enumerate(s)]
    assert got == want


@pytest.mark.parametrize("size", [1, 10**6, 10**9, 2**40, 2**61])
def test_exact_top_k_of_large_components(spark, size):
    """Sums that 64-bit floats, and integers, don't hold."""
    rng = random.Random(size)
    rows = [(i, [float(rng.randint(-size, size)) for _ in range(6)]) for i in range(90)] + [(90, [float(size), 1.0, 0.0, 0.0, 0.0, 0.0]), (100, [float(size), 1.0, 0.0, 0.0, 0.0, 0.0])]
    data = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=1)
    got = sorted(tuple(r) for r in exact_top_k(data, data.where("id % 50 = 0"), 4).collect())
    want = []
    for q, v in ((i, x) for i, x in rows if i % 50 == 0):
        score = lambda x, v=v: max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(v, x, strict=True))))
        s = sorted((-score(x), i) for i, x in rows if i != q)[:4]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert got == sorted(want)
    if size == 10**6:
        assert (100, 1, 90, 10**12 + 1) in got or any(r[0] == 100 and r[3] >= 10**12 + 1 for r in got)


def test_exact_top_k_of_many_blocks(spark, monkeypatch):
    """Blocks of a few rows over a grid of several groups of both."""
    monkeypatch.setattr(topk, "ROWS", 7)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(11)
    rows = [(i, rng.integers(-40, 40, 5 if i % 3 else 9).astype(float).tolist()) for i in range(400)]
    data = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=1)
    got = sorted(tuple(r) for r in exact_top_k(data, data.where("id % 10 = 0"), 3).collect())
    want = []
    for q, v in rows[::10]:
        s = sorted((-int(np.dot(v, x)), i) for i, x in rows if i != q and len(x) == len(v))[:3]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert got == sorted(want)


def test_exact_top_k_of_few(spark):
    data = quantised(spark.createDataFrame([(0, [1.0, -1.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in exact_top_k(data, data.where("id = 0")).collect()] == [(0, 1, 1, 0)]
    assert exact_top_k(data.where("id < 0"), data.where("id < 0")).count() == 0


# --- toxicity


def labelled(spark, n=1200, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.3
        w = rng.choices([f"plain{k}" for k in range(60)], k=20)
        if bad:
            w += rng.choices(["scumbag", "vermin", "idiotic"], k=2)
        if rng.random() < (0.5 if bad else 0.02):  # group mentions go with toxic labels here, unfairly
            w.append(rng.choice(IDENTITY[3]))
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    return df.select("doc_id", "text"), df.select("doc_id", "label")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = fit(docs, labels.where("doc_id < 900"))
    rows = score(docs, model).join(labels, "doc_id").where("doc_id >= 900").toPandas()
    assert ((rows["score"] >= 0.3) == (rows["predicted"] == 1)).all()
    assert (rows["predicted"] == rows["label"]).mean() > 0.97
    kept = keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == (score(docs, model).where("predicted = 0").count())


def test_counterfactual_penalty_evens_out_group_mentions(spark):
    docs, labels = labelled(spark)
    neutral = spark.createDataFrame([(i, f"plain1 plain2 {t}") for i, t in enumerate(IDENTITY[3])], "doc_id long, text string")
    spread = []
    for penalty in (0.0, 50.0):
        s = score(neutral, fit(docs, labels, swap_penalty=penalty)).toPandas()["score"]
        spread.append(float(s.max() - s.min()))
    assert spread[1] <= spread[0]


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "x"), (2, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r["score"] for r in score(docs, fit(docs, none)).collect()} == {0.5}
    assert score(docs.limit(0), fit(docs, none)).count() == 0
    one = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, label int")
    assert {round(r["score"], 6) for r in score(docs, fit(docs, one)).collect()} == {0.75}


# --- language


def tongues(spark):
    rng = random.Random(3)
    parts = {"en": ["the", "thing", "with", "shall", "whether"], "de": ["und", "nicht", "zwischen", "über", "ich"]}
    rows = [(i, " ".join(rng.choices(parts[x], k=15)), x, "h1" if i % 3 else None) for i, x in enumerate(["en", "de"] * 40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_language(spark):
    docs = tongues(spark)
    profiles = fit_profiles(docs)
    assert profiles.languages == ["de", "en", "und"]
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "en").otherwise(F.col("lang")))
    got = identify(document_rows(wrong), profiles).join(docs, F.col("id") == F.col("doc_id")).toPandas()
    assert (got["text_lang"] == got.iloc[:, -2]).mean() == 1.0
    odd = spark.createDataFrame([(1, None, None, None), (2, "", "EN-gb", "a.b.de:80"), (3, "9 8 7", "xx", ""), (4, "und nicht zwischen über ich", None, None)], "id long, text string, declared string, host string")
    found = {r["id"]: r for r in identify(odd, profiles).collect()}
    assert found[4]["lang"] == "de" and found[2]["declared"] == "en" and (found[2]["host"], found[2]["suffix"]) == ("a.b.de", "de") and found[1]["host"] is None
    assert identify(odd.limit(0), profiles).count() == 0
    assert identify(odd, fit_profiles(docs.limit(0))).where("lang = 'und'").count() == 4


def test_language_has_no_cap_on_labels_or_declarations(spark):
    """Ninety languages, one of two regions, and more declarations than go out to all tasks."""
    rng = random.Random(9)
    tags = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(90)]
    stems = {x: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(6)] for x in tags}
    rows = [(i, " ".join(rng.choices(stems[x], k=20)), x.upper() + ("-GB" if i % 2 else "_US"), None) for i, x in enumerate(tags * 2 + tags[:20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    profiles = fit_profiles(docs)
    assert profiles.languages == [*tags, "und"]
    others = [chr(97 + i // 676) + chr(97 + i // 26 % 26) + chr(97 + i % 26) for i in range(1500)]
    many = spark.createDataFrame([(1000 + i, rows[i % 90][1], x, None) for i, x in enumerate(others)], "doc_id long, text string, lang string, source string")
    got = {r["id"]: r for r in identify(document_rows(docs.unionByName(many)), profiles).collect()}
    assert len(got) == 1700
    assert all((got[i]["text_lang"], got[i]["lang"], got[i]["declared"]) == (tags[i % 90],) * 3 for i in range(180))
    # the same texts with rare declarations: these are evidence as the frequent ones are
    assert all(got[1000 + i]["lang"] == tags[i % 90] for i in range(1500))
    empty = spark.createDataFrame([(5000 + i, "", x, None) for i, x in enumerate([*others, *tags, *tags])], "doc_id long, text string, lang string, source string")
    told = {r["declared"]: r["lang"] for r in identify(document_rows(empty), profiles).collect()}
    assert len(told) == 1590 and all(told[x] == x for x in tags)


def test_page_rows(spark):
    pages = spark.createDataFrame([(1, "https://u@x.example.org:8080/p?q", "<HTML dir=ltr lang='fr-CA'><script>var a='<p>';</script><!-- c --><p>Bonjour &amp; toi</p>"), (2, None, None)], "page_id long, url string, html string")
    a, b = page_rows(pages).orderBy("id").collect()
    assert (a["declared"], a["host"], a["text"].split()) == ("fr-CA", "x.example.org:8080", ["Bonjour", "toi"]) and b["text"] == ""

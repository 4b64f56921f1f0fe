"""Independent reckonings of the models, and the registered queries themselves."""

import hashlib
import io
import math
import os
import random
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries as Q
from lodestone.llm.language import BUCKETS, fit_profiles, identify
from lodestone.llm.media import media_columns
from lodestone.llm.suffix_tree import _alike, score_texts
from lodestone.llm.toxicity import fit, score

from .test_texts import frame, words

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")


def suffix_tree_scores(train, texts, depth=3, least=4, strength=4.0):
    """Scores by dictionaries of n-grams; see the operator's docstring."""
    n = [Counter() for _ in range(depth + 1)]
    for t in train:
        q = ["<s>", *words(t), "</s>"]
        for size in range(1, depth + 2):
            n[size - 1].update(tuple(q[i : i + size]) for i in range(len(q) - size + 1))
    known = {g[0]: c for g, c in n[0].items() if g[0] != "<s>"}
    scale = sum(known.values()) + 0.5 * (len(known) + 1)
    root = lambda w: (known.get(w, 0) + 0.5) / scale
    p, rest, kept = [{g: root(g[0]) for g, c in n[0].items() if c >= least}], [], []
    for size in range(2, depth + 2):
        grams, own = {}, defaultdict(list)
        for g, c in n[size - 1].items():
            if c >= least:
                above, total = p[-1][g[1:]], n[size - 2][g[:-1]]
                grams[g] = (c + strength * above) / (total + strength)
                own[g[:-1]].append((c, above, grams[g]))
        r, k = {}, set()
        for context, rows in own.items():
            total = n[size - 2][context]
            left = max(1 - sum(a for _, a, _ in rows), 1e-12)
            other = max(total - sum(c for c, _, _ in rows), 0)
            ratio = 2 * (sum(c * math.log(c / total / a) for c, a, _ in rows) + (other * math.log(other / total / left) if other else 0))
            r[context] = math.log10(max(1 - sum(x for _, _, x in rows), 1e-12) / left)
            if ratio >= len(rows) + 4 * math.sqrt(2 * len(rows)) + 10:
                k.add(context)
        p.append(grams)
        rest.append(r)
        kept.append(k)
    for d in range(depth - 1, 0, -1):
        kept[d - 1] |= {c[1:] for c in kept[d]}
    out = []
    for t in texts:
        q, total = ["<s>", *words(t), "</s>"], 0.0
        for i in range(1, len(q)):
            best = math.log10(root(q[i]))
            for d in range(1, depth + 1):
                context = tuple(q[max(i - d, 0) : i])
                if len(context) < d or context not in kept[d - 1]:
                    break
                g = (*context, q[i])
                best = math.log10(p[d][g]) if g in p[d] else best + rest[d - 1][context]
            total += best
        out.append(total)
    return out


def test_suffix_tree_against_dictionaries(spark):
    rng = random.Random(8)
    parts = ["the old harbour clock", "clock struck nine", "nine and nobody looked up", "up the hill", "x", "y z", "old harbour"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(250)] + ["never seen", "", " ".join(parts * 300)]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    want = suffix_tree_scores([t for t, h in zip(texts, held, strict=True) if not h], texts)
    for common in (0, 524_288):
        got = {r["doc_id"]: r["score"] for r in score_texts(frame(spark, texts), F.crc32(F.col("doc_id").cast("string")) % 5 != 1, common).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-6)


def test_media_against_the_standard_library(spark):
    texts = ["plain text " * 30, "é" * 100, "", None, "a" * 192, "tick tock\n" * 2000]
    got = {r["doc_id"]: r for r in media_columns(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        data = raw + b" " * (-len(raw) % 192 if raw else 192)
        file = io.BytesIO()
        with wave.open(file, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(8000)
            w.writeframes(data)
        n, size = Counter(data), len(data)
        mean = sum(data) / size
        std = math.sqrt(sum((x - mean) ** 2 for x in data) / size)
        entropy = -sum(c / size * math.log2(c / size) for c in n.values())
        crossings = sum((a > mean) != (b > mean) for a, b in zip(data, data[1:], strict=False))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), size, hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(file.getvalue()), hashlib.sha256(file.getvalue()).hexdigest())
        values = dict(x.split("=") for x in r["feature"].split(";"))
        assert float(values["mean"]) == pytest.approx(mean, abs=1e-3) and float(values["std"]) == pytest.approx(std, abs=1e-3)
        assert float(values["entropy"]) == pytest.approx(entropy, abs=1e-3) and int(values["levels"]) == len(n)
        assert float(values["crossings"]) == pytest.approx(1000 * crossings / size, abs=0.01)


def test_language_against_plain_sums(spark):
    """The fusion of text, declaration, host and suffix, term by term."""
    rng = random.Random(3)
    vocabulary = {"en": "the and house water night little would there".split(), "de": "der und haus wasser nacht kleine würde dort".split(), "fr": "le et maison eau nuit petite serait là".split()}
    say = lambda lang, k: " ".join(rng.choices(vocabulary[lang], k=k))
    labelled = [(say(x, 30), f"{x}-XX" if i % 3 else x.upper()) for x in vocabulary for i in range(12)] + [("ignored", None)]
    rows = []
    for i in range(90):
        lang = rng.choice(["en", "de", "fr"])
        rows.append((i, say(lang, rng.choice((0, 1, 2, 8))), rng.choice([lang, "EN-us", None, "tlh"]), rng.choice([f"{lang}.example.com:80", "mixed.org", "local", None])))
    profiles = fit_profiles(spark.createDataFrame(labelled, "text string, lang string"))
    got = {r["id"]: r for r in identify(spark.createDataFrame(rows, "id long, text string, declared string, host string"), profiles).collect()}

    def buckets(text):
        b = [c + 32 if 65 <= c <= 90 else c for c in text.encode()]
        b = [c if 97 <= c <= 122 or c >= 128 else 32 for c in b]
        return [((x | y << 8 | z << 16) * 0x9E3779B1 % 2**32) >> 16 for x, y, z in zip(b, b[1:], b[2:], strict=False) if y != 32]

    names = ["de", "en", "fr"]
    counts = {x: Counter(k for t, lang in labelled if lang and lang.lower()[:2] == x for k in buckets(t)) for x in names}
    names.append("und")

    def loglik(text):
        t = buckets(text)
        z = [sum(math.log((counts[x][k] + 0.01) / (sum(counts[x].values()) + 0.01 * BUCKETS)) for k in t) for x in names[:3]] + [-math.log(BUCKETS) * len(t)]
        z = [v * min(len(t), 60) / max(len(t), 1) for v in z]
        z[3] += math.log(1e-3)
        return z

    def soft(z):
        e = [math.exp(v - max(z)) for v in z]
        return [v / sum(e) for v in e]

    tag = lambda d: d and d.lower().split("-")[0]
    zs = {i: loglik(t) for i, t, _, _ in rows}
    said = defaultdict(lambda: [0.0] * 4)
    for i, _, d, _ in rows:
        if d:
            said[tag(d)] = [a + b for a, b in zip(said[tag(d)], soft(zs[i]), strict=True)]
    whole = [sum(x) for x in zip(*said.values(), strict=True)]
    kinds = len(said)
    ys = {}
    for i, _, d, _ in rows:
        ys[i] = list(zs[i])
        if d:
            for j, x in enumerate(names):
                prior = 1 / kinds if x == "und" else 0.1 / kinds + 0.9 * (tag(d) == x)
                ys[i][j] += math.log((said[tag(d)][j] + 20 * prior) / (whole[j] + 20))
    ps = {i: soft(y) for i, y in ys.items()}
    world = [sum(p[j] for p in ps.values()) for j in range(4)]
    world = [(x + 1) / (sum(world) + 4) for x in world]
    bare = lambda h: h and h.split(":")[0]
    suffix = lambda h: h.rsplit(".", 1)[1] if h and "." in h else None
    for i, _, _, h in rows:
        h = bare(h)
        mine = [k for k, _, _, x in rows if h and bare(x) == h and k != i]
        near = [k for k, _, _, x in rows if suffix(h) and suffix(bare(x)) == suffix(h) and k != i]
        final = []
        for j in range(4):
            by_suffix = (sum(ps[k][j] for k in near) + 20 * world[j]) / (len(near) + 20)
            by_host = (sum(ps[k][j] for k in mine) + 20 * by_suffix) / (len(mine) + 20)
            final.append(ys[i][j] + math.log(by_host))
        final = soft(final)
        assert got[i]["confidence"] == pytest.approx(max(final), abs=1e-5)
        if sorted(final)[-1] - sorted(final)[-2] > 1e-6:
            assert got[i]["lang"] == names[final.index(max(final))]


def test_swaps_change_scores_less_with_the_penalty(spark):
    """Toxic examples mention one group more often; with the penalty its bare mention says less."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        toxic = i % 2
        group = "muslims" if rng.random() < (0.8 if toxic else 0.1) else rng.choice(["christians", "jews", "hindus"])
        rows.append((i, f"{'vile scum' if toxic and rng.random() < 0.7 else 'fine folk'} and {group} met at {rng.choice(['noon', 'night', 'dawn'])}", toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    probe = spark.createDataFrame([(0, "muslims met at noon"), (1, "christians met at noon"), (2, "vile scum met at noon"), (3, "fine folk met at noon")], "doc_id long, text string")

    def gap(penalty):
        s = {r["doc_id"]: math.log(r["score"] / (1 - r["score"])) for r in score(probe, fit(df.select("doc_id", "text"), df.select("doc_id", "label"), swap_penalty=penalty)).collect()}
        return s[0] - s[1], s[2] - s[3]

    plain, held = gap(0.0), gap(1.0)
    assert plain[0] > 1 and held[0] < plain[0] / 3 and held[1] > 1


@pytest.mark.parametrize("texts", [1, 300, (1 << 16) + 9])
def test_equal_keys_of_a_text_stand_together(texts):
    rng = np.random.default_rng(texts)
    key = rng.integers(-40, 40, 90000) * ((1 << 55) + 1) + rng.integers(0, 2, 90000)  # some differ in their lowest bits alone
    owner = np.sort(np.append(rng.integers(0, texts, 89999), texts - 1))
    for of in (None, owner):
        order, first = _alike(key, of)
        ids = np.zeros(len(key), int) if of is None else of
        assert sorted(order) == list(range(len(key)))
        got, runs = Counter(), np.diff(np.append(first, len(order)))
        for at, n in zip(order[first], runs, strict=True):
            got[ids[at], key[at]] += n
        assert got == Counter(zip(ids, key, strict=True))
    assert len(_alike(np.zeros(0, np.int64), np.zeros(0, np.int64))[1]) == 0


@TABLES
@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_queries_over_whole_tables(spark, name):
    table = {"op2_exact_top_k": "embeddings", "op6_language_id": "pages"}.get(name, "documents")
    given = spark.read.parquet(f"{FOLDER}/{table}.parquet")
    got = Q.queries()[name](spark, FOLDER).toPandas()
    key = {"op2_exact_top_k": "query_id", "op6_language_id": "page_id"}.get(name, "doc_id")
    ids = {r[0] for r in given.select({"query_id": "vec_id"}.get(key, key)).collect()}
    assert set(got[key]) == ({i for i in ids if i % 50 == 0} if key == "query_id" else ids)
    if name == "op1_suffix_tree":
        assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 1 for i in got["doc_id"]]).all() and (got["score"] < 0).all()
    if name == "op9_toxicity":
        assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
        assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all() and got["score"].between(0, 1).all()
    if name == "op4_best_fit_packing":
        full = got.groupby("sequence_id")["length"].sum()
        assert full.max() <= 1024 and len(full) <= 1.02 * math.ceil(got["length"].sum() / 1024) + 2
        one = got.sort_values(["sequence_id", "offset"])
        assert (one.groupby("sequence_id")["length"].cumsum() - one["length"] == one["offset"]).all()


@TABLES
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = c.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, FOLDER).select(want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


@TABLES
def test_ids_are_those_of_the_library(spark):
    """Of all documents: packed pieces and token files against ``tokenizers``."""
    from tokenizers import Tokenizer

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    byte, word = (Tokenizer.from_file(Q.vocabulary(x)) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    for r in Q.op4_best_fit_packing(spark, FOLDER).collect():
        ids = [*byte.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
    start = 0
    for r in Q.op7_token_files(spark, FOLDER).orderBy("doc_id").collect():
        ids = [*word.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)

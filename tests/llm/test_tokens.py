"""Token operators against the tokenizers library."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm.bpe import SpeculativeBPE, encode_decode, encode_digests
from lodestone.llm.packing import Plan, best_fit_packing
from lodestone.llm.token_files import token_files
from lodestone.llm._bytelevel import same_encoding

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "The stations reopened; it's 12:30, isn't it?", None, "", " ", "a  b\n\n c", "x\n y\t z ", "it's don't 'some' we'll!!'tis", "É É́ ́x ÀÉ", "hi<|endoftext|>there <|startoftext|> x",
    "日本 語、 ok", "a.b.c (d) 12 3.4", "I'M HERE's Σ ΑΣ", "tab\tx\x1cy \x85z  w", "İstanbul", "a" * 3000, "ababab" * 90, "\x00 \x01", "lorem ipsum " * 900, "The stations reopened; it's 12:30, isn't it?", "a 　b  c",
]
SCHEMA = "doc_id long, text string, ids string, n long, part string"


@pytest.fixture(scope="module")
def docs(spark):
    """Columns that clash with names inside the operators; a null id; repeated rows."""
    rows = [(None if i == 4 else i * 3, t, "x", i, "y") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x", 0, "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def reference(path):
    t = Tokenizer.from_file(path)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids, t


def test_token_files(docs):
    encode, _ = reference(WORD)
    got = token_files(docs, WORD).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and len(got) == len(TEXTS) + 1
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    by_id = {None if i == 4 else 3 * i: t for i, t in enumerate(TEXTS)}
    for r in got:
        want = np.array([*encode(by_id[r["doc_id"]]), 1], "<u4")
        assert (r["n_tokens"], r["ids_crc32"]) == (len(want), zlib.crc32(want.tobytes()))


def test_token_files_of_nothing(spark):
    assert token_files(spark.createDataFrame([], SCHEMA), WORD).count() == 0


def test_bpe_equals_the_library(docs):
    encode, t = reference(WORD)
    for r in encode_decode(docs, WORD).collect():
        text = TEXTS[4 if r["doc_id"] is None else r["doc_id"] // 3]
        assert r["ids"] == encode(text)
        assert r["decoded"] == t.decode(r["ids"], skip_special_tokens=False)
    for r in encode_digests(docs, WORD).collect():
        ids = encode(TEXTS[4 if r["doc_id"] is None else r["doc_id"] // 3])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_speculation_is_verified():
    codec = SpeculativeBPE(WORD)
    words = ["".join(x) for x in np.random.default_rng(1).choice(list("aeinorst"), (3000, 9))]
    t = Tokenizer.from_file(WORD)
    assert codec.encode_words(words) == [x.ids for x in t.encode_batch(words, add_special_tokens=False)]
    assert 0 < codec.failed < codec.tried
    long = "".join(np.random.default_rng(2).choice(list("aeinorst"), 500))
    symbols = [codec.vocab[c] for c in long[:-1]] + [codec.vocab[long[-1] + codec.end]]
    assert codec.merge(symbols) == t.encode(long, add_special_tokens=False).ids


def test_byte_level_library_is_only_used_where_it_is_equal():
    import json

    made = json.loads(Tokenizer.from_file(BYTE).to_str())
    assert same_encoding(made) is not None
    assert same_encoding(made | {"normalizer": {"type": "NFC"}}) is None
    assert same_encoding(json.loads(Tokenizer.from_file(WORD).to_str())) is None


def test_packing(docs):
    encode, _ = reference(BYTE)
    got = best_fit_packing(docs, BYTE).collect()
    whole = {i: [*encode(t), 2] for i, t in ((None if i == 4 else 3 * i, t) for i, t in enumerate(TEXTS))}
    seen = Counter()
    for r in got:
        ids = whole[r["doc_id"]]
        assert 1 <= r["length"] <= 1024
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        assert r["length"] == 1024 or r["piece"] == 0
        seen[r["doc_id"]] += r["length"]
    copies = Counter({k: len(v) for k, v in whole.items()})
    copies[0] *= 2
    assert seen == copies
    rooms = {}
    for r in got:
        rooms.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in rooms.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) <= 1024


def test_packing_of_nothing(spark):
    assert best_fit_packing(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.5, 1.2, 20_000).astype(int), 1, 1024)
    plan = Plan(Counter(lengths.tolist()))
    used = Counter()
    for members, times in plan.patterns:
        assert sum(members) <= 1024 and times > 0
        for m in members:
            used[m] += times
    assert used == Counter(lengths.tolist())
    assert sum(t for _, t in plan.patterns) <= 1.01 * -(-lengths.sum() // 1024) + 1


def test_plan_takes_exact_complements():
    assert sorted(Plan({1000: 1, 24: 1, 500: 2, 300: 1, 224: 1}).patterns) == sorted([([1000, 24], 1), ([500, 300, 224], 1), ([500], 1)])
    assert Plan({512: 5}).patterns == [([512, 512], 2), ([512], 1)]


def test_packing_looks_sums_up_and_fills_all_gaps_that_can_be():
    """Against all combinations of up to four lengths; look-ups are by sum, a few for each length."""
    import itertools
    import random
    from collections import Counter

    rng = random.Random(3)
    for most, kinds, n in ((12, 8, 30), (40, 12, 60), (1024, 300, 5000), (1024, 1023, 40_000)):
        counts = Counter(rng.choices(rng.sample(range(1, most), kinds), k=n))
        plan = Plan(dict(counts), most)
        used = Counter()
        for members, times in plan.patterns:
            assert times > 0 and sum(members) <= most
            for x in members:
                used[x] += times
        assert used == counts
        assert plan.sums.lookups <= kinds * (kinds + 1)
        size = sum(times for _, times in plan.patterns)
        least = max(-(-sum(x * c for x, c in counts.items()) // most), sum(c for x, c in counts.items() if 2 * x > most))
        assert size <= 1.1 * least + 2
    # what is left after exact filling can't fill a sequence with up to four lengths
    counts = {7: 3, 5: 2, 4: 1, 3: 5}
    plan = Plan(counts, 12)
    loose = Counter()
    for members, times in plan.patterns:
        if sum(members) < 12:
            for x in members:
                loose[x] += times
    rest = list(loose.elements())
    assert not any(sum(c) == 12 for k in (2, 3, 4) for c in itertools.combinations(rest, k))


def test_plain_words_skip_the_tokenizer(monkeypatch):
    """Words of Latin letters have the whole tokenizer's ids, from the vocabulary's merges alone; nothing else is taken for one."""
    import random

    from lodestone.llm._tokens import TextCodec

    codec, rng = TextCodec(WORD), random.Random(7)
    latin = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
    letters = [chr(c) for c in range(97, 123)] * 3 + latin
    words = [*letters, *("".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(4000)), "é" * 400]
    others = ["", "a1", "l'été", "naïve,", "x×y", "é", "ªº", "µ", "ſ", "Ωmega", "σς", "a­b", "a<|endoftext|>b", "日本", "aĲ"]
    want = [x.ids for x in codec.tokenizer.encode_batch(words + others, add_special_tokens=False)]
    assert codec._words([x.encode() for x in words + others]) == want
    assert all(codec.plain(x.encode()) is None for x in others)
    monkeypatch.setattr(codec, "_whole", lambda texts: [[] for t in texts if t])
    assert codec._words([x.encode() for x in words]) == want[: len(words)]

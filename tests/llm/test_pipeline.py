"""The pipeline, stage by stage, on small rows."""

import pytest

import corpus_pipeline as P


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    good = [f"number {i} tells a story of its own about the {w} and what became of it in year {1900 + i} there" for i, w in enumerate("harbour mill castle bridge tower garden market river forest island".split())]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good * 4)]
    rows = [(i, t if i < 10 else f"{t}\nextra line {i} with words enough to be one of a kind {i * 7919}", *r) for i, t, *r in rows]
    rows += [(100, "you vile scumbag vermin", "en", "s", 23), (101, good[0], "en", "s", 9), (102, "", "en", "t", 0), (103, None, None, None, None)]
    bad = [(200 + i, f"such a vile scumbag vermin number {i}", "en", "s", 30) for i in range(12)]
    spark.createDataFrame(rows + bad, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(200 + i, 0, 1) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, step in P.STAGES[:-1]:
        before = docs
        docs = step(spark, docs, folder)
        assert docs.columns == P.COLUMNS
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        seen.append((name, {r["doc_id"] for r in docs.collect()}))
    toxic, language, lines, ngrams = (x[1] for x in seen)
    assert 100 not in toxic and not any(d >= 200 for d in toxic) and set(range(40)) <= toxic
    assert set(range(40)) <= language
    assert 101 not in lines and set(range(40)) <= lines
    assert set(range(40)) <= ngrams
    packed = P.run(spark, folder).toPandas()
    assert set(range(40)) <= set(packed["doc_id"]) and (packed.groupby("sequence_id")["length"].sum() <= 1024).all()


ODD = "doc_id long, text string, lang string, source string, n_chars long, key string, fp int, label int, n_lines int"


def test_stages_of_odd_rows(spark, folder):
    """Nulls in any column, equal rows, empty and long texts, columns whose names clash: each stage gives its columns, and crashes on none."""
    long = "a sentence of many words that goes on and on until there is nothing left to say about it " * 400
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", None, 0), (2, long, "en", "s", 1), (2, long, "en", "s", 1), (None, "number 3 tells a story of its own about the bridge", None, None, None), (3, "Zahl \n\n\t", "de", "", 3)]
    docs = spark.createDataFrame([(*r, "k", 1, 1, 5) for r in rows], ODD)
    for _, step in P.STAGES:
        out = step(spark, docs, folder)
        assert set(P.COLUMNS) <= set(out.columns) or "sequence_id" in out.columns
        assert out.count() <= 2 * len(rows) + 40
        assert step(spark, docs.limit(0), folder).count() == 0


def test_stages_against_plain_reckoning(spark, folder):
    from .test_texts import brute_components, brute_lines

    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 100 AND text IS NOT NULL").orderBy("doc_id")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts |= {50 + i: f"{texts[i]} and a bit more" for i in range(5)} | {60: texts[0], 61: "short", 62: "short"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    ids = sorted(texts)
    lines = {i: x for i, x in zip(ids, brute_lines([texts[i] for i in ids]), strict=True)}
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in P.line_dedup(spark, docs, folder).collect()}
    assert got == {i: (t, len(t)) for i, (n, k, t) in lines.items() if n == 0 or k}
    component = brute_components([texts[i] for i in ids])
    stays = {ids[k] for k in range(len(ids)) if component[k][1] == k}
    assert {r["doc_id"] for r in P.ngram_join(spark, docs, folder).collect()} == stays

import zlib

import numpy as np
from pyspark.sql import functions as F

from cases import edge_docs, edge_rows, no_docs
from corpuslens.llm import catalog
from corpuslens.llm.langid import decode, identify, language_filter, train, trained_on_rest

SAMPLE = "/root/testdata/sf0.01"


def slow_viterbi(scores, switch):
    """Best path by plain dynamic programming."""
    value, back = scores[0].astype(np.float64), []
    for s in scores[1:]:
        best = int(value.argmax())
        back.append([k if value[k] >= value[best] - switch else best for k in range(len(value))])
        value = np.maximum(value, value[best] - switch) + s
    path = [int(value.argmax())]
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1]


def test_decoding_equals_plain_viterbi():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 7, 3, 0, 30, 30, 2]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(0, 4, (first[-1], 3)).astype(np.float32)
    got = decode(scores, first, 5.0)
    for a, b in zip(first, first[1:]):
        if b > a:
            assert got[a:b].tolist() == slow_viterbi(scores[a:b], 5.0)


def test_held_out_accuracy(spark):
    rows = catalog.QUERIES["op9_langid"](spark, SAMPLE).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SAMPLE}/documents.parquet").collect()}
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.97


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    away = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    spoilt = docs.withColumn("lang", F.when(away, F.lit("xx")).otherwise(F.col("lang")))
    a, b = trained_on_rest(docs), trained_on_rest(spoilt)
    assert a.langs == b.langs and (a.logp == b.logp).all()


def languages(spark):
    rows = [("en", "the cat and the dog were in the house with the bird"), ("de", "der hund und die katze waren nicht im haus mit dem vogel"),
            ("ru", "кошка и собака были в доме с птицей"), ("el", "η γάτα και ο σκύλος ήταν στο σπίτι"), (None, "zzz"), ("fr", None)]
    return train(spark.createDataFrame(rows * 5, "lang string, text string"))


def test_spans_and_scripts(spark):
    model = languages(spark)
    assert model.langs == ["de", "el", "en", "ru"]
    text = "the cat and the dog were in the house. кошка и собака были в доме! der hund und die katze waren nicht im haus"
    rows = identify(spark.createDataFrame([(1, text), (2, "птицей птицей qqq")], "doc_id long, text string"), model).orderBy("row.doc_id").collect()
    assert [(s.lang, text[s.start:s.end].split()[0]) for s in rows[0].spans] == [("en", "the"), ("ru", "кошка"), ("de", "der")]
    assert rows[1].lang_pred == "ru" and rows[0].lang_pred == "de"


def test_edge_rows(spark):
    rows = identify(edge_docs(spark), languages(spark)).collect()
    assert len(rows) == len(edge_rows()) and {r.row["a.b"] for r in rows} == {"clash"}
    for r in rows:
        letters = any(c.isalpha() for c in r.row.text or "")
        assert (r.lang_pred != "und") == letters and (r.score > 0) == letters and bool(r.spans) == letters
    only = identify(spark.createDataFrame([(1, "… — “ 12 €")], "doc_id long, text string"), languages(spark)).first()
    assert (only.lang_pred, only.score, only.spans) == ("und", 0.0, [])


def test_empty_tables(spark):
    none = trained_on_rest(no_docs(spark))
    assert none.langs == []
    assert identify(no_docs(spark), none).count() == 0 and language_filter(no_docs(spark)).count() == 0
    rows = identify(edge_docs(spark), none).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}


def test_filter_keeps_texts_of_several_languages(spark):
    """Three languages with a third of the letters each are a language each."""
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet").select("doc_id", "text", "lang")
    by = {r.lang: r.text for r in docs.where("lang IS NOT NULL AND length(text) > 600").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    mixed = " ".join(t[:600] for _, t in sorted(by.items())[:3])
    more = docs.unionByName(spark.createDataFrame([(10**6, mixed, None), (10**6 + 1, "12 -- 34", None)], docs.schema))
    kept = {r.doc_id for r in language_filter(more).collect()}
    assert 10**6 in kept and 10**6 + 1 not in kept

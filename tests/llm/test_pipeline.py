"""The pipeline against a brute-force version of every stage."""

import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from cases import edge_docs, no_docs
from conftest import SMOKE
from corpuslens.llm.langid import BUCKETS, SWITCH, held_out, train
from corpuslens.llm.staging import staged
from test_langid import slow_viterbi
from test_neardup import brute_force as components
from test_packing import PATH, check
from test_quality import brute_force as judged
from test_secret_scan import brute_force as secret_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_of(text, model):
    """Prediction and score, word by word and gram by gram."""
    words = [m for m in re.finditer(rb"[A-Za-z\x80-\xff]+", text.encode())]
    if not any(c.isalpha() for c in text):
        return "und", 0.0
    scores = []
    for m in words:
        word = re.sub(rb"\xc3([\x80-\x96\x98-\x9e])", lambda x: bytes([0xC3, x[1][0] + 32]), m[0].lower())
        grams = [int.from_bytes(word[max(0, k - 3):k + 1], "big") for k in range(len(word))]
        grams.append(int.from_bytes(word[-3:] + b"\0", "big"))
        scores.append(sum(model.logp[(g * 2654435761 % 2**32) * BUCKETS >> 32] for g in grams))
    path = slow_viterbi(np.array(scores, np.float32), SWITCH)
    letters = [0] * len(model.langs)
    for k, m in zip(path, words):
        letters[k] += len(m[0].decode())
    return model.langs[int(np.argmax(letters))], max(letters) / sum(letters)


def test_run_equals_brute_force(spark, tmp_path):
    planted = F.concat("text", F.lit(' token = "04dbebab91ab85687d33eeaaf9ac699e"'))
    spark.read.parquet(f"{SMOKE}/documents.parquet").withColumn(
        "text", F.when(F.col("doc_id") % 10 == 0, planted).otherwise(F.col("text"))).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = train(docs.where(~held_out(docs.doc_id)))
    rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    rows = [r for r in rows if language_of(r[1] or "", model)[0] != "und"]
    rows = [r for r, keep in zip(rows, judged([(r[2], r[3], r[1]) for r in rows])[1]) if keep]
    groups = components({r[0]: r[1] for r in rows}, size=5)
    rows = [r for r in rows if groups[r[0]][1] == r[0]]
    texts = []
    for r in rows:
        out, at = [], 0
        for start, _, end in secret_spans(r[1]):
            if start >= at:
                out += [r[1][at:start], "[SECRET]"]
            at = max(at, end)
        texts.append("".join(out) + r[1][at:])
    assert any("[SECRET]" in t for t in texts) and len(rows) > 100
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    check(got, texts, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert PATH and __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_stages_keep_columns_and_take_edge_rows(spark):
    docs = edge_docs(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for table in (docs, no_docs(spark)):
            out = staged(stage(spark, table, SMOKE), f"test-{name}")
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == table.columns
            assert table is docs or out.count() == 0


def test_registered_queries():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)", n)[1]) for n in names) == list(range(1, 11))

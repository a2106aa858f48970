import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from cases import edge_docs, edge_rows, no_docs
from conftest import SMOKE
from corpuslens.llm import catalog
from corpuslens.llm.pieces import PieceModel, decode, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return PieceModel(PATH)


def ids_of(model, text):
    return list(memoryview(model.encode(text)).cast("i")) if text else []


def test_encoding_equals_the_library(model, library):
    rng = random.Random(3)
    parts = ["a", "the", " ", "   ", "▁", "\n", "\t", "é", "日本", "😀", "ing", "==", "-", "12", "\x00", "<s>", "<0x0A>", "ааа"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(1500)]
    texts += [c * n for c in " =-a" for n in range(20)] + ["ab" * 20_000, "no" + "x" * 3000]
    assert [ids_of(model, t) for t in texts] == [library.encode(t) for t in texts]


def test_decoding_equals_the_library(model, library):
    rng = random.Random(4)
    lists = [[rng.choice([rng.randrange(32000), rng.randrange(260)]) for _ in range(rng.randrange(7))] for _ in range(3000)]
    assert [model.decode(x) for x in lists] == [library.decode(x) for x in lists]


def test_units_cut_where_nothing_merges(model):
    model.memo.young.clear()
    whole = model._encode_unit(" some words  in a\nrow 12")
    assert ids_of(model, "some words  in a\nrow 12") == whole


def test_edge_rows_round_trip(spark, library):
    rows = decode(encode(edge_docs(spark), PATH), PATH).select("row.doc_id", "row.`a.b`", "ids", "text").collect()
    expect = sorted((str(i), library.encode(t or "")) for i, t, *_ in edge_rows())
    assert sorted((str(r.doc_id), list(r.ids)) for r in rows) == expect
    assert sorted(r.text for r in rows) == sorted((t or "") for _, t, *_ in edge_rows())
    assert {r["a.b"] for r in rows} == {"clash"}
    assert decode(encode(no_docs(spark), PATH), PATH).count() == 0


def test_query_digests(spark, library):
    got = {r.doc_id: r for r in catalog.QUERIES["op1_sentencepiece"](spark, SMOKE).collect()}
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.t)
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()

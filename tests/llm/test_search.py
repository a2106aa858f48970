"""Ranked lexical search against a plain version."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from cases import edge_docs, no_docs, some_docs

from corpuslens.llm import search as module
from corpuslens.llm import staging
from corpuslens.llm.catalog import QUERIES
from corpuslens.llm.search import Vocabulary, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
AZ = str.maketrans(module.UPPER, module.LOWER)


def terms(text):
    return TERM.findall((text or "").translate(AZ))


def plain(docs, items, k=10):
    bags = [(i, Counter(t), len(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    N, L = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    wanted = {}
    for i, text in items:
        wanted.setdefault(i, set()).update(terms(text))
    out = []
    for item, some in wanted.items():
        hits = []
        for i, bag, n in bags:
            m = 100 - 90 + (90 * n * N) // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m))
                        for t in some if t in bag)
            if score > 0:
                hits.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, h[3], -h[0]) for r, h in enumerate(sorted(hits, key=lambda h: h[:3])[:k])]
    return out


def check(spark, docs, items, k=10):
    got = [tuple(r) for r in search(docs, spark.createDataFrame(items, "item_id long, text string"), k).collect()]
    want = plain([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], items, k)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    return want


def test_real_documents(spark):
    items = [(i, r.text[:300]) for i, r in enumerate(some_docs(spark, 30).collect())]
    assert check(spark, some_docs(spark), items)


def test_edge_rows(spark):
    items = [(1, "SAME words, over AGAIN"), (2, "wort"), (3, None), (4, ""), (5, "?! --"), (None, "id here solo"),
             (6, "текст 日本語 é Ünïcode"), (6, "solo"), (7, "x" * 50_000), (8, "absent everywhere")]
    want = check(spark, edge_docs(spark), items)
    assert {i for i, *_ in want} == {1, 2, None, 6, 7}


def test_large_class_and_ties(spark):
    """A third of all rows are one bag; ties go by doc_id across classes."""
    rng = np.random.default_rng(1)
    rows = [(int(i), f"common word pair filler{i % 7}" if i % 3 == 0 else
             " ".join(rng.choice(["common", "word", "rare", "pair", "zulu", "kilo"], rng.integers(1, 6)))) for i in range(900)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(int(i), str(t)) for i, t in rows], "doc_id long, text string").repartition(7)
    for k in (1, 3, 10):
        check(spark, docs, [(1, "common word"), (2, "zulu kilo rare"), (3, "pair")], k)


def test_blocks_slices_and_shuffled_joins(spark, monkeypatch):
    items = [(i, r.text[:100]) for i, r in enumerate(some_docs(spark, 12).collect())]
    monkeypatch.setattr(module, "POSTINGS", 60)
    monkeypatch.setattr(module, "CELLS", 40)
    monkeypatch.setattr(staging, "SENT_ROWS", 0)
    check(spark, some_docs(spark), items)


@pytest.mark.parametrize("docs, items", [(False, True), (True, False)])
def test_empty_tables(spark, docs, items):
    d = edge_docs(spark) if docs else no_docs(spark)
    i = spark.createDataFrame([(1, "same words")] if items else [], "item_id long, text string")
    out = search(d, i)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_words_with_a_terms_hash_are_compared_in_full():
    v, order = Vocabulary.of(["alpha", "beta"])
    data = np.frombuffer(b"ALPHA gamma beta", np.uint8)
    start, end = np.array([0, 6, 12]), np.array([5, 11, 16])
    at, number = v.find(data, start, end)
    assert [(int(a), order[n]) for a, n in zip(at, number)] == [(0, "alpha"), (2, "beta")]
    v.data = np.frombuffer(b"alphabetx", np.uint8)
    assert [int(a) for a in v.find(data, start, end)[0]] == [0]


def test_query_on_the_whole_table(spark):
    path = "/root/testdata/sf0.001"
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{path}/{t}.parquet").select(*c).collect()]
    got = [tuple(r) for r in QUERIES["op13_search"](spark, path).collect()]
    assert sorted(got) == sorted(plain(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text")))

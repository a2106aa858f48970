"""Long files, hub nodes, retrieval with records, observed counts, narrow folds."""

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import graph as G
from corpuslens.operators import questions as Q
from corpuslens.operators import vectors as V
from corpuslens.plans import retrieve as R
from corpuslens.plans.ingest import index_corpus, ingest_summary, parse_corpus

CODE = "file_path string, raw_code string"
DOCS = "file_path string, raw_content string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("piece", [7, 40, 10_000])
@pytest.mark.parametrize("size", [1, 3, 8])
def test_long_texts_have_the_chunks_of_short_ones(spark, monkeypatch, piece, size):
    texts = {"a": "one two, three\n\nfour(five) six\tseven " * 9, "b": "", "c": None, "d": "x" * 300 + " y", "e": " \n ",
             "f": "日本語 текст é_1 " * 20 + "\r\n\x0b\x0c end", "g": ",.;" * 40}
    df = spark.createDataFrame(list(texts.items()), "k string, text string")
    want = sorted(tuple(r) for r in V.chunk_tokens(df, "text", ["k"], size).collect())
    counts = {r.k: r.n_chunks for r in V.chunk_counts(df, "text", ["k"], size).collect()}
    monkeypatch.setattr(V, "PIECE_CHARS", piece)
    assert sorted(tuple(r) for r in V.chunk_tokens(df, "text", ["k"], size).collect()) == want
    got = {r.k: r.n_chunks for r in V.chunk_counts(df, "text", ["k"], size).collect()}
    assert {k: n for k, n in got.items() if n} == {k: n for k, n in counts.items() if n}
    assert {k: n for k, n in got.items() if n} == {k: sum(r[0] == k for r in want) for k in {r[0] for r in want}}


def _corpus(spark, monkeypatch=None):
    code = [(f"m{i}.py", f"class Reader:\n    def load(self):\n        return parse()\ndef load():\n    return f{i}()\ndef f{i}():\n    return load()\n")
            for i in range(6)] + [("broken.py", "def :")]
    docs = [("a.md", "# Title A\nloading files"), ("b.md", "no heading")]
    return spark.createDataFrame(code, CODE), spark.createDataFrame(docs, DOCS)


def test_counts_are_observed_while_writing(spark):
    code, docs = _corpus(spark)
    parsed = parse_corpus(code, docs)
    assert parsed.counts == {"code": 6, "doc": 2} and parsed.code_bad.count() == 1
    plan = _plan(ingest_summary(spark, parsed))
    assert "Aggregate" not in plan and "Scan parquet" not in plan
    assert sorted(tuple(r) for r in ingest_summary(spark, parsed).collect()) == [("code", 6), ("doc", 2)]


def test_folds_aggregate_longs_only(spark):
    """No sort aggregate, and docstrings are shuffled for the join only."""
    code, docs = _corpus(spark)
    nodes, edges, _ = G.build_graph(parse_corpus(code, docs).code_files)
    for df in (nodes, edges):
        plan = _plan(df)
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
        aggregates = [line for line in plan.splitlines() if "HashAggregate(" in line]
        assert aggregates and not any("docstring" in line for line in aggregates)


def test_neighbour_rows_of_a_hub(spark):
    code, docs = _corpus(spark)
    nodes, edges, _ = G.build_graph(parse_corpus(code, docs).code_files)
    rows = Q.neighbour_rows(nodes.select("name").unionByName(nodes.select("name")), edges).collect()
    hub = sorted((r.place, r.callee) for r in rows if r.name == "load")
    assert hub == [(1, "f0"), (2, "parse"), (3, "f1"), (4, "f2"), (5, "f3"), (6, "f4"), (7, "f5")]
    assert [(r.place, r.callee) for r in rows if r.name == "parse"] == [(None, None)]
    assert len(rows) == 7 + 6 + 2  # the hub, f0..f5, and two names without callees


def test_related_and_records(spark):
    code, docs = _corpus(spark)
    idx = index_corpus(code, docs, embedder=V.HashedEmbedder(dim=16))
    files = spark.createDataFrame([("m3.py",), ("m3.py",), ("none.py",)], "file_path string")
    got = sorted(tuple(r) for r in R.related(files, idx, most=3).collect())
    assert got == [("m3.py", "callee", 1, "load", "f0"), ("m3.py", "callee", 2, "load", "parse"), ("m3.py", "callee", 3, "load", "f1"),
                   ("m3.py", "caller", 1, "load", "f0"), ("m3.py", "caller", 2, "load", "f1"), ("m3.py", "caller", 3, "load", "f2")]
    full = [tuple(r)[1:] for r in R.related(files, idx, most=99).collect()]
    assert {("callee", "f3", "load"), ("caller", "f3", "load")} <= {(a, c, d) for a, _, c, d in full}
    qs = spark.createDataFrame([(1, "loading files"), (2, "class Reader load parse")], "query_id long, query_text string")
    hits = R.retrieve_records(qs, idx, V.HashedEmbedder(dim=16), k=3, most=2).collect()
    assert len(hits) == 6
    first = {r.query_id: r for r in hits if r["rank"] == 1}
    assert first[1].kind == "doc" and first[1].title == "Title A" and first[1].related is None
    for r in hits:
        if r.kind == "code":
            assert r.title == "Reader" and "class Reader" in r.content and len(r.related) == 4
        elif r.file_path == "b.md":
            assert r.title is None and r.content == "no heading"


def test_strict_call_lines(spark):
    code, docs = _corpus(spark)
    nodes, edges, sites = G.build_graph(parse_corpus(code, docs).code_files)
    pairs = spark.createDataFrame([("load", "parse"), ("load", "nothing")], "src string, dst string")
    got = {(r.dst, r.has_edge, r.line_number) for r in G.call_lines(sites, edges, pairs, strict=True).collect()}
    assert got == {("parse", True, None), ("nothing", False, None)}
    assert G.call_lines(sites, edges, pairs).filter(F.col("has_edge")).count() == 6

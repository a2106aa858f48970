"""Scale of the parse, the search, the graph folds, the question routes and the tree scan."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpuslens.operators import code as C
from corpuslens.operators import graph as G
from corpuslens.operators import vectors as V
from corpuslens.plans import ingest as I
from corpuslens.plans.q_questions import routed
from corpuslens.sources.srcfiles import read_sources

SMOKE = "/root/testdata/sf0.001"


def test_parse_holds_few_files_at_once():
    n = 3 * C.PARSED_FILES + 1
    rb = pa.RecordBatch.from_pydict({"file_path": [f"{k}.py" for k in range(n)], "raw_code": ["def f():\n    g()\n"] * n})
    sizes = [b.num_rows for b in C._parse_batches([rb])]
    assert max(sizes) <= C.PARSED_FILES and sum(sizes) == n


def test_lone_surrogates_are_quarantined_and_plain_escapes_are_not():
    texts = ['def f():\n    "\\ud800"\n', 'def f():\n    "\\n"\n', 'def f():\n    "é"\n']
    rb = pa.RecordBatch.from_pydict({"file_path": ["a", "b", "c"], "raw_code": texts})
    errors = [e for b in C._parse_batches([rb]) for e in b.column("error").to_pylist()]
    assert errors[0].startswith("UnicodeEncodeError") and errors[1:] == [None, None]


def test_embedder_counts_few_rows_at_once():
    n = 2 * V.COUNTED_ROWS + 1
    rb = pa.RecordBatch.from_pydict({"k": list(range(n)), "_buckets": [[k % 4] for k in range(n)]})
    out = list(V._bucket_counts_fn(4, "embedding", ["k", "embedding"])([rb]))
    assert max(b.num_rows for b in out) <= V.COUNTED_ROWS
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["k"] for r in rows] == list(range(n)) and all(r["embedding"][r["k"] % 4] == 1 for r in rows)


def test_later_blocks_take_exact_distances_of_few(monkeypatch):
    rng = np.random.default_rng(4)
    vectors, queries = rng.standard_normal((6000, 8)), rng.standard_normal((40, 8))
    exact, seen = V._exact, []
    monkeypatch.setattr(V, "_exact", lambda v, q, rows, cols: seen.append(len(rows)) or exact(v, q, rows, cols))
    for decimals in (None, 3):
        cell = V._Cell(8, 5, decimals, False)
        cell.queries = (np.arange(40), queries, None)
        offsets = pa.array(np.arange(0, vectors.size + 1, 8, dtype=np.int32))
        rb = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel())), pa.array(np.arange(6000))],
                                        ["vec", "embedding_id"])
        cell.add_vectors(rb)
        key = V._rank_key(((vectors[None] - queries[:, None]) ** 2).sum(axis=2), decimals)
        want = [np.lexsort((np.arange(6000), k))[:5].tolist() for k in key]
        assert cell.best[1].reshape(40, 5).tolist() == want
    assert sum(seen) < 0.05 * vectors.shape[0] * queries.shape[0]


def test_equal_queries_are_searched_once_and_all_answered(spark):
    vec = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(20)], "embedding_id long, embedding array<double>")
    qs = spark.createDataFrame([(f"q{k}", [float(k % 2), -0.0 if k % 4 else 0.0]) for k in range(40)],
                               "query_id string, embedding array<double>")
    res = V.knn(vec, qs, k=3)
    got = {}
    for r in res.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.embedding_id)
    assert got == {f"q{k}": [[0, 1, 2], [1, 0, 2]][k % 2] for k in range(40)}
    # a query id that comes twice has one answer, of all its pairs, as before
    twice = V.knn(vec, qs.filter("query_id = 'q0'").union(qs.filter("query_id = 'q0'")), k=3).orderBy("rank").collect()
    assert [(r.embedding_id, r["rank"]) for r in twice] == [(0, 1), (0, 2), (1, 3)]


def test_route_filters_do_not_read_replies_again(spark):
    plan = routed(spark, SMOKE).filter(F.col("route") == "code")._jdf.queryExecution().optimizedPlan().toString()
    assert "json" not in plan.lower()


def test_index_builds_its_graph_when_asked(spark, monkeypatch):
    built = []
    monkeypatch.setattr(I.G, "build_graph", lambda files, real=G.build_graph: built.append(1) or real(files))
    code = spark.createDataFrame([("a.py", "def f():\n    g()\n")], "file_path string, raw_code string")
    docs = spark.createDataFrame([("a.md", "# a\n")], "file_path string, raw_content string")
    idx = I.index_corpus(code, docs, embedder=V.HashedEmbedder(8))
    assert idx.vectors.count() == 2 and not built
    assert {r.name for r in idx.nodes.collect()} == {"f", "g"} and idx.edges.count() == 1 and len(built) == 1


def test_folds_shuffle_no_docstring(spark, monkeypatch):
    """Only names meet the file numbers."""
    plans = []
    monkeypatch.setattr(G, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    code, _ = C.parse_code(spark.createDataFrame([("a.py", "def f():\n    'x'\n    g()\n")], "file_path string, raw_code string"))
    row = G.build_nodes(code).filter("name = 'f'").first()
    assert (row["type"], row.docstring, row.file_path, row.line_number) == ("function", "x", "a.py", 1)
    below = plans[-1][plans[-1].index("Aggregate [name"):]
    assert "docstring" not in below.split("MapInArrow")[0]


def test_tree_files_are_read_once(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.md").write_bytes(b"\xff")
    files, bad = read_sources(spark, str(tmp_path))
    (tmp_path / "a.py").write_text("y = 2\n")
    (tmp_path / "b.md").write_text("now valid\n")
    assert [r.text for r in files.collect()] == ["x = 1\n"]
    assert [r.error for r in bad.collect()] == ["invalid UTF-8"]

"""Incremental ingest over two arrivals equals one full rebuild."""

import os
import time

from pyspark.sql import functions as F

from corpuslens.plans.ingest import index_corpus, split_sources
from corpuslens.sources.srcfiles import read_sources
from corpuslens.sources.store import TableStore
from corpuslens.sources.srcfiles import register
from corpuslens.streaming import apply_batch, graph_tables, incremental, start_incremental_ingest

FILES_1 = {
    "a/m1.py": "def f():\n    g()\n    h()\n",
    "a/__init__.py": "def g():\n    pass\n",
    "a/readme.md": "# Intro\nsee `pkg.x`\n",
}
FILES_2 = {
    "b/m2.py": "def h():\n    g()\nclass K(Base):\n    pass\n",
    "b/.hidden.py": "def f():\n    k()\n",
    "b/guide.md": "## Guide\n[api](http://x/api)\n",
}


def _write(root, files):
    for rel, text in files.items():
        path = os.path.join(root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as fh:
            fh.write(text)
    time.sleep(0.05)


def _nodes(df):
    return sorted((r["name"], r["type"], r["file_path"], r["line_number"]) for r in df.collect())


def _edges(df):
    return sorted((r["src"], r["dst"], r["n_calls"], r["first_file"], r["first_seq"]) for r in df.collect())


def test_incremental_equals_rebuild(spark, tmp_path):
    tree = str(tmp_path / "tree")
    store = TableStore(spark, str(tmp_path / "store"))
    ckpt = str(tmp_path / "ckpt")
    _write(tree, FILES_1)
    start_incremental_ingest(spark, tree, store, ckpt).awaitTermination()
    _write(tree, FILES_2)
    start_incremental_ingest(spark, tree, store, ckpt).awaitTermination()

    files, _ = read_sources(spark, tree)
    code, docs, _ = split_sources(files)
    full = index_corpus(code, docs)
    nodes, edges = graph_tables(store)
    assert _nodes(nodes) == _nodes(full.nodes)
    assert _edges(edges) == _edges(full.edges)
    assert store.read("code_files").count() == 4 and store.read("doc_files").count() == 2
    ids = sorted(r["embedding_id"] for r in store.read("vectors").select("embedding_id").collect())
    assert ids == list(range(len(ids)))
    want = sorted((r["file_path"], r["embedding_id"]) for r in full.vectors.collect())
    got = sorted((r["file_path"], r["embedding_id"]) for r in store.read("vectors").collect())
    assert got == want
    assert store.read("vectors").filter(F.col("kind") == "doc").count() == 2


def test_replayed_batch_is_idempotent(spark, tmp_path):
    tree = str(tmp_path / "tree")
    store = TableStore(spark, str(tmp_path / "store"))
    ckpt = str(tmp_path / "ckpt")
    _write(tree, FILES_1)
    start_incremental_ingest(spark, tree, store, ckpt).awaitTermination()
    _write(tree, FILES_2)
    start_incremental_ingest(spark, tree, store, ckpt).awaitTermination()

    def snapshot():
        nodes, edges = graph_tables(store)
        return (_nodes(nodes), sorted(tuple(r) for r in edges.collect()),
                sorted((r["file_path"], r["embedding_id"]) for r in store.read("vectors").collect()),
                store.read("code_files").count(), store.read("edge_calls").count())

    before = snapshot()
    register(spark)
    raw = spark.read.format("srcfiles").load(tree).filter(F.col("path").contains("/b/"))
    apply_batch(store, raw, 1)          # the second batch, delivered again
    assert snapshot() == before


def test_folds_are_merged_in_steps(spark, tmp_path, monkeypatch):
    """Many batches: each appends its own fold, stored folds are merged level by
    level, and the graph equals that of all files at once."""
    monkeypatch.setattr(incremental, "FAN", 2)
    store = TableStore(spark, str(tmp_path / "store"))
    sources = [(f"m{i}.py", f"def shared():\n    f{i}()\n    common()\ndef f{i % 3}():\n    shared()\n") for i in range(7)]
    for i, (path, text) in enumerate(sources):
        raw = spark.createDataFrame([(path, bytearray(text, "utf-8"), len(text))], "path string, content binary, size long")
        apply_batch(store, raw, i)
    assert incremental._cover(store, "node_folds") == [(2, 0, 3), (1, 4, 5), (0, 6, 6)]
    full = index_corpus(spark.createDataFrame(sources, "file_path string, raw_code string"),
                        spark.createDataFrame([], "file_path string, raw_content string"))
    nodes, edges = graph_tables(store)
    assert _nodes(nodes) == _nodes(full.nodes)
    assert _edges(edges) == _edges(full.edges)


def test_listing_split_between_driver_and_executors(spark, tmp_path):
    tree = str(tmp_path / "t")
    files = {f"d{i}/sub{j}/m{k}.py": "x = 1\n" for i in range(3) for j in range(3) for k in range(2)}
    files.update({"top.py": "y = 2\n", "_hid/__init__.py": "", "d0/.h.md": "# h\n", "d1/x.PY": ""})
    _write(tree, files)
    register(spark)
    for want in (1, 2, 4, 100):
        df = (spark.read.format("srcfiles").option("listingPartitions", str(want)).load(tree))
        got = sorted(r["path"][len(tree) + 1:] for r in df.select("path").collect())
        assert got == sorted(k for k in files if not k.endswith(".PY")), want
    missing = spark.read.format("srcfiles").load(str(tmp_path / "nope"))
    assert missing.count() == 0

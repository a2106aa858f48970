"""Cases behind wrong answers that clean tables do not reach."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import code as C
from corpuslens.operators import questions as Q
from corpuslens.operators import vectors as V

VEC = "embedding_id long, embedding array<float>"


def _knn(spark, rows, queries, **kw):
    v = spark.createDataFrame(rows, VEC)
    q = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    got = {}
    for r in V.knn(v, q, **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.embedding_id)
    return got


def test_knn_skips_dirty_vectors_and_loses_no_clean_one(spark):
    rows = [(k, [float(k), 0.0]) for k in range(4)]
    dirty = [(10, [math.nan, 0.0]), (11, [1.0]), (12, None), (13, [1.0, None]), (14, [math.inf, 0.0])]
    assert _knn(spark, rows + dirty, [(1, [0.0, 0.0])], k=5) == {1: [0, 1, 2, 3]}
    assert _knn(spark, dirty, [(1, [0.0, 0.0])], k=5) == {}
    assert _knn(spark, rows, [(1, [0.0, 0.0]), (2, [math.nan, 0.0])], k=1) == {1: [0]}


def test_rounded_ties_go_to_the_lower_id(spark):
    assert _knn(spark, [(9, [1e-7]), (3, [2e-7])], [(1, [0.0])], k=1, rank_decimals=9) == {1: [3]}


def test_knn_grid_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    V_, Q_ = rng.normal(size=(300, 6)).astype(np.float32), rng.normal(size=(40, 6)).astype(np.float32)
    label = rng.integers(0, 4, 300), rng.integers(0, 4, 40)
    v = spark.createDataFrame([(k, x.tolist(), int(c)) for k, (x, c) in enumerate(zip(V_, label[0]))], VEC + ", label int")
    q = spark.createDataFrame([(k, x.tolist(), int(c)) for k, (x, c) in enumerate(zip(Q_, label[1]))],
                              "query_id long, embedding array<float>, label int")
    dist = ((Q_[:, None].astype(float) - V_[None].astype(float)) ** 2).sum(axis=2)
    for same in (None, ("label", "label")):
        for blocks in ({}, {"max_block_bytes": 500, "vector_block_bytes": 900}):
            got = {}
            for r in V.knn(v, q, k=5, same_class=same, **blocks).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append(r.embedding_id)
            for k in range(40):
                d = np.where(label[0] == label[1][k], dist[k], np.inf) if same else dist[k]
                assert got[k] == np.argsort(d, kind="stable")[:5].tolist()


def test_vector_check_refuses_infinity(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [math.inf, 0.0]), (3, [-math.inf, 0.0]), (4, [math.nan, 0.0])], VEC)
    assert tuple(V.check_vectors(df, 2).first()) == (4, 3)


def test_lone_surrogate_is_quarantined(spark):
    files = [("a.py", 'def f():\n    "\\ud800"\n'), ("b.py", "def g(): pass\n"), ("c.py", 'x = "\\ud800"\n')]
    good, bad = C.parse_code(spark.createDataFrame(files, "file_path string, raw_code string"))
    assert sorted(r.file_path for r in good.collect()) == ["b.py", "c.py"]
    assert [r.file_path for r in bad.collect()] == ["a.py"]


FULL = '{"functions": ["f"], "modules": [], "classification": "Code-related"}'


@pytest.mark.parametrize("reply, usable", [
    (FULL, True), ("  " + FULL + "\n", True), (FULL + " see {x}", False), (FULL + "{}", False), (FULL + " }", False),
    (FULL.replace('"f"', '"a } { ] b"'), True), (FULL.replace('"f"', r'"a\"}{"'), True), ("[" + FULL + "]", False),
    ('{"functions": [{"a": [1, {}]}], "modules": [], "classification": "x"}', True),
])
def test_reply_is_one_json_object(spark, reply, usable):
    df = spark.createDataFrame([(reply,)], "r string")
    assert df.select(F.coalesce(Q._json_object(F.col("r")), F.lit(False))).first()[0] == usable


def test_append_adds_columns_and_refuses_other_types(spark, tmp_path):
    from corpuslens.sources.store import TableStore
    st = TableStore(spark, str(tmp_path / "s"))
    st.append("t", spark.createDataFrame([(1,)], "x int"))
    st.append("t", spark.createDataFrame([(2, "y")], "x int, more string"))
    st.append("t", spark.createDataFrame([(3,)], "x int"))
    assert sorted(tuple(r) for r in st.read("t").collect()) == [(1, None), (2, "y"), (3, None)]
    with pytest.raises(ValueError):
        st.append("t", spark.createDataFrame([("z",)], "x string"))


def test_metadata_insert_find_update_delete(spark, tmp_path):
    from corpuslens.operators import metadata as M
    from corpuslens.sources.store import TableStore
    st = TableStore(spark, str(tmp_path / "m"))
    rows = spark.createDataFrame([("f", "p.py", "api", 3), ("g", "p.py", None, 4)],
                                 "function_name string, file_path string, api_reference string, size int")
    assert M.insert_metadata(st, "metadata", rows.coalesce(1)) == 2
    assert M.insert_one(st, "metadata", {"function_name": "h", "file_path": "q.py", "api_reference": "x", "owner": "me"}) == 1
    with pytest.raises(ValueError):
        M.insert_metadata(st, "metadata", rows.drop("file_path"))
    df = st.read("metadata")
    assert df.columns == ["_seq", "function_name", "file_path", "api_reference", "extra"]
    assert M.find_one(df, {"file_path": "p.py"}).first().function_name == "f"
    assert M.find_one(df, {"owner": "me"}).first().function_name == "h"
    assert M.count(df, {"owner": None}) == 2 and M.count(df, {"size": 4}) == 1
    st.write("metadata", M.update(df, {"file_path": "p.py"}, {"api_reference": "new", "owner": "you"}))
    got = {r.function_name: (r.api_reference, r.extra) for r in st.read("metadata").collect()}
    assert got["f"] == ("new", {"size": "3", "owner": "you"}) and got["g"] == (None, {"size": "4"})
    assert sorted(r.function_name for r in M.delete(st.read("metadata"), {"owner": "you"}).collect()) == ["g", "h"]
    everything = M.find_everywhere({"metadata": df, "other": rows})
    assert everything.count() == 5 and M.find_everywhere({"metadata": df, "other": rows}, {"size": 4}).count() == 2


def test_late_file_with_an_old_time_is_read_once(spark, tmp_path):
    import os
    from corpuslens.sources.store import TableStore
    from corpuslens.streaming import start_incremental_ingest
    tree, store, ckpt = tmp_path / "tree", TableStore(spark, str(tmp_path / "store")), str(tmp_path / "ckpt")
    tree.mkdir()
    for round_, name in enumerate(["m.py", "z.py", "a.py"]):
        (tree / name).write_text("def f(): pass\n")
        os.utime(tree / name, (1_000_000 - round_, 1_000_000 - round_))  # each older than those before
        start_incremental_ingest(spark, str(tree), store, ckpt).awaitTermination()
    got = sorted(r.file_path.rsplit("/", 1)[1] for r in store.read("code_files").collect())
    assert got == ["a.py", "m.py", "z.py"]


def test_many_small_directories_make_few_tasks(spark, tmp_path):
    from corpuslens.sources import srcfiles
    for k in range(1000):
        (tmp_path / f"d{k:04d}").mkdir()
        (tmp_path / f"d{k:04d}" / "m.py").write_text("x = 1\n")
    reader = srcfiles.SourceFilesReader({"path": str(tmp_path), "listingPartitions": "50"})
    parts = reader.partitions()
    assert len(parts) <= 50
    assert sorted(r[0] for p in parts for r in reader.read(p)) == sorted(str(p) for p in tmp_path.glob("*/m.py"))
    files, dirs = srcfiles.expand_tree(str(tmp_path), (".py",), 10_000, 1100)
    assert len(files) <= 150 and len(files) + len(dirs) == 1000  # the budget holds within a level


def test_index_is_parsed_once_and_read_in_part(spark):
    from corpuslens.operators import vectors as V_
    from corpuslens.plans.ingest import index_corpus
    code = spark.createDataFrame([("a.py", "def f(): g()\n"), ("b.py", "x = (\n")], "file_path string, raw_code string")
    docs = spark.createDataFrame([("a.md", "# A\n")], "file_path string, raw_content string")
    idx = index_corpus(code, docs, embedder=V_.HashedEmbedder(dim=8))
    plan = lambda df: df._jdf.queryExecution().toString()
    for table in idx.tables().values():
        assert "MapInArrow" not in plan(table)  # parsed and embedded once, then staged
    keys = plan(idx.vectors.filter("kind = 'code'").select("embedding_id"))
    assert "PartitionFilters: [isnotnull(kind" in keys and "ReadSchema: struct<embedding_id:bigint>" in keys
    read = plan(idx.code_base.select("file_path")).rpartition("ReadSchema:")[2]
    assert "file_path" in read and "raw_code" not in read
    assert [r.file_path for r in idx.quarantine.collect()] == ["b.py"]


def test_lookups_keep_the_large_table_off_the_outer_side(spark):
    import re
    from corpuslens.operators import graph as G
    code, _ = C.parse_code(spark.createDataFrame([("a.py", "def f():\n    g()\n    g()\n")], "file_path string, raw_code string"))
    nodes, edges, sites = G.build_graph(code)
    probes = spark.createDataFrame([("f",), ("nosuch",), (None,)], "name string")
    for df in (G.callees(edges, nodes, probes), G.callers(edges, nodes, probes), G.exists(nodes, probes), G.node_file(nodes, probes)):
        assert not re.search("LeftOuter", df._jdf.queryExecution().toString())
    got = {(r.name, r.known, r.callee) for r in G.callees(edges, nodes, probes).collect()}
    assert got == {("f", True, "g"), ("nosuch", False, None), (None, False, None)}

"""Graph fold equals a sequential, in-place model of the reference's update
rules on random corpora (first writer wins for attributes, last call sets
the file, call lines appended in arrival order)."""

import random

from pyspark.sql import functions as F

from corpuslens.operators import graph as G


def _sequential(files):
    nodes, edges, order = {}, {}, {}
    for path, ents, calls in sorted(files):
        for e in ents:
            if e["name"] not in nodes:
                nodes[e["name"]] = dict(e)
        for c in calls:
            for end in (c["caller"], c["callee"]):
                nodes.setdefault(end, {"name": end, "file_path": path})
                nodes[end]["file_path"] = path
            key = (c["caller"], c["callee"])
            edges.setdefault(key, []).append(c["line_number"])
    return nodes, edges


def _random_files(seed):
    rnd = random.Random(seed)
    names = [f"n{i}" for i in range(8)]
    files = []
    for f in range(6):
        path = f"p/{f:02d}.py"
        ents = [{"name": rnd.choice(names), "type": rnd.choice(["function", "class"]),
                 "file_path": path, "line_number": rnd.randint(1, 50), "docstring": rnd.choice([None, "d"]),
                 "decorators": [], "parents": []} for _ in range(rnd.randint(0, 4))]
        calls = [{"caller": rnd.choice(names), "callee": rnd.choice(names), "file_path": path,
                  "line_number": rnd.randint(1, 50)} for _ in range(rnd.randint(0, 6))]
        files.append((path, ents, calls))
    return files


SCHEMA = ("file_path string, entities array<struct<name:string,type:string,file_path:string,"
          "line_number:int,docstring:string,decorators:array<string>,parents:array<string>>>, "
          "function_calls array<struct<caller:string,callee:string,file_path:string,line_number:int>>")


def test_fold_equals_sequential_model(spark):
    for seed in range(8):
        files = _random_files(seed)
        df = spark.createDataFrame([(p, e, c) for p, e, c in files], SCHEMA)
        nodes, edges, sites = G.build_graph(df)
        want_nodes, want_edges = _sequential(files)
        got = {r["name"]: r for r in nodes.collect()}
        assert set(got) == set(want_nodes), seed
        for name, w in want_nodes.items():
            g = got[name]
            assert g["file_path"] == w["file_path"], (seed, name)
            assert g["type"] == w.get("type"), (seed, name)
            assert g["line_number"] == w.get("line_number"), (seed, name)
        lines = {}
        for r in sites.orderBy("ord").collect():
            lines.setdefault((r["src"], r["dst"]), []).append(r["line_number"])
        assert lines == want_edges, seed
        assert {(r["src"], r["dst"]): r["n_calls"] for r in edges.collect()} == \
               {k: len(v) for k, v in want_edges.items()}


def test_lookups_and_add_edge(spark):
    files = [("a.py", [{"name": "f", "type": "function", "file_path": "a.py", "line_number": 1,
                        "docstring": None, "decorators": [], "parents": []}],
              [{"caller": "f", "callee": "g", "file_path": "a.py", "line_number": 2},
               {"caller": "f", "callee": "g", "file_path": "a.py", "line_number": 3},
               {"caller": "f", "callee": "h", "file_path": "a.py", "line_number": 4}])]
    df = spark.createDataFrame(files, SCHEMA)
    nodes, edges, sites = G.build_graph(df)
    probes = spark.createDataFrame([("f",), ("g",), ("zz",)], "name string")
    ex = {r["name"]: r["exists"] for r in G.exists(nodes, probes).collect()}
    assert ex == {"f": True, "g": True, "zz": False}
    succ = G.callees(edges, nodes, probes).filter(F.col("name") == "f").orderBy("first_seq").collect()
    assert [r["callee"] for r in succ] == ["g", "h"]
    pred = G.callers(edges, nodes, probes).filter(F.col("name") == "g").collect()
    assert [r["caller"] for r in pred] == ["f"]
    pairs = spark.createDataFrame([("f", "g"), ("g", "f"), ("x", "y")], "src string, dst string")
    cl = G.call_lines(sites, edges, pairs).orderBy("src", "dst", "seq").collect()
    assert [(r["src"], r["dst"], r["has_edge"], r["line_number"]) for r in cl] == [
        ("f", "g", True, 2), ("f", "g", True, 3), ("g", "f", False, None), ("x", "y", False, None)]
    strict = G.call_lines(sites, edges, pairs, strict=True).filter("src = 'f'").collect()
    assert [(r["has_edge"], r["line_number"]) for r in strict] == [(True, None)]
    n2, e2 = G.add_edges(nodes, edges, pairs)
    assert {(r["src"], r["dst"]): r["n_calls"] for r in e2.collect()} == {
        ("f", "g"): 2, ("f", "h"): 1, ("g", "f"): 0, ("x", "y"): 0}
    assert sorted(r["name"] for r in n2.collect()) == ["f", "g", "h", "x", "y"]
    ff = {r["name"]: r["file_path"] for r in G.node_file(nodes, probes).collect()}
    assert ff == {"f": "a.py", "g": "a.py", "zz": None}


def test_single_name_api(spark):
    files = [("a.py", [{"name": "f", "type": "function", "file_path": "a.py", "line_number": 1,
                        "docstring": None, "decorators": [], "parents": []}],
              [{"caller": "f", "callee": "h", "file_path": "a.py", "line_number": 2},
               {"caller": "f", "callee": "g", "file_path": "a.py", "line_number": 3},
               {"caller": "f", "callee": "h", "file_path": "a.py", "line_number": 4}])]
    nodes, edges, sites = G.build_graph(spark.createDataFrame(files, SCHEMA))
    g = G.CodeGraph(nodes, edges, sites)
    rows = lambda df: [r[0] for r in df.collect()]
    assert rows(g.get_callees("f")) == ["h", "g"]
    assert rows(g.get_callers("g")) == ["f"]
    assert rows(g.get_call_line_number("f", "h")) == [2, 4]
    assert rows(g.get_call_line_number("f", "h", strict=True)) == []
    assert g.get_call_line_number("h", "f") is None
    assert g.get_function_file("g") == "a.py" and g.get_function_file("zz") is None
    try:
        g.get_dependencies("zz")
        raise AssertionError("expected KeyError")
    except KeyError:
        pass
    g2 = g.add_dependency("g", "new")
    assert rows(g2.get_callees("g")) == ["new"] and g2.entity_exists("new")

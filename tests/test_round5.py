"""Parsing in processes of its own; walks and counts that read each file once."""

import os
import sys

import pyarrow as pa
import pytest

from corpuslens.operators import code as C
from corpuslens.plans import q_graph, q_meta

SMOKE = "/root/testdata/sf0.001"


def _batch(texts):
    return pa.RecordBatch.from_arrays([pa.array([f"{i}.py" for i in range(len(texts))]), pa.array(texts)], names=["file_path", "raw_code"])


def test_parsing_keeps_no_identifiers():
    """The parser's names are interned for good, so they must not stay in the task's process."""
    rb = _batch([f"def once_{i}():\n    meets_{i}()\n" for i in range(1000)])
    before = sys.getunicodeinternedsize()
    rows = [r for b in C._parse_batches([rb, rb.slice(0, 0), rb]) for r in b.to_pylist()]
    assert sys.getunicodeinternedsize() - before < 1000  # those of modules imported meanwhile; there are 2,000 names
    assert len(rows) == 2000 and rows[1999]["file_path"] == "999.py" and rows[1999]["raw_code"] == rb.column(1)[999].as_py()
    assert [(c["caller"], c["callee"]) for r in rows[:3] for c in r["function_calls"]] == [(f"once_{i}", f"meets_{i}") for i in range(3)]


def test_a_parsing_process_that_dies_fails_the_task(monkeypatch):
    monkeypatch.setattr(C, "extract_python", lambda path, text: os._exit(3))
    with pytest.raises(RuntimeError, match="exit code 3"):
        list(C._parse_batches([_batch(["x = 1\n"])]))


def test_parsing_ends_with_its_reader():
    read = C._parse_batches([_batch(["x = 1\n"] * (3 * C.PARSED_FILES))])
    assert next(read).num_rows == C.PARSED_FILES
    read.close()  # neither waits nor leaves a process


def _parses_of(spark, monkeypatch, build, module, column):
    """How many parses the plan staged with ``column`` holds, and its columns."""
    seen = []
    real = module.materialize
    monkeypatch.setattr(module, "materialize", lambda df: seen.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())) or real(df))
    build()
    return [(cols, plan.count("MapInArrow")) for cols, plan in seen if column in cols]


def test_keys_parse_each_file_once(spark, monkeypatch):
    staged = _parses_of(spark, monkeypatch, lambda: q_meta.dense_ids(spark, SMOKE), q_meta, "file_path")
    assert staged == [(["file_path", "raw_code"], 1), (["file_path", "n_chunks"], 0)]


def test_graph_queries_stage_no_texts(spark, monkeypatch):
    staged = _parses_of(spark, monkeypatch, lambda: q_graph.function_file(spark, SMOKE), q_graph, "entities")
    assert staged == [(["file_path", "entities", "function_calls"], 1)]

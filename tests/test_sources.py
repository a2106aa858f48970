"""Dispatch by true extension equals os.path.splitext (A3)."""

import os

from pyspark.sql import functions as F

from corpuslens.plans.ingest import split_sources
from corpuslens.sources import srcfiles
from corpuslens.sources.srcfiles import list_sources, read_listed, read_sources

NAMES = ["a.py", ".py", "..py", "a.b.py", ".c.py", "x.PY", "dir.d/file", "a.", "a..py",
         "_priv/e.py", ".hid/d.py", "sub/b.md", "sub/.md", "n.md.py", "pkg.v2/mod", "noext"]


def test_dispatch_matches_splitext(spark):
    df = spark.createDataFrame([(n, "") for n in NAMES], "path string, text string")
    code, docs, skipped = split_sources(df)
    got = {r["file_path"]: "code" for r in code.collect()}
    got.update({r["file_path"]: "doc" for r in docs.collect()})
    got.update({r["file_path"]: "skip" for r in skipped.collect()})
    want = {}
    for n in NAMES:
        ext = os.path.splitext(n)[1]
        want[n] = {".py": "code", ".md": "doc"}.get(ext, "skip")
    assert got == want


def test_flat_directory_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """Listed by executors, then dealt by bytes: no task reads much more than its
    share, though one directory holds nearly all files."""
    monkeypatch.setattr(srcfiles, "OPEN_COST", 100)
    flat = tmp_path / "tree" / "flat"
    flat.mkdir(parents=True)
    (tmp_path / "tree" / "top.md").write_text("# t")
    for k in range(300):
        (flat / f"m{k:03d}.py").write_text("x = 1\n" * (1 + 40 * (k % 10 == 0)))
    listed = list_sources(spark, str(tmp_path / "tree"), listingPartitions="1")
    assert listed.columns == ["path", "size"] and listed.count() == 301
    raw = read_listed(listed, str(tmp_path / "tree"), partition_bytes=2000)
    per_task = [r.n for r in raw.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(F.col("size") + 100).alias("n")).collect()]
    assert len(per_task) >= 8 and max(per_task) <= 5 * 2000
    rows = {r.path: (bytes(r.content), r.size) for r in raw.collect()}
    assert len(rows) == 301 and all(len(c) == n for c, n in rows.values())
    assert rows[str(flat / "m010.py")][0] == b"x = 1\n" * 41


def test_missing_and_empty_trees(spark, tmp_path):
    for root in (tmp_path / "nope", tmp_path):
        files, bad = read_sources(spark, str(root))
        assert files.count() == 0 and bad.count() == 0 and files.columns == ["path", "text"]

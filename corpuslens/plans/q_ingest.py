"""Registered query for the file-tree scan and dispatch (A1-A4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.srcfiles import read_sources
from .corpora import MD_PAGES_SQL, PY_PARTS_SQL, md_pages, py_parts, with_ctes
from .ingest import parse_corpus, split_sources
from .registry import register
from .tree import write_tree

def corpus_tree(spark, sf):
    """Files for every part and page, laid out with the names the scan must
    handle: parts whose size ends in 0 go under ``_priv/``, 1 become hidden
    ``.h_*.py`` files, 2 get an upper-case ``.PY`` (not matched), 3 become a
    file named just ``.py`` (matched, no parser), 4 carry an invalid UTF-8
    byte; the rest are plain modules."""
    code = py_parts(spark, sf)
    k = F.lpad(F.col("p_partkey").cast("string"), 8, "0")
    r = F.col("p_size") % 10
    rel = (F.when(r == 0, F.concat(F.lit("src/_priv/part_"), k, F.lit(".py")))
            .when(r == 1, F.concat(F.lit("src/.h_part_"), k, F.lit(".py")))
            .when(r == 2, F.concat(F.lit("src/part_"), k, F.lit(".PY")))
            .when(r == 3, F.concat(F.lit("src/part_"), k, F.lit("/.py")))
            .otherwise(F.concat(F.lit("src/part_"), k, F.lit(".py"))))
    body = F.encode("raw_code", "UTF-8")
    content = F.when(r == 4, F.concat(body, F.unhex(F.lit("FF")))).otherwise(body)
    docs = md_pages(spark, sf).select(F.col("file_path").alias("rel_path"),
                                      F.encode("raw_content", "UTF-8").alias("content"))
    return code.select(rel.alias("rel_path"), content.alias("content")).unionByName(docs)


@register("ingest_tree", with_ctes(MD_PAGES_SQL, PY_PARTS_SQL) + """,
files AS (SELECT p_size % 10 AS r, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS k, md5(raw_code) AS content FROM py_parts JOIN part USING (p_partkey)),
named AS (SELECT r, content, CASE r WHEN 0 THEN 'src/_priv/part_' || k || '.py' WHEN 1 THEN 'src/.h_part_' || k || '.py'
                                    WHEN 3 THEN 'src/part_' || k || '/.py' ELSE 'src/part_' || k || '.py' END AS path FROM files)
SELECT CASE r WHEN 3 THEN 'skipped' WHEN 4 THEN 'quarantine' ELSE 'code' END AS outcome, path,
       CASE WHEN r NOT IN (3, 4) THEN content END AS content FROM named WHERE r <> 2
UNION ALL SELECT 'doc', file_path, md5(raw_content) FROM md_pages""")
def ingest_tree(spark, sf):
    """A1-A4: write the corpus as a tree, list it and read it back, decode,
    dispatch by extension and parse; the outcome and content of every file."""
    root = write_tree(spark, corpus_tree(spark, sf))
    files, undecodable = read_sources(spark, root)
    code_src, doc_src, skipped = split_sources(files)
    idx = parse_corpus(code_src, doc_src)
    none = F.lit(None).cast("string")
    parts = [("code", idx.code_files, F.md5("raw_code")), ("doc", idx.doc_files, F.md5("raw_content")), ("skipped", skipped, none),
             ("quarantine", undecodable, none), ("quarantine", idx.code_bad.unionByName(idx.doc_bad), none)]
    path = F.regexp_extract("file_path", r"((?:src|docs)/(?:[^/]*/)?[^/]*)$", 1).alias("path")
    out = None
    for outcome, df, content in parts:
        part = df.select(F.lit(outcome).alias("outcome"), path, content.alias("content"))
        out = part if out is None else out.unionByName(part)
    return out

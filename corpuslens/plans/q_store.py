"""Registered queries for storing, appending, clearing and reading whole
collections (A5-A8, A10, D8, E12, F1, F5, F8, F13, F14) and the name context of
extraction prompts (G11). Contents are compared, not counts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import metadata as M
from ..operators import questions as Q
from ..operators import vectors as V
from ..session import materialize, scratch_path, stage
from ..sources.store import TableStore
from .corpora import MD_PAGES_SQL, PY_PARTS_SQL, md_pages, py_parts, with_ctes
from .ingest import index_corpus, parse_corpus, write_index
from .q_code import CALLS_SQL, ENTITIES_SQL, parsed_parts
from .q_docs import DOC_DETAILS_SQL, doc_details
from .q_graph import _EVENTS_SQL
from .q_meta import _KEYS_SQL, _META_SQL, metadata_table
from .q_retrieve import _EMB, _index
from .registry import register

_DOCS = with_ctes(MD_PAGES_SQL, PY_PARTS_SQL)


def _store(spark) -> TableStore:
    return TableStore(spark, scratch_path(spark, f"store-{uuid.uuid4().hex}"))


def _half(column: str, even: bool):
    return (F.crc32(F.col(column).cast("binary")) % 2 == 0) == F.lit(even)


@register("store_append", _KEYS_SQL + """
SELECT 'code' AS collection, file_path, md5(raw_code) AS content FROM py_parts
UNION ALL SELECT 'doc', file_path, md5(raw_content) FROM md_pages
UNION ALL SELECT 'vector', file_path, CAST(embedding_id AS VARCHAR) FROM keys""")
def store_append(spark, sf):
    """Records and vectors appended in two batches, read back whole."""
    idx, st = _index(spark, sf), _store(spark)
    for even in (True, False):
        st.append("code_files", idx.code_files.filter(_half("file_path", even)))
        st.append("doc_files", idx.doc_files.filter(_half("file_path", even)))
        V.append_vectors(st, idx.vectors.filter(_half("file_path", even)), _EMB.dim)
    code = st.read("code_files").select(F.lit("code").alias("collection"), "file_path", F.md5("raw_code").alias("content"))
    doc = st.read("doc_files").select(F.lit("doc"), "file_path", F.md5("raw_content"))
    vec = st.read("vectors").select(F.lit("vector"), "file_path", F.col("embedding_id").cast("string"))
    return code.union(doc).union(vec)


# every field of a stored code record as text, stated from ``part``
_CODE_SQL = f"""ent AS ({ENTITIES_SQL}), cal AS ({CALLS_SQL}),
code_ids AS (SELECT file_path, string_agg(CAST(embedding_id AS VARCHAR), ',' ORDER BY chunk_no) AS ids FROM keys WHERE kind = 'code' GROUP BY file_path),
code_rows AS (
  SELECT p.file_path, md5(p.raw_code) AS content, 'none#' || e.ents || '#' || c.calls || '#' || e.docs || '#os.path;pkg' || (p_partkey % 7)
         || '.helper_' || (p_partkey % 5) || '#TOTAL_' || p_partkey || ':4;price:7;y:14' AS details, i.ids, 'CodeFile.class' AS type
  FROM py_parts p JOIN (
    SELECT file_path, string_agg(name || ':' || type || ':' || line_number || ':' || coalesce(docstring, '-') || ':' || decorators || ':' || parents,
                                 ';' ORDER BY ent_no) AS ents, string_agg(docstring, '|' ORDER BY ent_no) FILTER (WHERE docstring <> '') AS docs
    FROM ent GROUP BY file_path) e USING (file_path) JOIN (
    SELECT file_path, string_agg(caller || '>' || callee || ':' || line_number, ';' ORDER BY call_no) AS calls FROM cal GROUP BY file_path) c USING (file_path)
  JOIN code_ids i USING (file_path)),
doc_rows AS (
  SELECT file_path, md5(raw_content) AS content, {DOC_DETAILS_SQL} AS details, CAST(embedding_id AS VARCHAR) AS ids, 'DocumentationFile.class' AS type
  FROM md_pages JOIN (SELECT file_path, embedding_id FROM keys WHERE kind = 'doc') k USING (file_path))"""


def _joined(items, *fields, sep=":"):
    """``a:b;c:d`` of an array of structs."""
    text = lambda x, f: F.array_join(x[f], ",") if f in ("decorators", "parents") else F.coalesce(x[f].cast("string"), F.lit("-"))
    return F.array_join(F.transform(items, lambda x: F.concat_ws(sep, *(text(x, f) for f in fields))), ";")


def _code_details():
    calls = F.array_join(F.transform("function_calls", lambda c: F.concat(
        c["caller"], F.lit(">"), c["callee"], F.lit(":"), c["line_number"].cast("string"))), ";")
    return F.concat_ws("#", F.coalesce("cleaned_code", F.lit("none")),
                       _joined("entities", "name", "type", "line_number", "docstring", "decorators", "parents"), calls,
                       F.array_join("docstrings", "|"), F.array_join("imports", ";"), _joined("global_variables", "name", "line_number"))


def _all_fields(code, docs):
    """``collection, file_path, content, details, ids, type``: records as text."""
    return code.select(F.lit("code").alias("collection"), "file_path", F.md5("raw_code").alias("content"), _code_details().alias("details"),
                       F.array_join(F.col("embedding_ids").cast("array<string>"), ",").alias("ids"), "type").unionByName(
        docs.select(F.lit("doc").alias("collection"), "file_path", F.md5("raw_content").alias("content"), doc_details().alias("details"),
                    F.col("embedding_id").cast("string").alias("ids"), "type"))


def _records(spark, sf):
    """The stored records of both kinds with their ids; nothing is embedded."""
    parsed = parse_corpus(py_parts(spark, sf).select("file_path", "raw_code"), md_pages(spark, sf))
    # staged, as the range pass reads them twice
    counts = V.chunk_counts(parsed.code_files, "raw_code", ["file_path"]).transform(materialize)
    first = V.file_first_ids(counts, parsed.doc_files.select("file_path"))
    keys = stage(V.number_chunks(first), "keys")
    ids = V.ids_per_file(keys).filter(F.col("kind") == "code").select("file_path", "embedding_ids")
    doc_ids = keys.filter(F.col("kind") == "doc").select("file_path", "embedding_id")
    return (parsed.code_files.drop("embedding_ids").join(ids, "file_path", "left"),
            parsed.doc_files.drop("embedding_id").join(doc_ids, "file_path", "left"))


@register("fetch_all", f"""{_KEYS_SQL.rstrip()}, {_CODE_SQL}
SELECT 'code' AS collection, file_path, content, details, ids, type FROM code_rows
UNION ALL SELECT 'doc', file_path, content, details, ids, type FROM doc_rows""")
def fetch_all(spark, sf):
    """F1/F5 and the typed forms F15/F16: every stored record of a kind, all fields."""
    code, docs = _records(spark, sf)
    return _all_fields(M.with_defaults(M.fetch_all_code(code)), M.doc_with_defaults(M.fetch_all_docs(docs)))


_ROUNDTRIP_SQL = f"""{_KEYS_SQL.rstrip()}, {_CODE_SQL}, {_EVENTS_SQL.replace("ent AS (" + ENTITIES_SQL + "),", "").replace("cal AS (" + CALLS_SQL + "),", "").strip()}
SELECT 'code_files' AS table_name, file_path AS key, md5(content || details || ids || type) AS content FROM code_rows
UNION ALL SELECT 'doc_files', file_path, md5(content || details || ids || type) FROM doc_rows
UNION ALL SELECT 'vectors', file_path, kind || ' ' || chunk_no || ' ' || embedding_id FROM keys
UNION ALL SELECT 'nodes', name, coalesce(type, '-') || ' ' || file_path || ' ' || coalesce(CAST(line_number AS VARCHAR), '-') || ' ' || coalesce(docstring, '-') FROM node_rows
UNION ALL SELECT 'edges', src || '>' || dst, n_calls || ' ' || first_file || ' ' || first_seq FROM edge_rows
UNION ALL SELECT 'edge_calls', caller || '>' || callee, file_path || ' ' || line_number || ' ' || call_no FROM cal"""


@register("store_roundtrip", _ROUNDTRIP_SQL)
def store_roundtrip(spark, sf):
    """Write the whole index through the store and read every
    table back, contents and all."""
    store = _store(spark)
    write_index(store, _index(spark, sf))
    records = _all_fields(store.read("code_files"), store.read("doc_files"))
    text = lambda *parts: F.concat_ws(" ", *(F.coalesce(F.col(p).cast("string"), F.lit("-")) for p in parts))
    edge = F.concat("src", F.lit(">"), "dst")
    parts = [records.select(F.concat("collection", F.lit("_files")).alias("table_name"), F.col("file_path").alias("key"),
                            F.md5(F.concat("content", "details", "ids", "type")).alias("content"))]
    for name, key, content in (("vectors", F.col("file_path"), text("kind", "chunk_no", "embedding_id")),
                               ("nodes", F.col("name"), text("type", "file_path", "line_number", "docstring")),
                               ("edges", edge, text("n_calls", "first_file", "first_seq")),
                               ("edge_calls", edge, text("file_path", "line_number", "ord.s")),
                               ("quarantine", F.col("file_path"), text("error"))):
        parts.append(store.read(name).select(F.lit(name).alias("table_name"), key.alias("key"), content.alias("content")))
    return reduce(DataFrame.unionByName, parts)


@register("typed_defaults", _DOCS + """
SELECT 'code' AS collection, file_path, md5(raw_code) AS content, 'none#####' AS details, '' AS ids, 'CodeFile.class' AS type FROM py_parts
UNION ALL SELECT 'doc', file_path, md5(raw_content), '#' || md5(raw_content) || '#', '-1', 'DocumentationFile.class' FROM md_pages""")
def typed_defaults(spark, sf):
    """Typed views of records that hold a path and a text only."""
    arrays = ("docstrings array<string>", "entities array<struct<name:string,type:string,line_number:int,docstring:string,"
              "decorators:array<string>,parents:array<string>>>", "function_calls array<struct<caller:string,callee:string,line_number:int>>",
              "imports array<string>", "global_variables array<struct<name:string,line_number:int>>", "embedding_ids array<long>")
    lack = lambda d: F.lit(None).cast(d.split(" ", 1)[1]).alias(d.split(" ", 1)[0])
    code = py_parts(spark, sf).select("file_path", "raw_code", lack("cleaned_code string"), *map(lack, arrays), lack("type string"))
    docs = md_pages(spark, sf).select("file_path", "raw_content", F.col("raw_content").alias("cleaned_content"), *map(lack, (
        "sections array<string>", "api_references string", "embedding_id long", "type string")))
    return _all_fields(M.with_defaults(M.fetch_all_code(code)), M.doc_with_defaults(M.fetch_all_docs(docs)))


_EVERY_SQL = f"""{_DOCS.rstrip()}, {_META_SQL}
SELECT 'code' AS collection, file_path, md5(raw_code) AS content FROM py_parts
UNION ALL SELECT 'doc', file_path, md5(raw_content) FROM md_pages
UNION ALL SELECT 'metadata', file_path, md5(function_name || api_reference || brand || size || ptype) FROM meta"""


def _everything(spark, sf, flt=None):
    parsed = parse_corpus(py_parts(spark, sf).select("file_path", "raw_code"), md_pages(spark, sf))
    tables = {"code": parsed.code_files, "doc": parsed.doc_files, "metadata": metadata_table(spark, sf)}
    field = lambda name: F.try_variant_get("record", f"$.{name}", "string")
    content = F.coalesce(field("raw_code"), field("raw_content"), F.concat(*map(field, ("function_name", "api_reference", "brand", "size", "ptype"))))
    return M.find_everywhere(tables, flt).select("collection", field("file_path").alias("file_path"), F.md5(content).alias("content"))


@register("find_everything", _EVERY_SQL)
def find_everything(spark, sf):
    """F8 with an empty filter: code, documentation and metadata records."""
    return _everything(spark, sf)


@register("find_by_type", f"{_DOCS.rstrip()}, {_META_SQL} SELECT 'doc' AS collection, file_path, md5(raw_content) AS content FROM md_pages")
def find_by_type(spark, sf):
    """F8 over all record shapes, with a field that only some of them have."""
    return _everything(spark, sf, {"type": "DocumentationFile.class"})


@register("meta_insert", f"""WITH {_META_SQL},
t AS (SELECT min(_seq) AS s FROM meta WHERE ptype = 'SMALL')
SELECT function_name, file_path,
       CASE WHEN _seq = (SELECT s FROM t) THEN 'docs/api/featured.md' ELSE api_reference END AS api_reference,
       brand, CAST(size AS VARCHAR) AS size, CASE WHEN _seq = (SELECT s FROM t) THEN 'yes' END AS featured,
       _seq = (SELECT s FROM t) AS found
FROM meta""")
def meta_insert(spark, sf):
    """A7 -> F9 -> F10: insert entries with free keys, find the first match,
    update it, and read the collection back."""
    st = _store(spark)
    rows = metadata_table(spark, sf).orderBy("_seq").drop("_seq")
    M.insert_metadata(st, "metadata", rows)
    df = st.read("metadata")
    first = M.find_one(df, {"ptype": "SMALL"}).select(F.col("_seq").alias("_first"))
    st.write("metadata", M.update(df, {"ptype": "SMALL"}, {"api_reference": "docs/api/featured.md", "featured": "yes"}))
    out = st.read("metadata").join(F.broadcast(first), F.col("_seq") == F.col("_first"), "left")  # one row
    free = [F.col("extra")[k].alias(k) for k in ("brand", "size", "featured")]
    return out.select("function_name", "file_path", "api_reference", *free, F.col("_first").isNotNull().alias("found"))


@register("store_clear", """
SELECT 'before' AS moment, false AS present, 0 AS n_rows UNION ALL SELECT 'written', true, count(*) FROM part
UNION ALL SELECT 'cleared', true, 0 UNION ALL SELECT 'again', true, count(*) FROM part""")
def store_clear(spark, sf):
    """A table that is absent, written, cleared and appended to."""
    st, rows = _store(spark), metadata_table(spark, sf)
    seen = []

    def look(moment):  # counted at once: later writes change the table
        seen.append((moment, st.exists("metadata"), st.read("metadata", rows.schema).count()))

    look("before")
    st.write("metadata", rows)
    look("written")
    st.clear("metadata", rows.schema)
    look("cleared")
    st.append("metadata", rows)
    look("again")
    return spark.createDataFrame(seen, "moment string, present boolean, n_rows long")


@register("whole_file_ids", _DOCS.rstrip() + """
SELECT file_path, kind, CAST(0 AS INTEGER) AS chunk_no, row_number() OVER (ORDER BY file_path) - 1 AS embedding_id
FROM (SELECT file_path, 'code' AS kind FROM py_parts UNION ALL SELECT file_path, 'doc' FROM md_pages) x""")
def whole_file_ids(spark, sf):
    """Every code file embedded whole, one vector and one id for each file."""
    idx = index_corpus(py_parts(spark, sf).select("file_path", "raw_code"), md_pages(spark, sf), embedder=_EMB, chunk_size=None)
    return idx.vectors.filter(F.size("embedding") == _EMB.dim).select("file_path", "kind", "chunk_no", "embedding_id")


@register("merge_into_empty", f"WITH {_EVENTS_SQL} SELECT name, type, file_path, line_number FROM node_rows")
def merge_into_empty(spark, sf):
    """Batches folded into an empty graph give the graph."""
    nodes, _, _ = G.merge_graphs(G.empty_graph(spark), G.build_graph(parsed_parts(spark, sf, materialize=True)))
    return nodes.select("name", "type", "file_path", "line_number")


@register("q_prompt_context", f"""WITH {_EVENTS_SQL}
SELECT row_number() OVER (ORDER BY type, name) - 1 AS pos, type, name, n
FROM (SELECT type, name, count(*) AS n FROM ent WHERE type IN ('function', 'class') AND name <> '' GROUP BY type, name) x""")
def q_prompt_context(spark, sf):
    """The whole name context, one row for each known name."""
    return Q.prompt_context(parsed_parts(spark, sf, materialize=True))

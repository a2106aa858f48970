"""Registered queries over the long modules that share names (``doc_modules``):
files of many chunks (D1, D3, D4), same-named entities (E1, E2), hub nodes (G8)
and retrieval with records and relations (G16); and the strict edge lines (E9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code as C
from ..operators import docs as D
from ..operators import graph as G
from ..operators import questions as Q
from ..operators import vectors as V
from ..session import materialize
from ..sources import table
from . import retrieve as R
from .corpora import DOC_MODULES_SQL, MD_PAGES_SQL, doc_modules, md_pages
from .ingest import index_corpus
from .q_code import CALLS_SQL, ENTITIES_SQL, parsed_parts
from .q_graph import _EVENTS_SQL, _pairs
from .q_retrieve import DIM, _EMB, _nearest_sql
from .registry import register
from .sqlparts import sql_embedding, sql_embedding_tokens, sql_tokens

_ENTS = """
SELECT file_path, 0 AS ent_no, 'Reader' AS name, 'class' AS type, 1 AS line_number, NULL AS docstring, '' AS decorators, 'Base' AS parents FROM doc_modules
UNION ALL SELECT file_path, 1, 'load', 'function', 4, NULL, '', '' FROM doc_modules
UNION ALL SELECT file_path, 2, 'doc_' || doc_id, 'function', 6, 'From ' || origin || '.', '', '' FROM doc_modules
UNION ALL SELECT file_path, 3, 'load', 'function', 2, NULL, '', '' FROM doc_modules"""
_CALLS = """
SELECT file_path, 0 AS call_no, 'load' AS caller, 'doc_' || doc_id AS callee, 5 AS line_number FROM doc_modules
UNION ALL SELECT file_path, 1, 'doc_' || doc_id, 'helper_' || (doc_id % 5), 8 FROM doc_modules
UNION ALL SELECT file_path, 2, 'doc_' || doc_id, 'load', 8 FROM doc_modules
UNION ALL SELECT file_path, 3, 'load', 'parse', 3 FROM doc_modules"""
_GRAPH_SQL = f"{DOC_MODULES_SQL}, {_EVENTS_SQL.replace(ENTITIES_SQL, _ENTS).replace(CALLS_SQL, _CALLS)}"

_KEYS = f"""{DOC_MODULES_SQL}, {MD_PAGES_SQL},
toks AS (SELECT file_path, {sql_tokens('raw_code')} AS t FROM doc_modules),
allk AS (
  SELECT file_path, 'code' AS kind, chunk_no, list_slice(t, chunk_no * 512 + 1, chunk_no * 512 + 512) AS tokens
  FROM (SELECT *, unnest(range(0, CAST(ceil(len(t) / 512.0) AS BIGINT))) AS chunk_no FROM toks) x
  UNION ALL SELECT file_path, 'doc', 0, {sql_tokens('raw_content')} FROM md_pages),
keys AS (SELECT file_path, kind, CAST(chunk_no AS INTEGER) AS chunk_no, tokens,
                row_number() OVER (ORDER BY file_path, chunk_no) - 1 AS embedding_id FROM allk)"""


def _modules(spark, sf):
    code, _ = C.parse_code(doc_modules(spark, sf).select("file_path", "raw_code"))
    return code.transform(materialize)


def _long_index(spark, sf):
    return index_corpus(doc_modules(spark, sf).select("file_path", "raw_code"), md_pages(spark, sf), embedder=_EMB)


@register("graph_shared_names", f"WITH {_GRAPH_SQL} SELECT * FROM node_rows")
def graph_shared_names(spark, sf):
    """E1/E2 where names are defined in every file: the first file's attributes,
    the last call's path."""
    nodes, _, _ = G.build_graph(_modules(spark, sf))
    return nodes.select("name", "type", "file_path", "line_number", "docstring", F.array_join("decorators", ",").alias("decorators"),
                        F.array_join("parents", ",").alias("parents"))


@register("q_neighbour_rows", f"""WITH {_GRAPH_SQL}
SELECT n.name, row_number() OVER (PARTITION BY n.name ORDER BY e.first_file, e.first_seq, e.dst) AS place, e.dst AS callee
FROM node_rows n JOIN edge_rows e ON e.src = n.name
UNION ALL SELECT name, NULL, NULL FROM node_rows WHERE name NOT IN (SELECT src FROM edge_rows)""")
def q_neighbour_rows(spark, sf):
    """G8 as rows: the callees of every node in first-call order; ``load`` is a hub
    that calls a function of every file."""
    nodes, edges, _ = G.build_graph(_modules(spark, sf))
    return Q.neighbour_rows(nodes, edges)


@register("long_chunks", f"""WITH {_KEYS}
SELECT file_path, kind, chunk_no, embedding_id, CASE WHEN kind = 'code' THEN CAST(len(tokens) AS INTEGER) END AS n_tokens,
       CASE WHEN kind = 'code' THEN md5(array_to_string(tokens, ' ')) END AS tokens_md5
FROM keys""")
def long_chunks(spark, sf):
    """Chunks of modules of many chunks, and their ids, dense over code and
    documentation in path order."""
    code = _modules(spark, sf)
    first = V.file_first_ids(V.chunk_counts(code, "raw_code", ["file_path"]).transform(materialize), md_pages(spark, sf).select("file_path"))
    chunks = V.chunk_tokens(code, "raw_code", ["file_path"]).select(
        "file_path", "chunk_no", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))
    keys = V.number_chunks(first)
    return keys.join(chunks.withColumn("kind", F.lit("code")), ["file_path", "kind", "chunk_no"], "left").select(
        "file_path", "kind", "chunk_no", "embedding_id", "n_tokens", "tokens_md5")


@register("retrieve_records", f"""WITH {_GRAPH_SQL}, {_KEYS.replace(DOC_MODULES_SQL + ", ", "")},
vec AS (SELECT k.embedding_id, k.kind, k.file_path, k.chunk_no, {sql_embedding_tokens('k.tokens', DIM)} AS v FROM keys k),
qv AS (SELECT item_id, {sql_embedding("regexp_replace(trim(text), '[^\\x00-\\x7F]', '', 'g')", DIM)} AS qv FROM benchmark),
{_nearest_sql('hits', 'qv', 'item_id', 'qv', None, 5)},
near AS (
  SELECT f.file_path, r.relation, f.name AS entity, r.other AS neighbour, row_number() OVER (
           PARTITION BY f.file_path, r.relation ORDER BY r.first_file, r.first_seq, f.name, r.other) AS place
  FROM (SELECT DISTINCT file_path, name FROM ent) f JOIN (
    SELECT src AS name, dst AS other, 'callee' AS relation, first_file, first_seq FROM edge_rows
    UNION ALL SELECT dst, src, 'caller', first_file, first_seq FROM edge_rows) r ON r.name = f.name
  WHERE f.file_path IN (SELECT file_path FROM hits)),
listed AS (SELECT file_path, string_agg(relation || ' ' || place || ': ' || entity || ' ' || neighbour, '; ' ORDER BY relation, place) AS related
           FROM near WHERE place <= {R.RELATED} GROUP BY file_path)
SELECT h.qk AS query_id, CAST(h.rank AS BIGINT) AS rank, h.embedding_id, h.kind, h.file_path, CAST(h.chunk_no AS INTEGER) AS chunk_no,
       round(h.dist, 6) AS dist, CASE WHEN h.kind = 'code' THEN 'Reader' ELSE trim(regexp_extract(d.raw_content, '(?m){D.HEADING_PATTERN}', 2)) END AS title,
       md5(coalesce(c.raw_code, d.raw_content)) AS content_md5, l.related
FROM hits h LEFT JOIN doc_modules c ON c.file_path = h.file_path LEFT JOIN md_pages d ON d.file_path = h.file_path
LEFT JOIN listed l ON l.file_path = h.file_path""")
def retrieve_records(spark, sf):
    """The 5 nearest chunks or documents of every benchmark question, with their
    records' fields and, for code, callees and callers."""
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    hits = R.retrieve_records(questions, _long_index(spark, sf), _EMB, k=5)
    shown = F.array_join(F.transform("related", lambda r: F.concat(
        r["relation"], F.lit(" "), r["place"].cast("string"), F.lit(": "), r["entity"], F.lit(" "), r["neighbour"])), "; ")
    return hits.select("query_id", "rank", "embedding_id", "kind", "file_path", "chunk_no", "dist", "title",
                       F.md5("content").alias("content_md5"), shown.alias("related"))


@register("call_lines_strict", f"""WITH {_EVENTS_SQL}
SELECT p.src, p.dst, (e.src IS NOT NULL) AS has_edge, CAST(NULL AS INTEGER) AS line_number, CAST(NULL AS VARCHAR) AS file_path,
       CAST(NULL AS INTEGER) AS seq
FROM pairs p LEFT JOIN edge_rows e ON e.src = p.src AND e.dst = p.dst""")
def call_lines_strict(spark, sf):
    """E9 as written (Q2): an existing edge reports no lines."""
    code = parsed_parts(spark, sf, materialize=True)
    return G.call_lines(G.edge_calls(code), G.build_edges(code), _pairs(spark, sf), strict=True)

"""Registered queries for the call graph (E1-E12) built from ``py_parts``.

SQL twins fold the expected entity and call rows (stated from ``part``
columns in ``q_code``) with ``arg_min``/``arg_max`` over a sortable order key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import materialize
from .q_code import CALLS_SQL, ENTITIES_SQL, K, parsed_parts
from .registry import register

_EVENTS_SQL = f"""
ent AS ({ENTITIES_SQL}),
cal AS ({CALLS_SQL}),
ev AS (
  SELECT name, file_path || '|0|' || lpad(CAST(ent_no AS VARCHAR), 6, '0') AS ord,
         true AS is_entity, false AS is_call, type, line_number, docstring, decorators, parents,
         file_path FROM ent
  UNION ALL
  SELECT unnest([caller, callee]) AS name, file_path || '|1|' || lpad(CAST(call_no AS VARCHAR), 6, '0'),
         false, true, NULL, NULL, NULL, NULL, NULL, file_path FROM cal),
nodes AS (
  SELECT name, arg_min({{'e': is_entity, 't': type, 'l': line_number, 'd': docstring,
                        'dec': decorators, 'par': parents, 'f': file_path}}, ord) AS a,
         arg_max(file_path, ord) FILTER (WHERE is_call) AS last_call_file
  FROM ev GROUP BY name),
node_rows AS (
  SELECT name, CASE WHEN a.e THEN a.t END AS type, coalesce(last_call_file, a.f) AS file_path,
         CAST(CASE WHEN a.e THEN a.l END AS INTEGER) AS line_number,
         CASE WHEN a.e THEN a.d END AS docstring, CASE WHEN a.e THEN a.dec END AS decorators,
         CASE WHEN a.e THEN a.par END AS parents
  FROM nodes),
edge_rows AS (
  SELECT caller AS src, callee AS dst, count(*) AS n_calls,
         arg_min(file_path, file_path || '|' || lpad(CAST(call_no AS VARCHAR), 6, '0')) AS first_file,
         CAST(arg_min(call_no, file_path || '|' || lpad(CAST(call_no AS VARCHAR), 6, '0')) AS INTEGER)
           AS first_seq
  FROM cal GROUP BY caller, callee),
probes AS (
  SELECT DISTINCT name FROM (
    SELECT 'size_' || p_size AS name FROM part
    UNION ALL SELECT 'helper_' || (p_size % 7) FROM part
    UNION ALL SELECT 'part_' || {K} FROM part
    UNION ALL SELECT 'Part_' || {K} FROM part
    UNION ALL SELECT 'h' FROM part
    UNION ALL SELECT 'nosuch_' || p_size FROM part) x),
pairs AS (
  SELECT DISTINCT src, dst FROM (
    SELECT 'part_' || {K} AS src, 'size_' || {K} AS dst FROM part
    UNION ALL SELECT 'part_' || {K}, 'size_' || p_size FROM part
    UNION ALL SELECT 'outer_' || {K}, 'h' FROM part
    UNION ALL SELECT 'Part_' || {K}, 'h' FROM part) y)
"""


def _records(spark, sf):
    """What the graph reads of the parsed modules, parsed once; their texts are not staged."""
    return parsed_parts(spark, sf).select("file_path", "entities", "function_calls").transform(materialize)


def _graph(spark, sf):
    return G.build_graph(_records(spark, sf))


def _probes(spark, sf):
    from ..sources import table
    p = table(spark, sf, "part")
    k = F.col("p_partkey").cast("string")
    names = [F.concat(F.lit("size_"), F.col("p_size").cast("string")),
             F.concat(F.lit("helper_"), (F.col("p_size") % 7).cast("string")),
             F.concat(F.lit("part_"), k), F.concat(F.lit("Part_"), k), F.lit("h"),
             F.concat(F.lit("nosuch_"), F.col("p_size").cast("string"))]
    return p.select(F.explode(F.array(*names)).alias("name")).distinct()


def _pairs(spark, sf):
    from ..sources import table
    p = table(spark, sf, "part")
    k = F.col("p_partkey").cast("string")
    c = lambda a, b: F.struct(a.alias("src"), b.alias("dst"))
    pairs = [c(F.concat(F.lit("part_"), k), F.concat(F.lit("size_"), k)),
             c(F.concat(F.lit("part_"), k), F.concat(F.lit("size_"), F.col("p_size").cast("string"))),
             c(F.concat(F.lit("outer_"), k), F.lit("h")),
             c(F.concat(F.lit("Part_"), k), F.lit("h"))]
    return p.select(F.explode(F.array(*pairs)).alias("x")).select("x.src", "x.dst").distinct()


@register("graph_nodes", f"WITH {_EVENTS_SQL} SELECT * FROM node_rows")
def graph_nodes(spark, sf):
    """Nodes with first-writer attributes and last-call file."""
    nodes = G.build_nodes(_records(spark, sf))
    return nodes.select("name", "type", "file_path", "line_number", "docstring",
                        F.array_join("decorators", ",").alias("decorators"),
                        F.array_join("parents", ",").alias("parents"))


@register("graph_edges", f"WITH {_EVENTS_SQL} SELECT * FROM edge_rows")
def graph_edges(spark, sf):
    """One edge per (caller, callee) with call count and first call."""
    return G.build_edges(_records(spark, sf))


@register("callees", f"""WITH {_EVENTS_SQL}
SELECT p.name, (n.name IS NOT NULL) AS known, e.dst AS callee, e.first_file, e.first_seq
FROM probes p LEFT JOIN node_rows n ON p.name = n.name LEFT JOIN edge_rows e ON e.src = p.name""")
def callees_q(spark, sf):
    """E5: successors of every probe name."""
    nodes, edges, _ = _graph(spark, sf)
    return G.callees(edges, nodes, _probes(spark, sf))


@register("callers", f"""WITH {_EVENTS_SQL}
SELECT p.name, (n.name IS NOT NULL) AS known, e.src AS caller, e.first_file, e.first_seq
FROM probes p LEFT JOIN node_rows n ON p.name = n.name LEFT JOIN edge_rows e ON e.dst = p.name""")
def callers_q(spark, sf):
    """Predecessors of every probe name (``h`` is a hot callee)."""
    nodes, edges, _ = _graph(spark, sf)
    return G.callers(edges, nodes, _probes(spark, sf))


@register("entity_exists", f"""WITH {_EVENTS_SQL}
SELECT p.name, (n.name IS NOT NULL) AS "exists" FROM probes p LEFT JOIN node_rows n ON p.name = n.name""")
def entity_exists(spark, sf):
    """Does each probe name exist as a node."""
    nodes = G.build_nodes(_records(spark, sf))
    return G.exists(nodes, _probes(spark, sf))


@register("function_file", f"""WITH {_EVENTS_SQL}
SELECT p.name, n.file_path FROM probes p LEFT JOIN node_rows n ON p.name = n.name""")
def function_file(spark, sf):
    """File of each probe name."""
    nodes = G.build_nodes(_records(spark, sf))
    return G.node_file(nodes, _probes(spark, sf))


@register("call_lines", f"""WITH {_EVENTS_SQL}
SELECT p.src, p.dst, (e.src IS NOT NULL) AS has_edge, c.line_number, c.file_path,
       CAST(c.call_no AS INTEGER) AS seq
FROM pairs p LEFT JOIN edge_rows e ON e.src = p.src AND e.dst = p.dst
LEFT JOIN cal c ON c.caller = p.src AND c.callee = p.dst""")
def call_lines_q(spark, sf):
    """Call sites of each probe pair; repeats kept."""
    code = _records(spark, sf)
    return G.call_lines(G.edge_calls(code), G.build_edges(code), _pairs(spark, sf))


@register("add_edge", f"""WITH {_EVENTS_SQL},
new_edges AS (SELECT src, dst FROM pairs EXCEPT SELECT src, dst FROM edge_rows),
all_edges AS (SELECT src, dst, n_calls FROM edge_rows
              UNION ALL SELECT src, dst, 0 FROM new_edges),
all_nodes AS (SELECT name FROM node_rows
              UNION SELECT src FROM new_edges UNION SELECT dst FROM new_edges)
SELECT 'edge' AS kind, src AS a, dst AS b, n_calls FROM all_edges
UNION ALL SELECT 'node', name, NULL, NULL FROM all_nodes""")
def add_edge(spark, sf):
    """Add bare edges for the probe pairs; existing edges are kept as is."""
    nodes, edges, _ = _graph(spark, sf)
    n2, e2 = G.add_edges(nodes, edges, _pairs(spark, sf))
    return (e2.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"),
                      "n_calls")
              .unionByName(G.all_nodes(n2).select(F.lit("node").alias("kind"), F.col("name").alias("a"),
                                                  F.lit(None).cast("string").alias("b"),
                                                  F.lit(None).cast("long").alias("n_calls"))))

"""Call graph as two tables (E1-E12): ``nodes`` and ``edges``, plus the
``edge_calls`` rows that carry each call site.

The reference builds the graph file by file, in place. Its rules are
order-dependent, so every event carries an explicit order key
``ord = (file_path, phase, seq)``: files in path order, a file's entities
(phase 0, entity order) before its calls (phase 1, call order).

* E1: a node's attributes come from its first event, and only if that event
  is an entity -- a name first seen as a callee stays a bare node;
* E2: every call sets ``file_path`` on both ends, so the last call event
  wins; a node never called keeps its entity's file;
* E3: one edge per (caller, callee); its call sites, in arrival order.

The folds work on the order key packed in one long (dense number of the file
in path order, phase, position), so they are hash aggregates of longs that
combine on the map side: a hot callee (``print``, ``len``) never lands whole in
one task, and no docstring is sorted or shuffled before the winners are known;
joins then fetch the winners' attributes and paths. Call sites stay as
rows (``edge_calls``) rather than one array per edge, so a hot edge never has
to fit in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .code import calls as explode_calls
from .ids import dense_ids
from .lookup import probe

ORD_SCHEMA = T.StructType([T.StructField("f", T.StringType()), T.StructField("p", T.IntegerType()),
                           T.StructField("s", T.IntegerType())])
NODE_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("docstring", T.StringType()),
    T.StructField("decorators", T.ArrayType(T.StringType())),
    T.StructField("parents", T.ArrayType(T.StringType())),
    T.StructField("first_ord", ORD_SCHEMA),
    T.StructField("last_call_ord", ORD_SCHEMA),
])
EDGE_SCHEMA = T.StructType([
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
    T.StructField("n_calls", T.LongType()),
    T.StructField("first_file", T.StringType()),
    T.StructField("first_seq", T.IntegerType()),
])
SITE_SCHEMA = T.StructType([
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("ord", ORD_SCHEMA),
])


def _ord(file_path: Column, phase: int, seq: Column) -> Column:
    return F.struct(file_path.alias("f"), F.lit(phase).alias("p"), seq.cast("int").alias("s"))


# Packed order key: 31 bits of file number, one of phase, 31 of position.
_FILE_BIT, _PHASE_BIT = 32, 31


def _file_numbers(code_files: DataFrame) -> DataFrame:
    """``file_path, file_no``: files numbered from 0 in path order."""
    return dense_ids(code_files.select("file_path").distinct(), ["file_path"], "file_no")


def _packed(phase: int, seq: str) -> Column:
    return (F.shiftleft(F.col("file_no"), _FILE_BIT)
            + F.lit(phase << _PHASE_BIT).cast("long") + F.col(seq).cast("long"))


def _file_of(key: str) -> Column:
    return F.shiftright(F.col(key), _FILE_BIT)


def _unpacked(key: str, path: str) -> Column:
    """``ord`` of a packed key (null where the key is) whose file is ``path``."""
    phase = F.shiftright(F.col(key), _PHASE_BIT).bitwiseAND(F.lit(1).cast("long"))
    seq = F.col(key).bitwiseAND(F.lit((1 << _PHASE_BIT) - 1).cast("long"))
    return F.when(F.col(key).isNotNull(), F.struct(F.col(path).alias("f"), phase.cast("int").alias("p"), seq.cast("int").alias("s")))


def _touches(names: str, phase: int) -> Column:
    """``name, phase, seq`` of an array of names (none where it is null)."""
    each = F.transform(names, lambda x, i: F.struct(x.alias("name"), F.lit(phase).alias("phase"), i.alias("seq")))
    return F.coalesce(each, F.array().cast("array<struct<name:string,phase:int,seq:int>>"))


def fold_nodes(code_files: DataFrame, numbers: DataFrame) -> DataFrame:
    """E1 + E2: the node table of parsed files; ``numbers`` as ``_file_numbers``.
    Staged: lookups read it more than once. Only names meet the numbers; attributes
    are fetched for the winners, by file and place."""
    numbered = code_files.select("file_path", F.col("entities.name").alias("own"), F.col("function_calls.caller").alias("caller"),
                                 F.col("function_calls.callee").alias("callee")).join(numbers, "file_path")
    touches = numbered.select("file_no", F.explode(F.concat(_touches("own", 0), _touches("caller", 1), _touches("callee", 1))).alias("t")) \
        .select("t.name", F.col("t.phase").alias("phase"),
                (F.shiftleft("file_no", _FILE_BIT) + F.shiftleft(F.col("t.phase").cast("long"), _PHASE_BIT) + F.col("t.seq")).alias("at"))
    g = touches.groupBy("name").agg(F.min("at").alias("first"), F.max(F.when(F.col("phase") == 1, F.col("at"))).alias("last"))
    attrs = code_files.select(F.col("file_path").alias("first_path"), F.posexplode("entities").alias("place", "e")) \
        .select("first_path", "place", "e.type", "e.line_number", "e.docstring", "e.decorators", "e.parents")
    path = lambda key, out: numbers.select(F.col("file_no").alias(key), F.col("file_path").alias(out))
    g = (g.withColumn("first_no", _file_of("first")).withColumn("last_no", _file_of("last"))
         .join(path("first_no", "first_path"), "first_no").join(path("last_no", "last_path"), "last_no", "left"))
    own = _unpacked("first", "first_path")
    g = g.withColumn("place", F.when(own["p"] == 0, own["s"])).join(attrs, ["first_path", "place"], "left")
    return g.select("name", "type", F.coalesce("last_path", "first_path").alias("file_path"), "line_number", "docstring",
                    "decorators", "parents", own.alias("first_ord"), _unpacked("last", "last_path").alias("last_call_ord")) \
        .transform(materialize)


def edge_calls(code_files: DataFrame) -> DataFrame:
    """E3 call sites: ``src, dst, file_path, line_number, ord``."""
    return explode_calls(code_files).select(
        F.col("caller").alias("src"), F.col("callee").alias("dst"), "file_path", "line_number",
        _ord(F.col("file_path"), 1, F.col("call_no")).alias("ord"))


def fold_edges(code_files: DataFrame, numbers: DataFrame) -> DataFrame:
    """One edge per (src, dst) with its call count and first call. Staged, as
    the nodes are."""
    numbered = code_files.select("file_path", F.col("function_calls.caller").alias("src"), F.col("function_calls.callee").alias("dst")) \
        .join(numbers, "file_path")
    calls = numbered.select("file_no", F.posexplode(F.arrays_zip("src", "dst")).alias("seq", "c")) \
        .select("c.src", "c.dst", _packed(1, "seq").alias("at"))
    g = calls.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_calls"), F.min("at").alias("first"))
    return g.withColumn("file_no", _file_of("first")).join(numbers, "file_no").select(
        "src", "dst", "n_calls", F.col("file_path").alias("first_file"), _unpacked("first", "file_path")["s"].alias("first_seq")) \
        .transform(materialize)


def build_graph(code_files: DataFrame):
    """(nodes, edges, edge_calls) from parsed code files."""
    numbers = _file_numbers(code_files)
    return fold_nodes(code_files, numbers), fold_edges(code_files, numbers), edge_calls(code_files)


def build_nodes(code_files: DataFrame) -> DataFrame:
    """The nodes of ``build_graph`` alone."""
    return fold_nodes(code_files, _file_numbers(code_files))


def build_edges(code_files: DataFrame) -> DataFrame:
    """The edges of ``build_graph`` alone."""
    return fold_edges(code_files, _file_numbers(code_files))


def merge_graphs(old: tuple, new: tuple, nodes: bool = True):
    """Fold a later batch of files into an existing graph (incremental ingest).

    Node and edge folds are min/max over order keys, so the merge of two
    folds equals the fold of the union (the new files must sort after the
    old ones for the reference's order to hold). ``old``/``new`` are
    ``(nodes, edges, edge_calls)``; call sites may be None (kept as rows
    elsewhere), and ``nodes=False`` merges only the edges.
    """
    old_nodes, old_edges, old_sites = old
    new_nodes, new_edges, new_sites = new
    sites = None if old_sites is None or new_sites is None else old_sites.unionByName(new_sites)
    edges = merge_edge_folds(old_edges.unionByName(new_edges))
    return (merge_node_folds(old_nodes.unionByName(new_nodes)) if nodes else None), edges, sites


def merge_edge_folds(folds: DataFrame) -> DataFrame:
    """One edge table from the rows of several (of disjoint files)."""
    return (folds.groupBy("src", "dst")
            .agg(F.sum("n_calls").alias("n_calls"),
                 F.min(F.struct(F.col("first_file").isNull().alias("bare"), "first_file",
                                "first_seq")).alias("f"))
            .select("src", "dst", "n_calls", "f.first_file", "f.first_seq"))


def merge_node_folds(folds: DataFrame) -> DataFrame:
    """One node table from the rows of several (of disjoint files)."""
    first = F.min(F.struct(F.col("first_ord").alias("ord"), "type", "file_path", "line_number",
                           "docstring", "decorators", "parents", F.col("last_call_ord"))).alias("a")
    last = F.max(F.when(F.col("last_call_ord").isNotNull(),
                        F.struct(F.col("last_call_ord").alias("ord"), "file_path"))).alias("b")
    g = folds.groupBy("name").agg(first, last)
    return g.select("name", F.col("a.type").alias("type"),
                    F.coalesce(F.col("b.file_path"), F.col("a.file_path")).alias("file_path"),
                    F.col("a.line_number").alias("line_number"),
                    F.col("a.docstring").alias("docstring"),
                    F.col("a.decorators").alias("decorators"),
                    F.col("a.parents").alias("parents"),
                    F.col("a.ord").alias("first_ord"), F.col("b.ord").alias("last_call_ord"))


# --------------------------------------------------------------------------
# updates and lookups (batch forms take a probe table with a ``name`` column)
# --------------------------------------------------------------------------

def add_edges(nodes: DataFrame, edges: DataFrame, pairs: DataFrame):
    """Add bare edges ``pairs(src, dst)``; an existing edge is unchanged and
    missing end nodes are created bare."""
    new = pairs.select("src", "dst").join(edges.select("src", "dst"), ["src", "dst"], "left_anti") \
               .distinct()
    new_edges = new.select("src", "dst", F.lit(0).cast("long").alias("n_calls"),
                           F.lit(None).cast("string").alias("first_file"),
                           F.lit(None).cast("int").alias("first_seq"))
    ends = new.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    missing = ends.join(nodes.select("name"), "name", "left_anti")
    extra_cols = [F.lit(None).cast(f.dataType).alias(f.name)
                  for f in nodes.schema.fields if f.name != "name"]
    return (nodes.unionByName(missing.select("name", *extra_cols)),
            edges.unionByName(new_edges))


def callees(edges: DataFrame, nodes: DataFrame, probes: DataFrame) -> DataFrame:
    """E5: successors of each probe name, with their first-call order key.

    ``known`` is false for names not in the graph (the single-name API raises
    instead)."""
    return _neighbours(edges, nodes, probes, "src", "dst", "callee")


def callers(edges: DataFrame, nodes: DataFrame, probes: DataFrame) -> DataFrame:
    """Predecessors of each probe name."""
    return _neighbours(edges, nodes, probes, "dst", "src", "caller")


def _neighbours(edges, nodes, probes, on, other, out):
    e = edges.select(F.col(on).alias("name"), F.col(other).alias(out), "first_file", "first_seq")
    return probe(exists(nodes, probes).withColumnRenamed("exists", "known"), e, ["name"])


def exists(nodes: DataFrame, probes: DataFrame) -> DataFrame:
    """``name, exists`` for each probe."""
    flag = nodes.select("name", F.lit(True).alias("exists"))
    return probe(probes.select("name"), flag, ["name"]) \
        .withColumn("exists", F.coalesce("exists", F.lit(False)))


def existing(nodes: DataFrame, probes: DataFrame) -> DataFrame:
    """E7 as a filter: probes whose name is a node (left semi join)."""
    return probes.join(nodes.select("name"), "name", "left_semi")


def node_file(nodes: DataFrame, probes: DataFrame) -> DataFrame:
    """File of each probe name (null when unknown)."""
    return probe(probes.select("name"), nodes.select("name", "file_path"), ["name"])


def call_lines(sites: DataFrame, edges: DataFrame, pairs: DataFrame,
               strict: bool = False) -> DataFrame:
    """Call lines of each probe pair ``(src, dst)``.

    One row per call site, in ``ord`` order; a pair with no edge gives one
    row with ``has_edge`` false and null line. ``strict=True`` reproduces the
    written lookup, which reads a key that is never stored: an existing edge
    then reports no lines.
    """
    flagged = probe(pairs.select("src", "dst"), edges.select("src", "dst", F.lit(True).alias("has_edge")), ["src", "dst"]) \
        .withColumn("has_edge", F.coalesce("has_edge", F.lit(False)))
    if strict:
        return flagged.select("src", "dst", "has_edge",
                              F.lit(None).cast("int").alias("line_number"),
                              F.lit(None).cast("string").alias("file_path"),
                              F.lit(None).cast("int").alias("seq"))
    s = sites.select("src", "dst", "line_number", "file_path", F.col("ord.s").alias("seq"))
    return probe(flagged, s, ["src", "dst"])


def all_nodes(nodes: DataFrame) -> DataFrame:
    """E10."""
    return nodes.select("name")


def all_edges(edges: DataFrame) -> DataFrame:
    """E11."""
    return edges.select("src", "dst")


def empty_graph(spark):
    """An empty graph ``(nodes, edges, edge_calls)``, the shape of
    ``build_graph``, into which later batches can be merged."""
    return tuple(spark.createDataFrame([], s) for s in (NODE_SCHEMA, EDGE_SCHEMA, SITE_SCHEMA))


class CodeGraph:
    """Single-name lookups over the graph tables, for interactive use.

    Scalar answers (exists, file) come back as Python values; neighbour and
    call-line lists come back as ordered DataFrames, since a hub name or a hot
    edge can hold any number of rows. Batch work should use the DataFrame
    functions above.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, sites: DataFrame | None = None):
        self.nodes, self.edges, self.sites = nodes, edges, sites

    def entity_exists(self, name: str) -> bool:
        """E7."""
        return bool(self.nodes.filter(F.col("name") == name).limit(1).count())

    function_exists = entity_exists

    def _require(self, name: str) -> None:
        if not self.entity_exists(name):
            raise KeyError(f"The node {name} is not in the graph.")

    def get_dependencies(self, name: str) -> DataFrame:
        """E5: callees in first-call order; unknown names raise ``KeyError``."""
        self._require(name)
        return (self.edges.filter(F.col("src") == name)
                .orderBy(F.col("first_file").isNull(), "first_file", "first_seq").select("dst"))

    get_callees = get_dependencies

    def get_dependents(self, name: str) -> DataFrame:
        """Callers in first-call order; unknown names raise ``KeyError``."""
        self._require(name)
        return (self.edges.filter(F.col("dst") == name)
                .orderBy(F.col("first_file").isNull(), "first_file", "first_seq").select("src"))

    get_callers = get_dependents

    def get_function_file(self, name: str) -> str | None:
        """E8."""
        row = self.nodes.filter(F.col("name") == name).select("file_path").first()
        return row[0] if row else None

    def get_call_line_number(self, caller: str, callee: str, strict: bool = False):
        """Call lines of an edge in arrival order (a DataFrame); None when
        there is no edge; no rows with ``strict=True``."""
        has = self.edges.filter((F.col("src") == caller) & (F.col("dst") == callee)).limit(1).count()
        if not has:
            return None
        lines = (self.sites.filter((F.col("src") == caller) & (F.col("dst") == callee))
                 .orderBy("ord").select("line_number"))
        return lines.limit(0) if strict else lines

    def get_all_entities(self) -> DataFrame:
        """E10 (a DataFrame: the node list grows with the corpus)."""
        return all_nodes(self.nodes)

    get_all_functions = get_all_entities

    def get_all_dependencies(self) -> DataFrame:
        """E11."""
        return all_edges(self.edges)

    get_all_call_relationships = get_all_dependencies

    def add_dependency(self, src: str, dst: str) -> "CodeGraph":
        """A new graph with the bare edge added."""
        pairs = self.nodes.sparkSession.createDataFrame([(src, dst)], "src string, dst string")
        nodes, edges = add_edges(self.nodes, self.edges, pairs)
        return CodeGraph(nodes, edges, self.sites)

"""Python source extraction (B1-B10) as a distributed parse job.

Spark has no Python grammar, so the one Python step is the parse itself: a
``mapInArrow`` task runs the standard ``ast`` module over each file of its
partition and returns Arrow arrays of nested structs. Everything after the
parse -- docstring lists, explode views, cleaning, the graph fold -- is
DataFrame expressions.

Extraction rules (the reference behaviour):
* nodes are visited breadth-first over the whole module (``ast.walk``), so
  list order is by depth first, then source order;
* functions: every plain ``def`` at any depth (``async def`` is not one);
  classes: every ``class``;
* decorators and bases keep the bare name or the last attribute part; any
  other form (a call ``@d(x)``, a subscript ``Gen[int]``) is left out;
* calls: every call anywhere under a ``def`` -- so a nested function's calls
  count for the outer one too, as do decorator and default-argument calls;
  the callee is ``name`` or ``name.attr``, other forms are left out;
* imports: ``import a.b`` -> ``a.b``; ``from m import x`` -> ``m.x``
  (relative dots are lost: ``from . import x`` -> ``.x``);
* "globals": every plain assignment to a bare name at any depth, one entry
  per bare-name target.
"""

from __future__ import annotations

import ast
import gc
import json
import multiprocessing
from collections import deque
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_comments_and_blank_lines
from ..session import arrow_map, spread

CODE_TYPE = "CodeFile.class"

ENTITY = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("docstring", T.StringType()),
    T.StructField("decorators", T.ArrayType(T.StringType())),
    T.StructField("parents", T.ArrayType(T.StringType())),
])
CALL = T.StructType([
    T.StructField("caller", T.StringType()),
    T.StructField("callee", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
])
GLOBAL = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
])
PARSED = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("raw_code", T.StringType()),
    T.StructField("entities", T.ArrayType(ENTITY)),
    T.StructField("function_calls", T.ArrayType(CALL)),
    T.StructField("imports", T.ArrayType(T.StringType())),
    T.StructField("global_variables", T.ArrayType(GLOBAL)),
    T.StructField("error", T.StringType()),
])

_A_STR = pa.string()
_A_ENTITY = pa.struct([("name", _A_STR), ("type", _A_STR), ("file_path", _A_STR),
                       ("line_number", pa.int32()), ("docstring", _A_STR),
                       ("decorators", pa.list_(_A_STR)), ("parents", pa.list_(_A_STR))])
_A_CALL = pa.struct([("caller", _A_STR), ("callee", _A_STR), ("file_path", _A_STR),
                     ("line_number", pa.int32())])
_A_GLOBAL = pa.struct([("name", _A_STR), ("line_number", pa.int32())])


# --------------------------------------------------------------------------
# per-file extraction (runs inside executor tasks)
# --------------------------------------------------------------------------

def _short_name(expr: ast.AST) -> str | None:
    """Bare name of a decorator or base: ``x`` or the last part of ``a.x``."""
    if isinstance(expr, ast.Name):
        return expr.id
    if isinstance(expr, ast.Attribute):
        return expr.attr
    return None


def _call_target(func: ast.AST) -> str | None:
    """``f`` for ``f()``, ``a.f`` for ``a.f()``; deeper chains give None."""
    if isinstance(func, ast.Name):
        return func.id
    if isinstance(func, ast.Attribute) and isinstance(func.value, ast.Name):
        return f"{func.value.id}.{func.attr}"
    return None


# Nodes that give nothing and hold nothing that does: not worth a place in the walk.
_LEAVES = frozenset([ast.Name, ast.Constant, *(t for base in (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)
                                               for t in base.__subclasses__())])
# Fields that hold words, numbers or such nodes alone, and the others of each kind of node.
_WORDS = frozenset(["arg", "attr", "conversion", "ctx", "id", "is_async", "kind", "kwd_attrs", "level", "module", "name", "names",
                    "op", "ops", "rest", "simple", "tag", "type_comment", "type_ignores"])
_HELD = {t: tuple(f for f in t._fields if f not in _WORDS) for t in vars(ast).values() if isinstance(t, type) and issubclass(t, ast.AST)}


def extract_python(path: str, source: str) -> dict:
    """Extract entities, calls, imports and assignments from one module.

    One breadth-first walk of the module. A function's calls are listed in
    the breadth-first order of its own subtree, which is the module's order
    restricted to that subtree, so each call is credited, in walk order, to
    every function that encloses it -- no subtree is walked twice.

    Raises ``SyntaxError``/``ValueError``/``RecursionError`` on bad input.
    """
    tree = ast.parse(source, filename=path)
    entities, imports, assigned = [], [], []
    calls_of: dict[int, list] = {}
    functions: list[ast.FunctionDef] = []
    queue = deque([(tree, ())])
    while queue:
        node, enclosing = queue.popleft()
        kind = type(node)
        if kind is ast.FunctionDef:
            functions.append(node)
            calls_of[id(node)] = []
            entities.append({
                "name": node.name, "type": "function", "file_path": path,
                "line_number": node.lineno, "docstring": ast.get_docstring(node),
                "decorators": [n for n in map(_short_name, node.decorator_list) if n is not None],
                "parents": []})
            inner = enclosing + (node,)
        else:
            inner = enclosing
            if kind is ast.Call and enclosing:
                target = _call_target(node.func)
                if target:
                    for fn in enclosing:
                        calls_of[id(fn)].append((node.lineno, target))
            elif kind is ast.ClassDef:
                entities.append({
                    "name": node.name, "type": "class", "file_path": path,
                    "line_number": node.lineno, "docstring": ast.get_docstring(node),
                    "decorators": [],
                    "parents": [n for n in map(_short_name, node.bases) if n is not None]})
            elif kind is ast.Import:
                imports.extend(a.name for a in node.names)
            elif kind is ast.ImportFrom:
                prefix = node.module or ""
                imports.extend(f"{prefix}.{a.name}" for a in node.names)
            elif kind is ast.Assign:
                assigned.extend({"name": t.id, "line_number": node.lineno}
                                for t in node.targets if isinstance(t, ast.Name))
        for field in _HELD[kind]:
            child = getattr(node, field, None)
            if type(child) is list:
                if child:
                    queue.extend([(c, inner) for c in child if isinstance(c, ast.AST) and type(c) not in _LEAVES])
            elif isinstance(child, ast.AST) and type(child) not in _LEAVES:
                queue.append((child, inner))
    calls = [{"caller": fn.name, "callee": target, "file_path": path, "line_number": line}
             for fn in functions for line, target in calls_of[id(fn)]]
    return {"entities": entities, "function_calls": calls, "imports": imports,
            "global_variables": assigned}


#: Files whose records a task holds at once as Python objects.
PARSED_FILES = 128

_EXTRACTED = {"entities": pa.list_(_A_ENTITY), "function_calls": pa.list_(_A_CALL), "imports": pa.list_(_A_STR),
              "global_variables": pa.list_(_A_GLOBAL), "error": _A_STR}


def _parse_batches(batches):
    """Each Arrow batch is parsed in a process of its own, forked for it: the parser
    interns every identifier for the life of its process, so one that parsed batch
    after batch would grow with the number of different names it had seen."""
    for rb in batches:
        if rb.num_rows:
            yield from _parsed_apart(rb)


def _parsed_apart(rb):
    fork = multiprocessing.get_context("fork")
    here, there = fork.Pipe(duplex=False)
    child = fork.Process(target=_send_extracted, args=(rb, here, there))
    child.start()
    there.close()
    try:
        for lo in range(0, rb.num_rows, PARSED_FILES):
            try:
                got = pa.ipc.read_record_batch(pa.py_buffer(here.recv_bytes()), pa.schema(_EXTRACTED.items()))
            except EOFError:
                child.join()
                raise RuntimeError(f"the parsing process ended with exit code {child.exitcode}") from None
            some = rb.slice(lo, PARSED_FILES)
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *got.columns], names=PARSED.names)
    except BaseException:  # the task fails or asks for no more
        child.kill()
        raise
    finally:
        here.close()
        child.join()


def _send_extracted(rb, here, there):
    here.close()
    gc.disable()  # syntax trees hold no cycles, and the process ends soon
    for lo in range(0, rb.num_rows, PARSED_FILES):
        there.send_bytes(_extracted(rb.slice(lo, PARSED_FILES)).serialize())


def _extracted(rb):
    empty = {"entities": None, "function_calls": None, "imports": None, "global_variables": None}
    cols = {k: [] for k in _EXTRACTED}
    for path, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
        try:
            if text is None:
                raise ValueError("no text")
            got, err = extract_python(path, text), None
            if "\\" in text:  # only an escape can give a lone surrogate, which cannot be stored: quarantine
                json.dumps(got, ensure_ascii=False).encode()
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            got, err = empty, f"{type(e).__name__}: {e}"
        for k in empty:
            cols[k].append(got[k])
        cols["error"].append(err)
    arrays = [_records(cols[k], kind) if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type) else pa.array(cols[k], kind)
              for k, kind in _EXTRACTED.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(_EXTRACTED))


def _records(rows, kind):
    """``pa.array(rows, kind)`` of lists of records (null: None), a field at a time: of
    records, Arrow looks up every key of each."""
    flat = [r for some in rows if some for r in some]
    fields = list(kind.value_type)
    values = pa.StructArray.from_arrays([pa.array([r[f.name] for r in flat], f.type) for f in fields], fields=fields)
    ends = accumulate((len(some) if some else 0 for some in rows), initial=0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=kind, mask=pa.array([some is None for some in rows], pa.bool_()))


# --------------------------------------------------------------------------
# DataFrame API
# --------------------------------------------------------------------------

def docstrings_of(entities) -> Column:
    """Non-empty docstrings in entity order."""
    e = F.col(entities) if isinstance(entities, str) else entities
    kept = F.filter(e, lambda x: x["docstring"].isNotNull() & (x["docstring"] != ""))
    return F.transform(kept, lambda x: x["docstring"])


def parse_code(files: DataFrame, path_col: str = "file_path", text_col: str = "raw_code",
               clean: bool = False, keep=None):
    """One ``CodeFile`` record per parsable file.

    Returns ``(code_files, quarantine)``; files that fail to parse go to
    ``quarantine(file_path, error)``. ``clean=True`` fills ``cleaned_code``
    with the B10 cleaning (the reference leaves it null). ``keep`` may stage
    the parsed rows, so that both results come from a single parse.
    """
    src = spread(files.select(F.col(path_col).alias("file_path"), F.col(text_col).alias("raw_code")))
    parsed = arrow_map(src, _parse_batches, PARSED)
    if keep is not None:
        parsed = keep(parsed)
    good = parsed.filter(F.col("error").isNull())
    code = good.select(
        "file_path", "entities", "raw_code",
        (strip_comments_and_blank_lines("raw_code") if clean
         else F.lit(None).cast("string")).alias("cleaned_code"),
        docstrings_of("entities").alias("docstrings"),
        "function_calls", "imports", "global_variables",
        F.lit(None).cast("array<long>").alias("embedding_ids"),
        F.lit(CODE_TYPE).alias("type"))
    quarantine = parsed.filter(F.col("error").isNotNull()).select("file_path", "error")
    return code, quarantine


def clean_code(col) -> Column:
    """The code cleaning helper."""
    return strip_comments_and_blank_lines(col)


def entities(code_files: DataFrame) -> DataFrame:
    """Exploded entities: file_path, ent_no, name, type, line_number, docstring,
    decorators, parents."""
    return code_files.select(F.posexplode("entities").alias("ent_no", "e")).select(
        F.col("e.file_path"), F.col("ent_no").cast("int"), "e.name", "e.type", "e.line_number",
        "e.docstring", "e.decorators", "e.parents")


def calls(code_files: DataFrame) -> DataFrame:
    """Exploded calls: file_path, call_no, caller, callee, line_number."""
    return code_files.select(F.posexplode("function_calls").alias("call_no", "c")).select(
        F.col("c.file_path"), F.col("call_no").cast("int"), "c.caller", "c.callee",
        "c.line_number")


def imports(code_files: DataFrame) -> DataFrame:
    return code_files.select("file_path", F.posexplode("imports").alias("imp_no", "module")) \
                     .withColumn("imp_no", F.col("imp_no").cast("int"))


def global_variables(code_files: DataFrame) -> DataFrame:
    return code_files.select("file_path", F.posexplode("global_variables").alias("var_no", "g")) \
                     .select("file_path", F.col("var_no").cast("int"), "g.name", "g.line_number")

"""Project corpora derived from the input tables.

The raw ``documents`` text holds no headings, fences, inline code or links,
and no table holds Python source. So the corpora the engine indexes are
derived, in Spark, from whole input tables -- every row, every character:

* ``md_pages``: each web page rewritten as Markdown (``<h1>`` to a heading,
  links to ``[text](url)``, paragraphs to blank lines) plus a short section
  with inline code and a fenced Python block built from the page id;
* ``py_parts``: one Python module per ``part`` row, written from the part's
  columns (class with bases, decorated and nested functions, calls, imports,
  assignments, docstrings).

Each builder has a SQL twin (``*_SQL``) that produces the same text in DuckDB,
which the oracle queries use as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from ..sources import table

NL = "\n"

# --------------------------------------------------------------------------
# pages -> Markdown
# --------------------------------------------------------------------------

def md_pages(spark: SparkSession, base_dir: str) -> DataFrame:
    """``file_path, raw_content`` -- one Markdown file per page."""
    p = spread(table(spark, base_dir, "pages"))
    pid = F.col("page_id").cast("string")
    md = F.regexp_replace("html", r"<h1>([^<]*)</h1>", NL + "# $1" + NL)
    md = F.regexp_replace(md, "<p>", NL + NL)
    md = F.regexp_replace(md, "<br>", NL)
    link = r'<a href="([^"]*)">([^<]*)</a>'
    md = F.when(F.col("page_id") % 2 == 0, F.regexp_replace(md, link, "[$2](/docs$1)")) \
          .otherwise(F.regexp_replace(md, link, "[$2]($1)"))
    tail = F.concat(
        F.lit(NL + NL + "## Usage" + NL + NL + "Call `pkg"), pid, F.lit(".mod.func_"), pid,
        F.lit("` or `plain` from [the API](api/v"), pid, F.lit(".html)." + NL + NL
              + "```python" + NL + "# setup" + NL + "from pkg"), pid,
        F.lit(".mod import func_"), pid, F.lit(NL + "class Page"), pid,
        F.lit(":" + NL + "    def render(self):" + NL + "        return func_"), pid,
        F.lit("()" + NL + "```" + NL))
    return p.select(
        F.concat(F.lit("docs/page_"), F.lpad(pid, 8, "0"), F.lit(".md")).alias("file_path"),
        F.concat(md, tail).alias("raw_content"))


MD_PAGES_SQL = r"""md_pages AS (
  SELECT 'docs/page_' || lpad(CAST(page_id AS VARCHAR), 8, '0') || '.md' AS file_path,
    CASE WHEN page_id % 2 = 0
      THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
             '<h1>([^<]*)</h1>', chr(10) || '# \1' || chr(10), 'g'),
             '<p>', chr(10) || chr(10), 'g'), '<br>', chr(10), 'g'),
             '<a href="([^"]*)">([^<]*)</a>', '[\2](/docs\1)', 'g')
      ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
             '<h1>([^<]*)</h1>', chr(10) || '# \1' || chr(10), 'g'),
             '<p>', chr(10) || chr(10), 'g'), '<br>', chr(10), 'g'),
             '<a href="([^"]*)">([^<]*)</a>', '[\2](\1)', 'g')
    END
    || chr(10) || chr(10) || '## Usage' || chr(10) || chr(10) || 'Call `pkg' || page_id
    || '.mod.func_' || page_id || '` or `plain` from [the API](api/v' || page_id || '.html).'
    || chr(10) || chr(10) || '```python' || chr(10) || '# setup' || chr(10) || 'from pkg' || page_id
    || '.mod import func_' || page_id || chr(10) || 'class Page' || page_id || ':' || chr(10)
    || '    def render(self):' || chr(10) || '        return func_' || page_id || '()' || chr(10)
    || '```' || chr(10) AS raw_content
  FROM pages)"""


# --------------------------------------------------------------------------
# part -> Python modules
# --------------------------------------------------------------------------
#
# Line layout of every generated module (k = p_partkey):
#  1 """Part module k."""
#  2 import os.path
#  3 from pkg{k%7} import helper_{k%5}
#  4 TOTAL_k = p_size
#  5 class Part_k(Base{k%3}, pkg.Mix, Gen[int]):
#  6     """p_name"""
#  7     price = k
#  8     @staticmethod
#  9     def size_k():
# 10         return int(os.path.join("k") or p_size)
# 11 @register
# 12 def part_k(x):
# 13     """Brand p_brand."""
# 14     y = size_k()
# 15     return part_{k+1}(y) + helper_{k%5}(x) + size_k()
# 16 @cache(maxsize=p_size)
# 17 def outer_k(a=default_{k%4}()):
# 18     def inner_k():
# 19         return h()()
# 20     return inner_k()
# 21 async def fetch_k():
# 22     return await load_k()

def _py_escape(c):
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', '\\\\"')


def py_parts(spark: SparkSession, base_dir: str) -> DataFrame:
    """``file_path, raw_code, p_partkey, p_size`` -- one Python module per part."""
    p = spread(table(spark, base_dir, "part"))
    k = F.col("p_partkey").cast("string")
    k1 = (F.col("p_partkey") + 1).cast("string")
    size = F.col("p_size").cast("string")
    m = lambda n: (F.col("p_partkey") % n).cast("string")
    code = F.concat(
        F.lit('"""Part module '), k, F.lit('."""' + NL),
        F.lit("import os.path" + NL),
        F.lit("from pkg"), m(7), F.lit(" import helper_"), m(5), F.lit(NL),
        F.lit("TOTAL_"), k, F.lit(" = "), size, F.lit(NL),
        F.lit("class Part_"), k, F.lit("(Base"), m(3), F.lit(", pkg.Mix, Gen[int]):" + NL),
        F.lit('    """'), _py_escape(F.col("p_name")), F.lit('"""' + NL),
        F.lit("    price = "), k, F.lit(NL),
        F.lit("    @staticmethod" + NL),
        F.lit("    def size_"), k, F.lit("():" + NL),
        F.lit('        return int(os.path.join("'), k, F.lit('") or '), size, F.lit(")" + NL),
        F.lit("@register" + NL),
        F.lit("def part_"), k, F.lit("(x):" + NL),
        F.lit('    """Brand '), _py_escape(F.col("p_brand")), F.lit('."""' + NL),
        F.lit("    y = size_"), k, F.lit("()" + NL),
        F.lit("    return part_"), k1, F.lit("(y) + helper_"), m(5), F.lit("(x) + size_"), k,
        F.lit("()" + NL),
        F.lit("@cache(maxsize="), size, F.lit(")" + NL),
        F.lit("def outer_"), k, F.lit("(a=default_"), m(4), F.lit("()):" + NL),
        F.lit("    def inner_"), k, F.lit("():" + NL),
        F.lit("        return h()()" + NL),
        F.lit("    return inner_"), k, F.lit("()" + NL),
        F.lit("async def fetch_"), k, F.lit("():" + NL),
        F.lit("    return await load_"), k, F.lit("()" + NL))
    return p.select(
        F.concat(F.lit("src/part_"), F.lpad(k, 8, "0"), F.lit(".py")).alias("file_path"),
        code.alias("raw_code"), "p_partkey", "p_size")


PY_PARTS_SQL = r'''py_parts AS (
  SELECT p_partkey, 'src/part_' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.py' AS file_path,
    '"""Part module ' || p_partkey || '."""' || chr(10)
    || 'import os.path' || chr(10)
    || 'from pkg' || (p_partkey % 7) || ' import helper_' || (p_partkey % 5) || chr(10)
    || 'TOTAL_' || p_partkey || ' = ' || p_size || chr(10)
    || 'class Part_' || p_partkey || '(Base' || (p_partkey % 3) || ', pkg.Mix, Gen[int]):' || chr(10)
    || '    """' || replace(replace(p_name, '\', '\\'), '"', '\"') || '"""' || chr(10)
    || '    price = ' || p_partkey || chr(10)
    || '    @staticmethod' || chr(10)
    || '    def size_' || p_partkey || '():' || chr(10)
    || '        return int(os.path.join("' || p_partkey || '") or ' || p_size || ')' || chr(10)
    || '@register' || chr(10)
    || 'def part_' || p_partkey || '(x):' || chr(10)
    || '    """Brand ' || replace(replace(p_brand, '\', '\\'), '"', '\"') || '."""' || chr(10)
    || '    y = size_' || p_partkey || '()' || chr(10)
    || '    return part_' || (p_partkey + 1) || '(y) + helper_' || (p_partkey % 5) || '(x) + size_'
    || p_partkey || '()' || chr(10)
    || '@cache(maxsize=' || p_size || ')' || chr(10)
    || 'def outer_' || p_partkey || '(a=default_' || (p_partkey % 4) || '()):' || chr(10)
    || '    def inner_' || p_partkey || '():' || chr(10)
    || '        return h()()' || chr(10)
    || '    return inner_' || p_partkey || '()' || chr(10)
    || 'async def fetch_' || p_partkey || '():' || chr(10)
    || '    return await load_' || p_partkey || '()' || chr(10) AS raw_code
  FROM part)'''


# --------------------------------------------------------------------------
# documents -> long Python modules that share names
# --------------------------------------------------------------------------
#
# Line layout (k = doc_id); the text takes as many lines as it has:
#  1 class Reader(Base):
#  2     def load(self):
#  3         return parse(self.path)
#  4 def load():
#  5     return doc_k()
#  6 def doc_k():
#  7     """From source."""
#  8     return helper_{k%5}(load())
#  9 TEXT = """the whole text"""

_QUOTED = '\\"\r'  # characters that would end or change the literal: a space each


def doc_modules(spark: SparkSession, base_dir: str) -> DataFrame:
    """``file_path, raw_code, doc_id`` -- one Python module per document, with
    its whole text. ``load`` and ``Reader`` are defined in every file."""
    d = spread(table(spark, base_dir, "documents"))
    k = F.col("doc_id").cast("string")
    clean = lambda c: F.translate(F.coalesce(F.col(c), F.lit("")), _QUOTED, "   ")
    code = F.concat(
        F.lit("class Reader(Base):" + NL + "    def load(self):" + NL + "        return parse(self.path)" + NL),
        F.lit("def load():" + NL + "    return doc_"), k, F.lit("()" + NL),
        F.lit("def doc_"), k, F.lit("():" + NL + '    """From '), clean("source"), F.lit('."""' + NL),
        F.lit("    return helper_"), (F.col("doc_id") % 5).cast("string"), F.lit("(load())" + NL),
        F.lit('TEXT = """'), clean("text"), F.lit('"""' + NL))
    return d.select(F.concat(F.lit("lib/doc_"), F.lpad(k, 10, "0"), F.lit(".py")).alias("file_path"),
                    code.alias("raw_code"), "doc_id")


_CLEAN = "translate(coalesce({}, ''), '\\\"' || chr(13), '   ')"
DOC_MODULES_SQL = f"""doc_modules AS (
  SELECT doc_id, 'lib/doc_' || lpad(CAST(doc_id AS VARCHAR), 10, '0') || '.py' AS file_path, {_CLEAN.format('source')} AS origin,
    'class Reader(Base):' || chr(10) || '    def load(self):' || chr(10) || '        return parse(self.path)' || chr(10)
    || 'def load():' || chr(10) || '    return doc_' || doc_id || '()' || chr(10)
    || 'def doc_' || doc_id || '():' || chr(10) || '    \"\"\"From ' || {_CLEAN.format('source')} || '.\"\"\"' || chr(10)
    || '    return helper_' || (doc_id % 5) || '(load())' || chr(10)
    || 'TEXT = \"\"\"' || {_CLEAN.format('text')} || '\"\"\"' || chr(10) AS raw_code
  FROM documents)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --------------------------------------------------------------------------
# questions and model replies
# --------------------------------------------------------------------------
#
# Questions: one per part (template by key mod 4) and every conversation turn
# as asked (non-ASCII prose). Replies: one per part question, shaped by key
# mod 7 -- valid JSON, fenced JSON, single quotes, a missing key, no reply,
# truncated JSON, and a code-related reply that names nothing.

CONV_QID_BASE = 1_000_000_000


def question_table(spark: SparkSession, base_dir: str) -> DataFrame:
    """``query_id, query_text``."""
    p = spread(table(spark, base_dir, "part"))
    k = F.col("p_partkey").cast("string")
    t = F.col("p_partkey") % 4
    text = (F.when(t == 0, F.concat(F.lit("What does function part_"), k, F.lit("() call?")))
             .when(t == 1, F.concat(F.lit("Where is the doc for Part_"), k, F.lit("?")))
             .when(t == 2, F.concat(F.lit("  Explain size_"), k, F.lit("() in module Helper"),
                                    (F.col("p_partkey") % 5).cast("string"), F.lit(" and h()  ")))
             .otherwise(F.concat(F.lit("Héllo wörld, tell me about outer_"), k, F.lit(" "))))
    parts = p.select(F.col("p_partkey").alias("query_id"), text.alias("query_text"))
    c = spread(table(spark, base_dir, "conversations"))
    convs = c.select((F.lit(CONV_QID_BASE) + F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
                     F.col("text").alias("query_text"))
    return parts.unionByName(convs)


def reply_table(spark: SparkSession, base_dir: str) -> DataFrame:
    """``query_id, text`` (text may be null)."""
    p = table(spark, base_dir, "part")
    k = F.col("p_partkey").cast("string")
    t = F.col("p_partkey") % 7
    text = (F.when(t == 0, F.concat(F.lit('{"functions": ["part_'), k, F.lit('", "nosuch_'), k,
                                    F.lit('", "size_'), k, F.lit('"], "modules": ["Part_'), k,
                                    F.lit('"], "classification": "code-related"}')))
             .when(t == 1, F.concat(F.lit('```json\n{"functions": [], "modules": ["Part_'), k,
                                    F.lit('"], "classification": "documentation-related"}\n```')))
             .when(t == 2, F.concat(F.lit("{'functions': ['outer_"), k,
                                    F.lit("', 'h'], 'modules': [], 'classification': 'code-related'}")))
             .when(t == 3, F.concat(F.lit('{"functions": ["part_'), k,
                                    F.lit('"], "classification": "code-related"}')))
             .when(t == 4, F.lit(None).cast("string"))
             .when(t == 5, F.concat(F.lit('{"functions": ["part_'), k, F.lit('"')))
             .otherwise(F.lit('{"functions": [], "modules": [], "classification": "code-related"}')))
    return p.select(F.col("p_partkey").alias("query_id"), text.alias("text"))


QUESTIONS_SQL = r"""questions AS (
  SELECT p_partkey AS query_id,
    CASE p_partkey % 4
      WHEN 0 THEN 'What does function part_' || p_partkey || '() call?'
      WHEN 1 THEN 'Where is the doc for Part_' || p_partkey || '?'
      WHEN 2 THEN '  Explain size_' || p_partkey || '() in module Helper' || (p_partkey % 5) || ' and h()  '
      ELSE 'Héllo wörld, tell me about outer_' || p_partkey || ' '
    END AS query_text
  FROM part
  UNION ALL
  SELECT 1000000000 + conv_id * 1000 + turn, text FROM conversations),
replies AS (
  SELECT p_partkey AS query_id,
    CASE p_partkey % 7
      WHEN 0 THEN '{"functions": ["part_' || p_partkey || '", "nosuch_' || p_partkey || '", "size_'
                  || p_partkey || '"], "modules": ["Part_' || p_partkey || '"], "classification": "code-related"}'
      WHEN 1 THEN '```json' || chr(10) || '{"functions": [], "modules": ["Part_' || p_partkey
                  || '"], "classification": "documentation-related"}' || chr(10) || '```'
      WHEN 2 THEN '{''functions'': [''outer_' || p_partkey || ''', ''h''], ''modules'': [], ''classification'': ''code-related''}'
      WHEN 3 THEN '{"functions": ["part_' || p_partkey || '"], "classification": "code-related"}'
      WHEN 4 THEN NULL
      WHEN 5 THEN '{"functions": ["part_' || p_partkey || '"'
      ELSE '{"functions": [], "modules": [], "classification": "code-related"}'
    END AS text
  FROM part)"""

"""Question processing (G1-G15) over a batch ``queries(query_id, query_text)``.

The language-model call is outside the engine: prompts leave as a table and
replies come back as ``responses(query_id, text)``; everything in between --
normalising, classifying, reading replies, linking names to the graph,
nearest-vector context, prompt assembly -- is column expressions and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import preprocess_query as _preprocess
from ..functions.text import strip_
from .ids import dense_ids

# Classification labels and keywords, heuristic patterns.
DOC_LABEL, CODE_LABEL, INVALID_LABEL = "documentation", "code", "Invalid"
DOC_REPLY, CODE_REPLY = "documentation-related", "code-related"
DOC_WORDS = ("documentation", "doc")
CODE_WORDS = ("function", "module", "code")
FUNC_PATTERN = r"(?U)\b\w+\(\)"
NAME_PATTERN = r"(?U)\b[A-Z][a-zA-Z0-9_]+\b"
REPLY_KEYS = ("functions", "modules", "classification")
REPLY_SCHEMA = "struct<functions:array<string>,modules:array<string>,classification:string>"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def preprocess_query(col) -> Column:
    """G1."""
    return _preprocess(col)


def clean_response(col) -> Column:
    """Drop a leading ```json and a trailing ```, stripping after each cut."""
    t = _c(col)
    t = F.when(t.startswith("```json"), strip_(F.substr(t, F.lit(8)))).otherwise(t)
    return F.when(t.endswith("```"), strip_(F.substr(t, F.lit(1), F.length(t) - 3))).otherwise(t)


def heuristic_functions(col) -> Column:
    """``name()`` mentions, parentheses kept, repeats kept."""
    return F.regexp_extract_all(_c(col), F.lit(FUNC_PATTERN), 0)


def heuristic_modules(col) -> Column:
    """Capitalised words of two or more characters."""
    return F.regexp_extract_all(_c(col), F.lit(NAME_PATTERN), 0)


def classify(col) -> Column:
    """G4: "doc" anywhere wins, then function/module/code, else Invalid."""
    q = F.lower(_c(col))
    is_doc = q.contains("documentation") | q.contains("doc")
    is_code = q.contains("function") | q.contains("module") | q.contains("code")
    return F.when(is_doc, F.lit(DOC_LABEL)).when(is_code, F.lit(CODE_LABEL)).otherwise(F.lit(INVALID_LABEL))


# String literals and everything but brackets, for _one_value.
_JSON_STRING = r'"(?:[^"\\]|\\.)*+"'


def _one_value(s: Column) -> Column:
    """Whether the text is a single bracketed value: with strings taken out, the
    bracket that opens it closes at the last character and not before."""
    marks = F.regexp_replace(F.regexp_replace(strip_(s), F.lit(_JSON_STRING), F.lit("")), F.lit(r"[^{}\[\]]+"), F.lit("-"))
    steps = F.split(F.regexp_replace(marks, F.lit("-"), F.lit("")), "")
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("open"), F.lit(0).alias("closed")), lambda acc, c: F.struct(
        (acc["open"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)).alias("open"),
        (acc["closed"] + F.when(c.isin("}", "]") & (acc["open"] == 1), 1).otherwise(0)).alias("closed")))
    return marks.startswith("{") & marks.endswith("}") & (depth["open"] == 0) & (depth["closed"] == 1)


def _json_object(s: Column) -> Column:
    """JSON object test: parses as JSON, is an object, and nothing follows it
    (``try_parse_json`` alone accepts text after the value)."""
    return F.try_parse_json(s).isNotNull() & F.json_object_keys(s).isNotNull() & _one_value(s)


def read_replies(queries: DataFrame, responses: DataFrame | None, strict: bool = False) -> DataFrame:
    """G2 + G6 + G15: the extraction for every query.

    Returns ``query_id, query, status, functions, modules, classification``
    where ``status`` is ``reply`` (usable JSON), ``rejected`` (code-related
    but names nothing: the reference returns ``{}``) or ``fallback``
    (no reply, bad JSON or a missing key: heuristics on the query).
    By default fallback labels are mapped to the reply labels and ``()`` is
    dropped from heuristic names so they can link; ``strict=True`` keeps the
    written behaviour, where a fallback never routes.
    """
    q = queries.select("query_id", preprocess_query("query_text").alias("query"))
    if responses is not None:
        r = responses.select("query_id", F.col("text").alias("_raw"))
        q = q.join(r, "query_id", "left")
    else:
        q = q.withColumn("_raw", F.lit(None).cast("string"))
    raw = F.col("_raw")
    reply = F.when(raw.isNull() | (strip_(raw) == ""), F.lit(None)).otherwise(clean_response(raw))
    q = q.withColumn("_reply", reply)
    fixed = F.replace(F.col("_reply"), F.lit("'"), F.lit('"'))
    src = F.when(_json_object(F.col("_reply")), F.col("_reply")) \
           .when(_json_object(fixed), fixed)
    q = q.withColumn("_src", src)
    keys = F.json_object_keys(F.col("_src"))
    has_all = F.lit(True)
    for k in REPLY_KEYS:
        has_all = has_all & F.coalesce(F.array_contains(keys, k), F.lit(False))
    parsed = F.from_json(F.col("_src"), REPLY_SCHEMA, {"allowSingleQuotes": "false"})
    q = q.withColumn("_ok", has_all).withColumn("_p", parsed)

    funcs_h = heuristic_functions("query")
    mods_h = heuristic_modules("query")
    label = classify("query")
    if not strict:
        funcs_h = F.transform(funcs_h, lambda x: F.regexp_replace(x, r"\(\)$", ""))
        label = F.when(label == CODE_LABEL, F.lit(CODE_REPLY)) \
                 .when(label == DOC_LABEL, F.lit(DOC_REPLY)).otherwise(label)
    empty = F.array().cast("array<string>")
    nothing = (F.coalesce(F.size(F.col("_p.functions")), F.lit(0)) <= 0) & \
              (F.coalesce(F.size(F.col("_p.modules")), F.lit(0)) <= 0)
    rejected = F.col("_ok") & (F.col("_p.classification") == CODE_REPLY) & nothing
    status = F.when(~F.col("_ok"), F.lit("fallback")).when(rejected, F.lit("rejected")) \
              .otherwise(F.lit("reply"))
    q = q.withColumn("status", status)
    pick = lambda reply_col, fb, rej: (F.when(F.col("status") == "reply", reply_col)
                                        .when(F.col("status") == "fallback", fb).otherwise(rej))
    return q.select(
        "query_id", "query", "status",
        pick(F.coalesce(F.col("_p.functions"), empty), funcs_h, empty).alias("functions"),
        pick(F.coalesce(F.col("_p.modules"), empty), mods_h, empty).alias("modules"),
        pick(F.col("_p.classification"), label, F.lit(None).cast("string")).alias("classification"))


def route(classification) -> Column:
    """Which answer path a query takes."""
    c = _c(classification)
    return F.when(c == CODE_REPLY, F.lit("code")).when(c == DOC_REPLY, F.lit("documentation")) \
            .otherwise(F.lit("invalid"))


def known_names(code_files: DataFrame) -> DataFrame:
    """Entity names by type over all files, with how often each occurs
    (the reference's lists keep repeats; empty names are skipped)."""
    e = code_files.select(F.explode("entities").alias("e")).select("e.type", "e.name")
    return (e.filter(F.col("type").isin("function", "class") & (F.col("name") != ""))
             .groupBy("type", "name").agg(F.count(F.lit(1)).alias("n")))


def link_entities(extractions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Functions then modules, kept when a graph node has that name;
    ``pos`` keeps the mention order (repeats kept)."""
    names = extractions.select("query_id", F.posexplode(F.concat("functions", "modules"))
                               .alias("pos", "name"))
    return names.join(nodes.select("name"), "name", "left_semi") \
                .select("query_id", F.col("pos").cast("int").alias("pos"), "name")


def node_text(names: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """G8 for each distinct ``name``: ``Node: n`` plus ``. Depends on: a, b`` when
    n has callees, in first-call order.

    ``most`` keeps the first so many callees. An embedder that truncates its
    input at ``t`` tokens sees no more than ``t`` of them, so with ``most=t`` its
    vectors are the same while a hub's text stays bounded; the limit is applied
    before the shuffle as well (WindowGroupLimit)."""
    order = [F.col("first_file").isNull(), F.col("first_file"), F.col("first_seq"), F.col("dst")]
    distinct = names.select("name").distinct()
    own = edges.join(distinct.withColumnRenamed("name", "src"), "src", "left_semi")
    if most is not None:
        nth = F.row_number().over(Window.partitionBy("src").orderBy(*order))
        own = own.withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_nth")
    deps = (own.groupBy("src")
               .agg(F.array_sort(F.collect_list(F.struct(
                   order[0].alias("bare"), order[1].alias("f"), order[2].alias("s"), order[3].alias("d")))).alias("_deps"))
               .select(F.col("src").alias("name"), F.array_join(F.transform("_deps", lambda x: x["d"]), ", ").alias("_deps")))
    text = F.when(F.col("_deps").isNotNull() & (F.col("_deps") != ""),
                  F.concat(F.lit("Node: "), F.col("name"), F.lit(". Depends on: "), F.col("_deps"))) \
            .otherwise(F.concat(F.lit("Node: "), F.col("name")))
    return distinct.join(deps, "name", "left").select("name", text.alias("text"))


def neighbour_rows(names: DataFrame, edges: DataFrame) -> DataFrame:
    """G8 as rows: ``name, place, callee`` for each distinct ``name``, its callees
    numbered from 1 in first-call order (one row with nulls where it has none).

    All edges of the names are numbered in one order by a range partition, and a
    name's first number is taken off, so a hub's callees are spread over tasks
    and never meet in a row, a sort or a window."""
    distinct = names.select("name").distinct()
    own = edges.join(distinct.withColumnRenamed("name", "src"), "src", "left_semi") \
        .select("src", F.col("first_file").isNull().alias("bare"), "first_file", "first_seq", "dst")
    at = dense_ids(own, ["src", "bare", "first_file", "first_seq", "dst"], "at").select("src", "dst", "at")
    first = at.groupBy("src").agg(F.min("at").alias("first"))
    placed = at.join(first, "src").select(F.col("src").alias("name"), (F.col("at") - F.col("first") + 1).alias("place"),
                                          F.col("dst").alias("callee"))
    return distinct.join(placed, "name", "left")


def mentions(linked: DataFrame) -> DataFrame:
    """The distinct nodes of each question, with the place of the first mention."""
    return linked.groupBy("query_id", "name").agg(F.min("pos").alias("pos"))


def neighbour_text(linked: DataFrame, edges: DataFrame) -> DataFrame:
    """The text of ``node_text``, whole, once per distinct (query, node)."""
    return mentions(linked).join(node_text(linked, edges), "name").select("query_id", "pos", "name", "text")


# --------------------------------------------------------------------------
# prompts (G11-G13); the fixed texts are the reference's prompt formats
# --------------------------------------------------------------------------

RULE = "-" * 80

# The extraction prompt text.
EXTRACTION_HEAD = (
    "You are an assistant that classifies developer queries and extracts mentioned entities.\n\n"
    "You are given:\n"
    "- A context of known function and class names from a codebase (see below).\n"
    "- A user query that may refer to code, documentation, or both.\n\n"
    "Code Context:\n")
EXTRACTION_TAIL = (
    "Your tasks:\n"
    "1. From the context, extract which function names are mentioned in the query.\n"
    "2. From the context, extract which class/module names are mentioned in the query.\n"
    "3. Classify the query as one of the following:\n"
    "   - \"code-related\" → focuses on implementation, debugging, performance, or how code "
    "works. Queries that are a mix of Code structure + Doc explanation can also be classified in "
    "this category\n"
    "   - \"documentation-related\" → focuses on usage, purpose, description, or explanations "
    "from docs.\n"
    "Important rules:\n"
    "- Do NOT invent names. Only use names from the Code Context.\n"
    "- Use \"code-related\" **if both code and documentation are relevant** in the query.\n"
    "- Return a valid JSON object with keys: \"functions\", \"modules\", and \"classification\".\n"
    "- Double quotes must be used in JSON keys and string values.\n\n")

# The documentation answer prompt.
DOC_PROMPT_INSTRUCTIONS = (
    "### Instructions:\n"
    "- Use the documentation above to answer the query.\n"
    "- Be concise and accurate.\n"
    "- If the documentation does not directly address the query, say so explicitly.\n")

# The code answer prompt.
CODE_PROMPT_DOC_INTRO = (
    "In addition to the code, here is the documentation that might relate to the user's "
    "question.\n"
    "Use this documentation **only if** it helps clarify how the mentioned code entities work, "
    "are used, or are described in the broader system:\n")
CODE_PROMPT_INSTRUCTIONS = (
    "### Instructions:\n"
    "- Focus primarily on answering based on the code logic, structure, and functionality.\n"
    "- Use the documentation only if it enhances the answer about the code entities.\n"
    "- If the documentation does not clearly relate to the mentioned code entities, "
    "**ignore it**.\n"
    "- Provide a clear and technically grounded explanation.\n")


def _json_str_list(arr: Column) -> Column:
    """A JSON list of strings laid out like ``json.dumps(..., indent=2)`` at
    depth one."""
    esc = F.transform(arr, lambda x: F.concat(
        F.lit('"'), F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), '"', '\\\\"'), F.lit('"')))
    return F.when(F.size(arr) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("[\n    "), F.array_join(esc, ",\n    "), F.lit("\n  ]")))


def prompt_context(code_files: DataFrame) -> DataFrame:
    """G11's name context, whole: every known function and class name with how
    often it occurs, numbered in order of type and name (``pos, type, name, n``).

    It is the same for every question, so it is one table, written once, to which
    all prompts of a batch refer, rather than a copy in each prompt."""
    from .ids import dense_ids
    return dense_ids(known_names(code_files), ["type", "name"], "pos").select("pos", "type", "name", "n")


def extraction_prompts(queries: DataFrame, code_files: DataFrame) -> DataFrame:
    """The extraction prompt per query.

    Every known name stands in ``prompt_context``; a prompt repeats from it
    what its question mentions: its context holds the distinct known names that
    occur as words of the query (a distributed join of query words against
    the name table), not every name of the corpus with repeats, so no prompt
    grows with the corpus and nothing passes through the driver."""
    words = queries.select("query_id", F.explode(F.array_distinct(
        F.regexp_extract_all(F.col("query"), F.lit(r"(?U)\w+"), 0))).alias("name"))
    # the parsed names are far more than the source's size suggests: never let that
    # estimate broadcast them through the driver
    names = known_names(code_files).hint("merge")
    hits = words.join(names, "name").select("query_id", "type", "name")
    ctx = (hits.groupBy("query_id")
           .agg(F.array_sort(F.collect_set(F.when(F.col("type") == "function", F.col("name")))).alias("f"),
                F.array_sort(F.collect_set(F.when(F.col("type") == "class", F.col("name")))).alias("c")))
    q = queries.join(ctx, "query_id", "left")
    empty = F.array().cast("array<string>")
    ctx_json = F.concat(F.lit('{\n  "function": '), _json_str_list(F.coalesce("f", empty)),
                        F.lit(',\n  "class": '), _json_str_list(F.coalesce("c", empty)), F.lit("\n}"))
    prompt = F.concat(F.lit(EXTRACTION_HEAD), ctx_json, F.lit("\n\nUser Query:\n\""), F.col("query"),
                      F.lit("\"\n\n"), F.lit(EXTRACTION_TAIL))
    return q.select("query_id", prompt.alias("prompt"))


def doc_prompt(query: Column, doc_context: Column) -> Column:
    """G13 (doc context as plain text, see Q8)."""
    return F.concat(
        F.lit("The user asked the following documentation-related query:\n\""), query,
        F.lit("\"\n\nBelow is the relevant documentation extracted from the codebase:\n"
              + RULE + "\n"), F.coalesce(doc_context, F.lit("")),
        F.lit("\n" + RULE + "\n" + DOC_PROMPT_INSTRUCTIONS))


def code_prompt(query: Column, node_list: Column, n_nodes: Column, code_context: Column,
                doc_context: Column) -> Column:
    """Code answer prompt; ``node_list`` is the printed list of nodes and
    ``code_context`` the joined per-node code sections (empty when none)."""
    return F.concat(
        F.lit("The user has asked the following query related to code entities: "), query,
        F.lit("\n\n## Code Entities Mentioned ("), n_nodes.cast("string"), F.lit(" total): "),
        node_list, F.lit("\nBelow is the raw code relevant to these nodes:\n" + RULE + "\n"),
        F.coalesce(code_context, F.lit("")),
        F.lit("\n" + RULE + "\n" + CODE_PROMPT_DOC_INTRO + RULE + "\n"),
        F.coalesce(doc_context, F.lit("")),
        F.lit("\n" + RULE + "\n" + CODE_PROMPT_INSTRUCTIONS))

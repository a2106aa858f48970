"""Documentation extraction (C1-C9): native regex expressions only.

Each function maps a text column to a column; ``parse_docs`` assembles the
documentation record. Patterns follow Python ``re`` semantics (see
``corpuslens.functions.text`` for the Java flags that achieve that).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, collapse_ws, header_lines, squeeze_blank_lines, strip_

# The extraction patterns, in Python's syntax (``\s`` also means
# white space beyond ASCII; the heading is multiline, the fence is the intended one).
HEADING_PATTERN = r"^(#{1,6})\s+(.+?)$"
FENCE_PATTERN = r"```[^\n]*\n(.*?)```"
DEF_PATTERN = r"def\s+([a-zA-Z0-9_]+)"
CLASS_PATTERN = r"class\s+([a-zA-Z0-9_]+)"
IMPORT_PATTERN = r"(?:from|import)\s+([a-zA-Z0-9_.]+)"
INLINE_CODE = r"`([a-zA-Z0-9_.]+\.[a-zA-Z0-9_]+)`"
LINK = r"\[([^\]]+)\]\(([^)]+)\)"
LINK_WORDS = ("api", "doc")  # one of them is in a kept link's lower-cased url


def _java(pattern: str, flags: str) -> str:
    return f"(?{flags})" + pattern.replace(r"\s", WS)


HEADING = _java(HEADING_PATTERN, "mdU")
FENCE = _java(FENCE_PATTERN, "s")
FENCE_DEF, FENCE_CLASS, FENCE_IMPORT = (_java(p, "U") for p in (DEF_PATTERN, CLASS_PATTERN, IMPORT_PATTERN))
SIX_BACKTICKS = "``````"
DOC_TYPE = "DocumentationFile.class"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _extract(col, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(_c(col), F.lit(pattern), group)


def sections(text) -> Column:
    """Heading titles, stripped, in document order."""
    return F.transform(_extract(text, HEADING, 2), lambda t: strip_(t))


def fenced_refs(text, strict: bool = False) -> Column:
    """Names defined or imported inside fenced code blocks.

    ``strict=True`` reproduces the written pattern (six literal backticks
    with no group): it never yields a name (see ``parse_docs`` for the rest).
    """
    if strict:
        return F.array().cast("array<string>")
    bodies = _extract(text, FENCE, 1)
    return F.flatten(F.transform(bodies, lambda b: F.concat(
        _extract(b, FENCE_DEF, 1), _extract(b, FENCE_CLASS, 1), _extract(b, FENCE_IMPORT, 1))))


def inline_refs(text) -> Column:
    """Dotted names in inline code."""
    return _extract(text, INLINE_CODE, 1)


def link_refs(text) -> Column:
    """C4: ``text (url)`` for links whose lower-cased url has "api" or "doc"."""
    t = _c(text)
    pairs = F.arrays_zip(_extract(t, LINK, 1).alias("t"), _extract(t, LINK, 2).alias("u"))
    keep = F.filter(pairs, lambda p: F.lower(p["u"]).contains("api") | F.lower(p["u"]).contains("doc"))
    return F.transform(keep, lambda p: F.concat(p["t"], F.lit(" ("), p["u"], F.lit(")")))


def api_reference_list(text, strict: bool = False) -> Column:
    """Distinct references in code-point order."""
    return F.array_sort(F.array_distinct(F.concat(
        fenced_refs(text, strict), inline_refs(text), link_refs(text))))


def parse_docs(files: DataFrame, text_col: str = "raw_content", strict: bool = False):
    """One documentation record per file.

    Returns ``(docs, quarantine)``. With ``strict=True`` a file containing six
    backticks in a row is sent to quarantine, as the written parser fails on
    it; by default fences are read as fences.
    """
    t = F.col(text_col)
    refs = api_reference_list(t, strict)
    out = files.select(
        "file_path",
        sections(t).alias("sections"),
        t.alias("raw_content"),
        squeeze_blank_lines(t).alias("cleaned_content"),
        F.array_join(refs, ", ").alias("api_references"),
        refs.alias("api_references_arr"),
        F.lit(-1).cast("long").alias("embedding_id"),
        F.lit(DOC_TYPE).alias("type"))
    if not strict:
        return out, files.limit(0).select("file_path", F.lit(None).cast("string").alias("error"))
    bad = t.contains(SIX_BACKTICKS)
    quarantine = files.filter(bad).select(
        "file_path", F.lit("fence pattern has no group").alias("error"))
    return out.filter(~F.col("raw_content").contains(SIX_BACKTICKS)), quarantine


def preprocess_documentation(text) -> Column:
    """Every whitespace run to one space (not trimmed)."""
    return collapse_ws(text)


def extract_sections(text) -> Column:
    """Lines starting with ``#``, stripped."""
    return header_lines(text)

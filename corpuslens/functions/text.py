"""Text helpers as native Spark column expressions.

The behaviour being reproduced is that of Python's ``str`` methods and ``re``
module, whose character classes are Unicode-aware and whose line ends differ
from Java's. Every helper returns a ``Column`` built from JVM functions, so it
stays inside whole-stage code generation and never calls into Python.

Java regex notes used below:
  (?U)  Unicode character classes, so ``\\s``/``\\w``/``\\b`` follow Unicode
        like Python 3 ``str`` patterns do.
  (?d)  only ``\\n`` ends a line for ``^``, ``$`` and ``.`` -- Python's rule.
Python's ``\\s`` also matches U+001C..U+001F, which Java never does, so the
whitespace class is spelled out as ``[\\s\\x1C-\\x1F]``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Python whitespace class and the line boundaries of
# str.splitlines(), in Java regex syntax.
WS = r"[\s\x1C-\x1F]"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_(col) -> Column:
    """Python ``str.strip()`` (Unicode whitespace; ``trim`` strips spaces only)."""
    c = _c(col)
    c = F.regexp_replace(c, r"(?U)^" + WS + "+", "")
    return F.regexp_replace(c, r"(?U)" + WS + r"+\z", "")


def splitlines_(col) -> Column:
    """Python ``str.splitlines()`` as an array: no trailing empty element, and
    an empty string gives an empty array."""
    c = _c(col)
    parts = F.split(c, LINE_BREAK, -1)
    drop_last = (c == F.lit("")) | c.rlike(r"(?:" + LINE_BREAK + r")\z")
    return F.when(c.isNull(), F.lit(None)).when(
        drop_last, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def universal_newlines(col) -> Column:
    """Text-mode file reading: ``\\r\\n`` and lone ``\\r`` become ``\\n``."""
    return F.regexp_replace(_c(col), r"\r\n?", "\n")


def collapse_ws(col) -> Column:
    """``re.sub(r"\\s+", " ", text)`` -- documentation whitespace collapse."""
    return F.regexp_replace(_c(col), r"(?U)" + WS + "+", " ")


def squeeze_blank_lines(col) -> Column:
    """``re.sub(r"\\n\\s*\\n", "\\n\\n", text)`` -- documentation cleaning."""
    return F.regexp_replace(_c(col), r"(?U)\n" + WS + r"*\n", "\n\n")


def strip_comments_and_blank_lines(col) -> Column:
    """Code cleaning (B10): drop ``#`` to end of line (inside strings too),
    strip every line, drop empty lines, join with ``\\n``."""
    no_comments = F.regexp_replace(_c(col), r"(?d)#.*", "")
    lines = F.transform(splitlines_(no_comments), lambda l: strip_(l))
    return F.array_join(F.filter(lines, lambda l: l != F.lit("")), "\n")


def header_lines(col) -> Column:
    """Lines that start with ``#``, stripped, marks kept."""
    lines = F.filter(splitlines_(col), lambda l: l.startswith("#"))
    return F.transform(lines, lambda l: strip_(l))


def drop_non_ascii(col) -> Column:
    """``s.encode("ascii", errors="ignore").decode()``."""
    return F.regexp_replace(_c(col), r"[^\x00-\x7F]", "")


def preprocess_query(col) -> Column:
    """Question normalisation (G1): strip first, then drop non-ASCII characters
    (so a space next to a dropped character may now lead or trail)."""
    return drop_non_ascii(strip_(col))

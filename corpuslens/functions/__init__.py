"""Column-level helpers (JVM expressions only)."""

from .text import (  # noqa: F401
    WS,
    LINE_BREAK,
    collapse_ws,
    drop_non_ascii,
    header_lines,
    preprocess_query,
    splitlines_,
    squeeze_blank_lines,
    strip_,
    strip_comments_and_blank_lines,
    universal_newlines,
)

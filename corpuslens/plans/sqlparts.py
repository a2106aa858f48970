"""DuckDB SQL fragments shared by the oracle queries.

Each fragment restates, in plain SQL over the input tables, what a Spark
operator computes, so the pair can be compared row by row.
"""

from __future__ import annotations

from ..operators.vectors import MAX_TOKENS, TOKEN_PATTERN

SQL_TOKEN_PATTERN = TOKEN_PATTERN


def sql_tokens(text_expr: str, limit: int | None = None) -> str:
    toks = f"regexp_extract_all(lower({text_expr}), '{SQL_TOKEN_PATTERN}', 0)"
    return f"list_slice({toks}, 1, {limit})" if limit else toks


def sql_embedding_tokens(tokens_expr: str, dim: int, max_tokens: int = MAX_TOKENS) -> str:
    """The HashedEmbedder in SQL over a token list: md5 buckets, counts,
    L2 norm, FLOAT."""
    buckets = (f"list_transform(list_slice({tokens_expr}, 1, {max_tokens}), "
               f"lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % {dim})")
    counts = (f"list_transform(range(0, {dim}), "
              f"lambda j: len(list_filter(b, lambda x: x = j))::DOUBLE)")
    # b and c are bound through one-element list_transforms to avoid recomputing them
    return (f"(list_transform([{buckets}], lambda b: "
            f"list_transform([{counts}], lambda c: "
            f"list_transform(c, lambda x: CASE WHEN list_sum(list_transform(c, lambda y: y * y)) > 0 "
            f"THEN (x / sqrt(list_sum(list_transform(c, lambda y: y * y))))::FLOAT "
            f"ELSE 0::FLOAT END))[1]))[1]")


def sql_embedding(text_expr: str, dim: int, max_tokens: int = MAX_TOKENS) -> str:
    """The HashedEmbedder in SQL over a text."""
    return sql_embedding_tokens(sql_tokens(text_expr), dim, max_tokens)


def sql_l2(a: str, b: str) -> str:
    """Squared L2 distance of two FLOAT lists, in DOUBLE."""
    return (f"list_sum(list_transform(list_zip({a}, {b}), "
            f"lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))")


def sql_rank_key(dist: str, decimals: int | None) -> str:
    if decimals is None:
        return dist
    return f"floor({dist} * 1e{decimals} + 0.5)"

"""Structured Streaming jobs (incremental ingest of new source files)."""

from .incremental import apply_batch, graph_tables, start_incremental_ingest  # noqa: F401

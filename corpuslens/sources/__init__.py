"""Scans and sinks: input tables, the source-file reader and the table store."""

from .tables import INPUT_TABLES, register_views, table  # noqa: F401

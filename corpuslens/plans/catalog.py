"""All registered queries; importing this module fills the registry."""

from __future__ import annotations

from . import q_code, q_docs, q_graph, q_ingest, q_long, q_meta, q_questions, q_retrieve, q_store, q_vectors  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

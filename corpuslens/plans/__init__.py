"""Query plans: derived corpora, ingest and retrieval jobs, the query catalog."""

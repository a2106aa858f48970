"""DataFrame operators (code, docs, vectors, graph, metadata, questions)."""

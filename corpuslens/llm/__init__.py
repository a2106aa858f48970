"""Training-data operators: tokenising, extraction, dedup, filters, packing."""

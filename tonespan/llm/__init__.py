"""Training-data operators: scoring, filtering, extraction, deduplication and packing."""

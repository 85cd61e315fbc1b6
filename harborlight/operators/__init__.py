"""DataFrame operators: scoring, curation, retrieval."""

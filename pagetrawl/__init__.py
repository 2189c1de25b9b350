"""DataFrame operators for web corpora: extraction, link graph, full-text search, ingest."""

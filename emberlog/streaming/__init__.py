"""Structured Streaming ingest: request documents arrive as files (or any
streaming source with doc_id/value columns) and are written batch by batch."""

"""Composed plans: the query catalog, batch ingest and the bench query set."""

"""Structured Streaming jobs: ingestion, vector sync, dashboard refresh."""

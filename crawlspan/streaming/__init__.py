"""Structured Streaming forms of ingest and crawl statistics."""

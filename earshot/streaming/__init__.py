"""Structured Streaming forms of ingest, counting, short-term taste and player timers."""

"""Structured Streaming ingest of edges and events."""

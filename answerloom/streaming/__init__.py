"""Structured Streaming forms of the usage, ingest, search and history jobs."""
